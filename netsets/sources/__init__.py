"""sources of netsets."""
