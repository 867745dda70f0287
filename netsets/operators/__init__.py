"""operators of netsets."""
