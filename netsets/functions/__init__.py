"""functions of netsets."""
