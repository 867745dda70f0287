"""plans of netsets."""
