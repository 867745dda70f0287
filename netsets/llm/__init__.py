"""Training-data operators; nothing else in netsets imports this subpackage."""
