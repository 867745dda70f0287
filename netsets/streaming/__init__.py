"""Streams: networks that grow batch by batch."""
