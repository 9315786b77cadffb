"""Training-data operators; nothing outside this package imports it."""
