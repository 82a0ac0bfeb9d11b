"""Text operators; nothing else in the package imports this."""
