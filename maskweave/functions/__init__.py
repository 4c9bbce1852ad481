"""Column-level helpers: pattern translation, token formats, text measures."""
