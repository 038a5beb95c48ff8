"""Change capture on streams."""
