"""The per-document operators on streams."""
