"""Column expressions: text, conversation, mapping and naming functions."""
