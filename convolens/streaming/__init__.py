"""Optional streaming forms of the batch operators."""
