"""Extraction plans, what is rendered from them, and the adjudication of proposals against the records."""
