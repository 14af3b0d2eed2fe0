"""Row-level controls on streaming tables."""
