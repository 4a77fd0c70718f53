"""Column expressions on queries, URLs, lists and texts."""
