"""Incremental forms of the batch operators, for files as they land."""
