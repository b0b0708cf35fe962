"""Queries over the benchmark tables: each plan applies the library's operators; its SQL twin is written independently."""
