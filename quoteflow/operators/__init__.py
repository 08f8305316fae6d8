"""Operators over whole tables: normalize, union, deduplicate, monitor, audit."""
