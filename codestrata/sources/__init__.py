"""Readers. Each splits into ``scan_*`` (files to rows) and ``parse_*`` (rows to facts)."""
