"""Relational operators over frames, journals and nested records."""
