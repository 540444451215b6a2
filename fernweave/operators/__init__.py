"""Relational operators over feedback, listing and catalogue rows."""
