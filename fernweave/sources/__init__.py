"""Readers of landed payloads and writers of report tables."""
