"""Readers and writers: tables, JSON lines, pages, office files, vector files."""
