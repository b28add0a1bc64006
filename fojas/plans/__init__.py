"""Helpers that shape plans: written intermediate tables, checked broadcasts, bounded groups."""
