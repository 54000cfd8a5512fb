"""Readers: change records, HR sheet, activity table, route responses."""
