"""Changelogs, segment files and the store."""
