"""Streams into a store."""
