"""Readers with explicit schemas, writers, and the redistribution scan."""
