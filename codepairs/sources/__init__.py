"""Readers, writers and their explicit schemas."""
