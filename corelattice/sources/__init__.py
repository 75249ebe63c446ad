"""Readers, writers and the named-element store."""
