"""Readers, writers and adapters from the given tables to the domain schemas."""
