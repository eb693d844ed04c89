"""Readers and writers: inventories, archives, JSON documents, cache tables."""
