"""Readers of exported snapshots, lists, documents and written tables."""
