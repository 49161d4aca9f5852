"""Readers, table store and storage measures."""
