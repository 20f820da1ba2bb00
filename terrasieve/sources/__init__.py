"""Readers, writers and audits of files."""
