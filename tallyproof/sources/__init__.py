"""Readers and writers for landed study pages, synonym tables and results."""
