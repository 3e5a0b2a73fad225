"""Relational operators over the logs table."""
