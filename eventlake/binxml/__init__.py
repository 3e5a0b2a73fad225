"""Decoder of templated binary XML."""
