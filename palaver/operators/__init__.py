"""Operators over speaker groups, texts and table sets."""
