"""Operators on text for language models; nothing outside this folder imports it."""
