"""Operators that prepare text for language models; nothing else in the library imports this folder."""
