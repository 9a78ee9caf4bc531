"""Operators for building training corpora of language models; nothing else in the library uses them."""
