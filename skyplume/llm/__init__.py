"""Operators that prepare large training corpora; nothing else in the library imports them."""
