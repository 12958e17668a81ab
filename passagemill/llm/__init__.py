"""Operators that prepare documents as training data; nothing outside this package imports it."""
