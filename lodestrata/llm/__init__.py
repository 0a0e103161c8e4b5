"""Operators that prepare archived text for training; nothing outside this folder imports it."""
