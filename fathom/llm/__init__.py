"""Operators for text used in training language models. Nothing outside this subpackage imports it."""
