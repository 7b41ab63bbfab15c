"""Operators for building training data from text. Nothing outside this folder imports it."""
