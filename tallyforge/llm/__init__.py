"""Operators for large text and identifier collections; nothing outside this subpackage imports it."""
