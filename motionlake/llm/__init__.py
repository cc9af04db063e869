"""Operators for large text-corpus pipelines; nothing else in the library imports this subpackage."""
