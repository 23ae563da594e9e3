"""Operators for large training-data pipelines; nothing else in docev imports this subpackage."""
