"""docev: a PySpark engine for document-evidence analytics."""
