"""A PySpark engine for archived news corpora."""
