"""Functions of the dialects."""
