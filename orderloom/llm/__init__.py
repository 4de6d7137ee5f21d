"""Operators for training-data preparation, one module each, and their queries (``queries.py``)."""
