"""Operators for preparing training text and embeddings. Nothing else in the package imports this subpackage."""
