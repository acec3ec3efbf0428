"""Operators for building training data from documents, pages and embeddings.

Nothing else in the library imports this subpackage. Each module holds one operator; ``queries`` registers them.
"""
