"""Operators of a training-data pipeline over tables of documents, vectors, pages and conversations."""
