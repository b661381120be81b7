"""Operators on documents, chunks, vectors, questions and claims."""
