"""Operators of a training-data pipeline: texts, vectors, near copies and language models."""
