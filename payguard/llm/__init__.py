"""Corpus preparation: the ten operators a training-data pipeline needs."""
