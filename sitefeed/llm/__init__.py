"""Operators for building training corpora: filters, joins, searches, models."""
