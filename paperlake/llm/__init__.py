"""Operators for building training data from a document library; nothing outside imports this."""
