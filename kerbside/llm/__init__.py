"""Operators for training-data tables: documents, pages, benchmark items and labels."""
