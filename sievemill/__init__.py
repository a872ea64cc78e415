"""Corpus quality engine on PySpark: rules, scores, conventions and trends over tables of files and texts."""
