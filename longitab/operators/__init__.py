"""Operators on visit tables, packed sequences and evaluation results."""
