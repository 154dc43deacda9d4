"""Operators on k-mer tables, graphs and features."""
