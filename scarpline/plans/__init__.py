"""Whole questions: lazy compositions of the operators."""
