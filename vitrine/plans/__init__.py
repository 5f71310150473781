"""Whole-workflow compositions of the operators."""
