"""Whole plans made of operators: the page pipeline and the registered queries."""
