"""Operators: relations in, relations out."""
