"""Compositions of operators that answer one question end to end."""
