"""Operators for training data: each module is one operator, ``catalog`` registers their queries."""
