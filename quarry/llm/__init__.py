"""Operators for training text: each module is one operator, ``queries`` registers them with production parameters."""
