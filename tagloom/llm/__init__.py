"""Operators that prepare training data from source files and the texts about them."""
