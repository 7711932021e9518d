"""Operators for training data.  Optional: nothing in the core imports this package."""
