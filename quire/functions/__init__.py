"""Core building blocks; see the module docstrings."""
