"""Operators that prepare training text: packing, de-duplication, filtering, tokenising."""
