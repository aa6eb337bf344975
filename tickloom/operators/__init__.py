"""Relational operators over event tapes."""
