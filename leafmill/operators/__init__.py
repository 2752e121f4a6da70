"""Operators over the relations of a collection."""
