"""Queries of the engine with their SQL twins."""
