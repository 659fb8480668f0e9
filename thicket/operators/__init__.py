"""Counting, splitting and learning over packed features."""
