"""Planners: what a run would change, as tables."""
