"""Distributed values and how verbs on them become DataFrame plans."""
