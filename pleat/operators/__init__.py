"""Verbs and the operators that derive verbs from verbs."""
