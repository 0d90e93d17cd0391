"""The two notations: sentences to verbs and values."""
