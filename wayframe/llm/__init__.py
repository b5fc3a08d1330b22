"""Operators for training-data preparation: quality, secrets, personal data, tokens, mixing, joins and search."""
