"""Operators for preparing large text corpora. Nothing else in lodestream imports this."""
