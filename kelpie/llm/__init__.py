"""Operators for training data: source validity, splitting, grouping, search, pairs, encoding, mixing, cut texts."""
