"""Operators for training-data corpora: packing, scans, rules, counts, dedup."""
