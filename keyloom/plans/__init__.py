"""Shared plan building blocks: checks, keys, shared storage, skew handling, prefix sums."""
