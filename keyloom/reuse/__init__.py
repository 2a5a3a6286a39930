"""Reuse of stored results across jobs: plan tables, matching, a result store, eviction."""
