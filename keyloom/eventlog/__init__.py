"""Summaries of job event logs: batch tables over any number of logs."""
