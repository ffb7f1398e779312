"""Compound triage and corpus preparation on Spark."""
