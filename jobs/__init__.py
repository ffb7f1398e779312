"""Runnable jobs over the given tables: ``python -m jobs.shortlist`` and ``python -m jobs.intake``."""
