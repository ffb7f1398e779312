"""Per-molecule chemistry in pure Python, without Spark."""

from .alerts import CATALOGS, find_alerts
from .mol import SmilesError, parse, standardise
from .props import descriptors, fingerprint
from .smarts import Pattern
from .canon import generic_scaffold, scaffold, write

__all__ = ["CATALOGS", "Pattern", "SmilesError", "descriptors", "find_alerts", "fingerprint", "generic_scaffold", "parse", "scaffold", "standardise", "write"]
