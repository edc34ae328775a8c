"""The registered queries of the reconciliation engine and their SQL."""

from reconlake.queries import decisions, exporting, flow, operating, packages, pages, parameters, reading, reconciliation, rules, sheets
from reconlake.queries.registry import ORACLES, QUERIES

flagship = reconciliation.reconcile_flagship

__all__ = ["ORACLES", "QUERIES", "decisions", "exporting", "flow", "flagship", "operating", "packages", "pages", "parameters", "reading", "rules", "sheets"]
