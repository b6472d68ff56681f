"""Registered queries and the SQL that checks them."""

from vouchlake.queries import evaluation, extraction, guarding, matching, streams, stratum, upkeep, verdicts
from vouchlake.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "evaluation", "extraction", "guarding", "matching", "streams", "stratum", "upkeep", "verdicts"]
