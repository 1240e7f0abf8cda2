"""Registry of the posting queries and their SQL twins."""

from __future__ import annotations

from millrace.plans import collect_plans, commerce, page_plans, posting_plans, record_plans, source_plans

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (commerce, page_plans, posting_plans, record_plans, collect_plans, source_plans):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
