"""All core queries with their SQL."""

from __future__ import annotations

from kinloom.plans import linkage, linkage_sql, skew

FLAGSHIP = "q_tier_counts"
QUERIES = {**skew.QUERIES, **linkage.QUERIES}


def oracles() -> dict[str, str]:
    return {**skew.ORACLES, **linkage_sql.oracles()}
