"""Every reference operator's query over the given tables, with its oracle SQL."""

from __future__ import annotations

from sitewright.catalog_rewrite import R as REWRITE
from sitewright.catalog_site import R as SITE
from sitewright.catalog_snapshots import R as SNAPSHOTS
from sitewright.registry import Query

REGISTRIES = (SNAPSHOTS, SITE, REWRITE)


def queries() -> dict[str, Query]:
    return {name: f for r in REGISTRIES for name, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in REGISTRIES for name, sql in r.sql.items()}
