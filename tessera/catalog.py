"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from tessera.plans import filters, formats, networks, records, relations, sequences  # noqa: F401  each registers its queries
from tessera.plans.base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
