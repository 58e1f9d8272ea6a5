"""Every registered query of the library and the SQL that must agree with it."""

from __future__ import annotations

from reprise.plans.oracles import ORACLES
from reprise.plans.queries import QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
