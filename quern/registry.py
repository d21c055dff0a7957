"""All registered queries and oracles but those of the llm subpackage."""

from __future__ import annotations

from quern.queries import base, cases, functions, kde, procedures, relational, structures  # noqa: F401  (they register)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    return dict(base.ORACLES)
