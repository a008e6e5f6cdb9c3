"""The operators wired to the driver tables, each with its SQL counterpart.

The driver tables hold prose and a star schema, so inputs of the right shape
are derived from them: every module says how. A query is registered as
``name: (spark function, SQL or None)``.
"""

from __future__ import annotations

from driver_queries import agreement, catalogue, code, frameworks, labels, sampling, survey, tables

MODULES = (code, frameworks, sampling, labels, catalogue, agreement, survey, tables)


def registered() -> dict:
    found = {}
    for module in MODULES:
        for name, pair in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = pair
    return found
