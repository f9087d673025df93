"""All registered queries and their SQL twins."""

from __future__ import annotations

from hubweave.plans import comparisons, core, exports, plots, scores

MODULES = (core, comparisons, scores, plots, exports)


def queries():
    return {name: build for m in MODULES for name, build in m.Q.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.S.items()}
