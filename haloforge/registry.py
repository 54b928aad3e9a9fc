"""All registered queries and their SQL."""

from __future__ import annotations

from haloforge.plans.queries import QUERIES as _QUERIES
from haloforge.plans.sql import SQL as _SQL

#: Names that queries had while they took a part of the ids; they stay registered, each for the query and SQL of its plain name.
FORMER = {f"{name}_all": name for name in ("node_lookup", "region_fof", "tree_slice", "tolerance_match")}
QUERIES = _QUERIES | {old: _QUERIES[name] for old, name in FORMER.items()}
SQL = _SQL | {old: _SQL[name] for old, name in FORMER.items()}

__all__ = ["FORMER", "QUERIES", "SQL"]
