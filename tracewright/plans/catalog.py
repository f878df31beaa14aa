"""All registered queries outside the corpus subpackage, with the SQL that gives the same rows."""

from __future__ import annotations

from tracewright.plans import catalog_core, catalog_io, catalog_tables, catalog_text  # noqa: F401
from tracewright.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "win_top_diversified"
