"""All registered queries, by name (importing a module registers its queries)."""

from __future__ import annotations

from . import changes, core, loading, reporting  # noqa: F401

QUERIES = core.QUERIES
ORACLES = core.ORACLES
