"""Named queries over the test tables."""

import importlib

from tabsight.catalog.registry import QUERIES, SQL

for _section in ("ingest", "statistics", "series", "decisions", "logs", "patterns", "relations", "summaries"):
    importlib.import_module(f"tabsight.catalog.{_section}")

__all__ = ["QUERIES", "SQL"]
