"""Row-local operators on streaming frames: validation and coercion need no state.

Record validation, decoding, dictionary coercion and range checks are projections, so the
batch functions apply unchanged to a streaming DataFrame.  This module only splits a
stream of records into valid rows and quarantined rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabsight.operators.eventlog import validate_records


def split_records(stream: DataFrame, json: str) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) records of a batch or streaming frame."""
    checked = validate_records(stream, json)
    return checked.filter("is_valid").drop("errors", "is_valid"), checked.filter("NOT is_valid").drop("is_valid")
