"""Manual decisions in YAML files, read strictly on the driver."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.archives import FormatError

#: Sections of a file, their fields and types (a trailing ? marks optional ones).
SCHEMAS: Mapping[str, Mapping[str, type]] = {
    "links": {"from_isin": str, "to_isin": str, "note": str},
    "reject": {"record": str, "note": str},
    "accept": {"record": str, "note": str},
    "periods": {"period": str, "effective_from": dt.date, "note": str},
}
_SPARK = {str: "string", dt.date: "date"}


def load_overrides(spark: SparkSession, path: str, section: str) -> DataFrame:
    """The rows of one section; unknown or missing fields and repeats are errors.

    A missing file or section has no rows. Such files are written by hand and
    small.
    """
    fields = SCHEMAS[section]
    content = yaml.safe_load(Path(path).read_text("utf-8")) if Path(path).is_file() else {}
    if content is None:
        content = {}
    if not isinstance(content, dict) or (unknown := sorted(set(content) - set(SCHEMAS))):
        raise FormatError(f"{path}: not a table of sections" if not isinstance(content, dict) else f"{path}: no section {', '.join(unknown)}")
    rows = []
    for i, item in enumerate(content.get(section) or [], 1):
        if not isinstance(item, dict) or set(item) != set(fields):
            raise FormatError(f"{path}: {section} {i} must have {', '.join(fields)}")
        for name, kind in fields.items():
            if type(item[name]) is not kind:
                raise FormatError(f"{path}: {section} {i}: {name} is no {kind.__name__}")
        rows.append(tuple(item[f] for f in fields))
    keys = [r[:-1] for r in rows]
    if len(set(keys)) < len(keys):
        raise FormatError(f"{path}: {section} repeats an entry")
    return spark.createDataFrame(rows, ", ".join(f"{n} {_SPARK[k]}" for n, k in fields.items()))


def apply_decisions(df: DataFrame, key: str, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without the decided ones, and the decided ones; all must be there."""
    decided = decisions.select(decisions.columns[0]).withColumnRenamed(decisions.columns[0], key).distinct()
    unused = [r[0] for r in decided.join(df.select(key), key, "left_anti").collect()]
    if unused:
        raise FormatError(f"decisions about unknown records: {sorted(unused)}")
    return df.join(decided, key, "left_anti"), df.join(decided, key, "left_semi")
