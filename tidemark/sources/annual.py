"""From annual archives in the raw zone to bars by year, with a record of what was built."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.archives import FormatError
from tidemark.sources.files import files
from tidemark.sources.fixed_width import file_report, read_annual, read_lines
from tidemark.sources.store import Store

#: Versions of the record and of the reader; both go up when they change.
MANIFEST_VERSION, READER_VERSION = 1, 1

_NAME = re.compile(r"A(\d{4})\.ZIP$", re.IGNORECASE)


def raw_years(store: Store, *parts: str) -> list[int]:
    """The years that have an archive in a folder of the raw zone, in order."""
    found = (_NAME.search(p) for p in files().matching(store.path("raw", *parts) + "/*"))
    return sorted({int(m[1]) for m in found if m})


def pick_source(paths: Iterable[str], year: int) -> str:
    """The archive of a year, whatever the case of its name; none or two are errors."""
    found = sorted(p for p in paths if (m := _NAME.search(p)) and int(m[1]) == year)
    if not found:
        raise FileNotFoundError(f"no archive of {year}")
    if len(found) > 1:
        raise FormatError(f"several archives of {year}: {', '.join(p.rsplit('/', 1)[-1] for p in found)}")
    return found[0]


def read_manifest(store: Store) -> dict[int, dict]:
    """What each year of ``curated/bars`` was built from; empty if nothing was."""
    text = store.read_text("curated", "bars.manifest.json")
    if text is None:
        return {}
    content = json.loads(text)
    if content.get("version") != MANIFEST_VERSION:
        raise FormatError(f"the manifest has version {content.get('version')!r}, not {MANIFEST_VERSION}")
    return {int(y): entry for y, entry in content["years"].items()}


def _bars(rows: DataFrame) -> DataFrame:
    return rows.where("market_type = 10").select(
        F.year("session_date").alias("year"), F.col("session_date").alias("session"), F.col("isin").alias("symbol"), F.col("ticker").alias("label"),
        "market_type", "distribution_number", "open", "high", "low", "close", F.col("volume_shares").cast("double").alias("volume"), "traded_value",
    )


def build_years(spark: SparkSession, store: Store, years: Sequence[int] | None = None, folder: Sequence[str] = ()) -> dict[int, dict]:
    """Builds ``curated/bars`` for the years (all there are) and records them in its manifest.

    All archives are read in one pass, each by a task of its own; only the
    partitions of their years are replaced. A broken archive stops the build
    before anything is written. Returns the entries of the years built: file,
    bytes and digest, the counts of the reader, and the sessions written.
    """
    paths = files(spark).matching(store.path("raw", *folder) + "/*")
    wanted = raw_years(store, *folder) if years is None else sorted(set(years))
    chosen = [pick_source(paths, y) for y in wanted]
    if not chosen:
        return {}
    return ingest(spark, store, chosen)


def ingest(spark: SparkSession, store: Store, paths: Sequence[str]) -> dict[int, dict]:
    """:func:`build_years` of the archives named."""
    store.replace_partitions(_bars(read_annual(spark, paths)), "year", "curated", "bars")
    digests = spark.read.format("binaryFile").load(list(paths)).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )
    report = file_report(read_lines(spark, paths)).drop("problem").join(digests, "file")
    written = store.read(spark, "curated", "bars").groupBy("year").agg(
        F.count("*").alias("rows_kept"),
        F.count_distinct("session").alias("sessions"),
        F.min("session").cast("string").alias("first_session"),
        F.max("session").cast("string").alias("last_session"),
    )
    now = dt.datetime.now(dt.UTC).isoformat(timespec="seconds")
    rows = [r.asDict() for r in report.join(written, "year", "left").collect()]
    built = {r["year"]: {**r, "reader_version": READER_VERSION, "built_at": now} for r in rows}
    every = {**read_manifest(store), **built}
    text = json.dumps({"version": MANIFEST_VERSION, "years": {str(y): every[y] for y in sorted(every)}}, indent=1)
    store.write_text(text, "curated", "bars.manifest.json")
    return built
