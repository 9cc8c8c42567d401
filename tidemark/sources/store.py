"""The lake: raw, curated and derived zones, and atomic writes to them."""

from __future__ import annotations

import hashlib
import json
import os
import tomllib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.files import files

ZONES = ("raw", "curated", "derived")

#: Ending of a table that is being replaced.
_ASIDE = ".old"


class StoreError(RuntimeError):
    """The store is missing, or a path leaves it."""


class StaleError(StoreError):
    """A derived table was built from inputs that have changed since."""


def is_absolute(root: str) -> bool:
    """A path from the top of a file system, or a URI of one."""
    return "://" in root or PurePosixPath(root).is_absolute()


def _joined(root: str, *parts: str) -> str:
    """Keeps the scheme of a URI, which a path object would fold."""
    return "/".join([root.rstrip("/"), *(p for p in parts if p)])


@dataclass(frozen=True)
class Store:
    """Paths of one lake; tables are parquet folders inside its zones.

    The root may be a folder or a URI of any file system that Spark reaches;
    without a Spark session only folders of this machine can be opened.
    """

    root: str

    @classmethod
    def initialize(cls, root: str, spark: SparkSession | None = None) -> Store:
        for zone in ZONES:
            files(spark).mkdirs(_joined(root, zone))
        return cls.open(root, spark)

    @classmethod
    def open(cls, root: str, spark: SparkSession | None = None) -> Store:
        if not is_absolute(root):
            raise StoreError(f"the store's root must be absolute, not {root!r}")
        if missing := [z for z in ZONES if not files(spark).is_dir(_joined(root, z))]:
            raise StoreError(f"{root} has no {', '.join(missing)}")
        return cls(root)

    def path(self, zone: str, *parts: str) -> str:
        inside = PurePosixPath(*parts) if parts else PurePosixPath()
        if zone not in ZONES or inside.is_absolute() or ".." in inside.parts:
            raise StoreError(f"{zone}/{inside} is not a path inside the store")
        return _joined(self.root, zone, *inside.parts)

    def read(self, spark: SparkSession, zone: str, *parts: str) -> DataFrame:
        """The table; the one before it if a replacement was cut off midway."""
        path, on = self.path(zone, *parts), files(spark)
        if not on.exists(path) and on.exists(f"{path}{_ASIDE}"):
            path += _ASIDE
        return spark.read.parquet(path)

    def replace(self, df: DataFrame, zone: str, *parts: str) -> str:
        """Writes a table beside the old one and then puts it in its place.

        The old table is renamed aside, the new one in, and only then the old
        one deleted; at every moment one of them is whole, and :meth:`read`
        finds it. If the new one cannot take the place, the old one goes back.
        """
        target = self.path(zone, *parts)
        new, old, on = f"{target}.new", f"{target}{_ASIDE}", files(df.sparkSession)
        df.write.mode("overwrite").option("compression", "zstd").parquet(new)
        if on.exists(target):
            on.delete(old)
            if not on.rename(target, old):
                raise StoreError(f"{target} could not be put aside")
        if not on.rename(new, target):
            if on.exists(old):
                on.rename(old, target)
            raise StoreError(f"{new} could not take the place of {target}")
        on.delete(old)
        return target

    def replace_partitions(self, df: DataFrame, by: str, zone: str, *parts: str) -> str:
        """Replaces the partitions that ``df`` has; all others stay."""
        target = self.path(zone, *parts)
        (
            df.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "zstd")
            .partitionBy(by)
            .parquet(target)
        )
        return target

    def write_text(self, text: str, zone: str, *parts: str) -> str:
        """Replaces a small file, as :meth:`replace` does a table."""
        target, on = self.path(zone, *parts), files()
        new, old = f"{target}.new", f"{target}{_ASIDE}"
        on.write_text(new, text)
        if on.exists(target):
            on.delete(old)
            on.rename(target, old)
        if not on.rename(new, target):
            raise StoreError(f"{new} could not take the place of {target}")
        on.delete(old)
        return target

    def read_text(self, zone: str, *parts: str) -> str | None:
        """A small file; null if there is none."""
        path, on = self.path(zone, *parts), files()
        found = next((p for p in (path, f"{path}{_ASIDE}") if on.exists(p)), None)
        return None if found is None else on.read_text(found)

    def stamp(self, built_from: Mapping[str, str], zone: str, *parts: str) -> None:
        """Keeps, beside a table, the fingerprints of what it was built from."""
        self.write_text(json.dumps(dict(built_from), indent=1, sort_keys=True), zone, *_beside(parts))

    def require_fresh(self, built_from: Mapping[str, str], zone: str, *parts: str) -> None:
        known = self.read_text(zone, *_beside(parts))
        if known is None or json.loads(known) != dict(built_from):
            raise StaleError(f"{self.path(zone, *parts)} was built from other inputs; build it again")


def _beside(parts: Sequence[str]) -> list[str]:
    return [*parts[:-1], f"{parts[-1]}.inputs.json"]


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def resolve_root(explicit: str | None = None, *, variable: str = "TIDEMARK_ROOT", config: str | None = None) -> str:
    """The root as given, else from the environment, else from a TOML file."""
    found = explicit or os.environ.get(variable)
    if not found and config and Path(config).is_file():
        found = tomllib.loads(Path(config).read_text()).get("root")
    if not found:
        raise StoreError(f"give a root, set {variable}, or name one in a configuration file")
    if not is_absolute(found):
        raise StoreError(f"the store's root must be absolute, not {found!r}")
    return found
