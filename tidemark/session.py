"""Session factory and the shared folder in which lineage is cut."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on (AQE on, UTC, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a purely local session, where driver and executors are one process,
    falls back to a temporary folder of this machine; on a cluster an unset
    folder is an error, because a lost executor would take its files along.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder (eagerly, reliably)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a parquet table in the shared folder and read again.

    Smaller than a checkpoint (columnar, zstd); used where the rows are wide.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tidemark-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package, wherever they run.

    The package goes to the executors with Spark's own files, once for each
    application; called before a Python function is handed to Spark.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    package = Path(__file__).resolve().parent
    files = sorted(package.rglob("*.py"))
    if files:
        digest = hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:12]
        path = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / f"tidemark-{digest}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for f in files:
                archive.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(path))
    sc._tidemark_shipped = True
