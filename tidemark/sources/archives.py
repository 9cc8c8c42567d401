"""Text tables inside ZIP archives, read on the executors."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ship


class FormatError(ValueError):
    """A file breaks the layout its reader relies on."""


#: Lines that leave the archive at a time.
_LINES = 50_000


def zipped_lines(spark: SparkSession, paths: Sequence[str], member: str = ".*", encoding: str = "latin-1") -> DataFrame:
    """``file, member, line_no, line`` of the matching members of ZIP files.

    An archive is one task's work, since a member can only be read from its
    start; its lines stream out in portions. ``line_no`` counts from 1; line
    ends are taken off. Bytes that are not in ``encoding`` are kept as U+FFFD.
    """
    if not paths:
        return spark.createDataFrame([], "file string, member string, line_no bigint, line string")
    ship(spark)
    pattern = re.compile(member, re.IGNORECASE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = path.rsplit("/", 1)[-1]
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for inside in sorted(n for n in archive.namelist() if pattern.fullmatch(n)):
                        with io.TextIOWrapper(archive.open(inside), encoding, "replace", newline="\n") as text:
                            held: list[str] = []
                            start = 1
                            for line in text:
                                held.append(line.rstrip("\r\n"))
                                if len(held) == _LINES:
                                    yield _lines(name, inside, start, held)
                                    start, held = start + len(held), []
                            if held:
                                yield _lines(name, inside, start, held)

    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return files.mapInArrow(run, "file string, member string, line_no bigint, line string")


def _lines(name: str, inside: str, start: int, held: list[str]) -> pa.RecordBatch:
    n = len(held)
    return pa.record_batch(
        [pa.array([name] * n), pa.array([inside] * n), pa.array(range(start, start + n), pa.int64()), pa.array(held)],
        ["file", "member", "line_no", "line"],
    )


def zipped_csv(spark: SparkSession, paths: Sequence[str], member: str, columns: Sequence[str], sep: str = ";") -> DataFrame:
    """``file`` and the named columns of delimited members, as trimmed text.

    Each member's first line names its columns, in any order; a missing one
    is an error, raised when the rows are read. Fields are not quoted.
    """
    lines = zipped_lines(spark, paths, member)
    heads = lines.where("line_no = 1").select("file", "member", F.split("line", re.escape(sep)).alias("_head"))
    rows = lines.where("line_no > 1 AND trim(line) <> ''").select("file", "member", F.split("line", re.escape(sep)).alias("_cells"))
    met = rows.join(heads, ["file", "member"])

    def cell(name: str):
        at = F.array_position("_head", name).cast("int")
        missing = F.raise_error(F.concat("file", F.lit(f": no column {name}"))).cast("string")
        return F.when(at == 0, missing).otherwise(F.trim(F.get("_cells", at - 1))).alias(name)

    return met.select("file", *(cell(c) for c in columns))


def reference_securities(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``reference_year, ticker, cnpj`` of registration forms, distinct."""
    rows = zipped_csv(
        spark, paths, r"fca_cia_aberta_valor_mobiliario_\d{4}\.csv", ["Data_Referencia", "Codigo_Negociacao", "CNPJ_Companhia"]
    )
    return (
        rows.select(
            F.substring("Data_Referencia", 1, 4).cast("smallint").alias("reference_year"),
            F.upper("Codigo_Negociacao").alias("ticker"),
            F.col("CNPJ_Companhia").alias("cnpj"),
        )
        .where("ticker <> '' AND cnpj <> ''")
        .distinct()
    )


_SPLITS = r"fre_cia_aberta_capital_social_desdobramento_\d{4}\.csv"
_CLASSES = r"fre_cia_aberta_capital_social_desdobramento_classe_acao_\d{4}\.csv"


def share_count_events(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Share counts before and after capital events, by class.

    ``cnpj, company, approved_on, kind, share_class, shares_before,
    shares_after, source_file``; ordinary (ON), preferred (PN) and lettered
    classes (PNA ...) of one event are rows of their own. Rows without a date
    or positive counts are left out; of repeated ones that of the last file
    stays.
    """
    names = {"before": "Antes_Aprovacao", "after": "Depois_Aprovacao"}
    event = "ID_Capital_Social_Desdobramento"
    wide = [f"Quantidade_Acoes_{k}_{n}" for k in ("Ordinarias", "Preferenciais") for n in names.values()]
    events = zipped_csv(spark, paths, _SPLITS, ["CNPJ_Companhia", "Nome_Companhia", event, "Data_Aprovacao", "Tipo_Evento", *wide])
    base = events.select(
        "file",
        event,
        F.col("CNPJ_Companhia").alias("cnpj"),
        F.col("Nome_Companhia").alias("company"),
        F.try_to_date("Data_Aprovacao", "yyyy-MM-dd").alias("approved_on"),
        F.col("Tipo_Evento").alias("kind"),
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(c).alias("share_class"),
                        *(F.col(f"Quantidade_Acoes_{k}_{n}").alias(f"shares_{side}") for side, n in names.items()),
                    )
                    for c, k in (("ON", "Ordinarias"), ("PN", "Preferenciais"))
                )
            )
        ).alias("_s"),
    ).select("*", "_s.*").drop("_s")
    classes = zipped_csv(
        spark, paths, _CLASSES, [event, "Tipo_Classe_Acao_Preferencial", *(f"Quantidade_Acoes_{n}" for n in names.values())]
    )
    letter = F.regexp_extract("Tipo_Classe_Acao_Preferencial", "^Preferencial Classe ([A-H])$", 1)
    named = classes.where(letter != "").select(
        "file", event, F.concat(F.lit("PN"), letter).alias("share_class"),
        *(F.col(f"Quantidade_Acoes_{n}").alias(f"shares_{side}") for side, n in names.items()),
    )
    about = base.select("file", event, "cnpj", "company", "approved_on", "kind").distinct()
    rows = base.unionByName(named.join(about, ["file", event])).withColumns(
        {f"shares_{side}": F.col(f"shares_{side}").try_cast("double") for side in names}
    )
    key = ["cnpj", "approved_on", "kind", "share_class", "shares_before", "shares_after"]
    return (
        rows.where("shares_before > 0 AND shares_after > 0 AND approved_on IS NOT NULL")
        .groupBy(*key)
        .agg(F.max_by("company", "file").alias("company"), F.max("file").alias("source_file"))
        .select("cnpj", "company", *key[1:], "source_file")
    )
