"""Encoding and decoding of whole corpora with a public tokenizer."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ship

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts longer than this many characters are cut before they are encoded.
CHUNK_CHARS = 65_536

#: Ids that leave a task at a time, whatever the size of the batches it gets.
IDS_AT_ONCE = 1 << 19

#: Runs of white space longer than this bypass the regex, whose look-ahead
#: backtracks over the whole run (a million blanks overflow its stack).
LONG_SPACE = 4_096

# The characters with the Unicode property White_Space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: No pre-token holds a non-space followed by a space, nor a letter next to a
#: digit, so a text may be cut there without changing its ids.
_SAFE = regex.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])|(?<=\p{{L}})(?=\p{{N}})|(?<=\p{{N}})(?=\p{{L}})")
_RUN = regex.compile(rf"[{SPACE}]{{{LONG_SPACE},}}")


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary files are installed on this machine."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """The encoding of a local rank file, loaded once in each Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _chunks(text: str, most: int) -> Iterator[str]:
    """The text in parts of about ``most`` characters, cut where it is safe."""
    start = 0
    while len(text) - start > most:
        cut = _SAFE.search(text, start + most)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str | None, chunk: int = CHUNK_CHARS) -> list[int]:
    """Ids of one text, without special tokens; [] for null and for ''.

    Strings that look like special tokens are ordinary text. The result does
    not depend on ``chunk``.
    """
    if not text:
        return []
    if len(text) <= min(chunk, CHUNK_CHARS):
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in _chunks(text, chunk):
        at = 0
        for run in _RUN.finditer(part):
            # Before a non-space the last blank of a run is left to it.
            end = run.end() if run.end() == len(part) else run.end() - 1
            ids += enc.encode_ordinary(part[at : run.start()])
            ids += enc._core_bpe.encode_single_piece(part[run.start() : end].encode("utf-8"))
            at = end
        ids += enc.encode_ordinary(part[at:])
    return ids


def decode_ids(enc: tiktoken.Encoding, ids: list[int]) -> bytes:
    """The raw bytes behind ids; any slice of ids decodes, even mid-character."""
    return enc.decode_bytes(ids)


def as_text(value: pa.Scalar) -> str | None:
    """The string of a binary value; damaged UTF-8 as U+FFFD."""
    raw = value.as_py()
    return None if raw is None else raw.decode("utf-8", "replace")


def list_array(rows: list[np.ndarray]) -> pa.ListArray:
    """Arrays of ids as one column of lists."""
    ends = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in rows], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def encode_documents(
    df: DataFrame, id_column: str, text_column: str, *, vocabulary: str | None = None
) -> DataFrame:
    """``id_column, ids``: the token ids of each row's text.

    An empty or null text has an empty list; every row comes out, repeats
    included. ``vocabulary`` is the path of a local rank file, which each
    Python worker loads once. The result follows the input's partitions; there
    is no shuffle, and texts of any length are encoded in bounded portions.
    """
    ship(df.sparkSession)
    path = vocabulary or vocabulary_path()
    schema = T.StructType([df.schema[id_column], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            start, rows, held = 0, [], 0
            for i, text in enumerate(batch.column(1), 1):
                rows.append(np.array(encode_text(enc, as_text(text)), dtype=np.int32))
                held += len(rows[-1])
                if held >= IDS_AT_ONCE or i == batch.num_rows:
                    yield pa.record_batch([batch.column(0).slice(start, i - start), list_array(rows)], [id_column, "ids"])
                    start, rows, held = i, [], 0

    return df.select(id_column, F.col(text_column).cast("binary").alias("_t")).mapInArrow(run, schema)


def decode_documents(df: DataFrame, id_column: str, ids_column: str, *, vocabulary: str | None = None) -> DataFrame:
    """``id_column, raw``: the bytes of each row's ids; null ids give null."""
    ship(df.sparkSession)
    path = vocabulary or vocabulary_path()
    schema = T.StructType([df.schema[id_column], T.StructField("raw", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            raw = [None if x is None else decode_ids(enc, x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(raw, pa.binary())], [id_column, "raw"])

    return df.select(id_column, F.col(ids_column).alias("_i")).mapInArrow(run, schema)
