"""Splitting oversized texts at natural boundaries, balanced in tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.tokenizer import as_text, encode_text, encoding, vocabulary_path
from tidemark.session import ship

#: Strengths of the places a piece may end at.
PARAGRAPH, LINE, SENTENCE, WORD, CHARACTER = 4, 3, 2, 1, 0

_NATURAL = re.compile(
    rb"(\n[ \t\r]*\n[ \t\r\n]*)|(\n)|(?:[.!?]|\xe2\x80\xa6|\xe3\x80\x82)+[\"')\]]*(?=[ \t\r\n])"
)
_BLANK = re.compile(rb"[ \t\r\n]+")


@dataclass(frozen=True)
class Piece:
    """Byte range of a piece, where its new part begins, its size and end."""

    start: int
    fresh: int
    end: int
    tokens: int
    boundary: int


@lru_cache(maxsize=4)
def _lengths(path: str) -> np.ndarray:
    """Bytes of each token id of a vocabulary."""
    enc = encoding(path)
    out = np.zeros(enc.max_token_value + 1, dtype=np.int64)
    for token in enc.token_byte_values():
        out[enc.encode_single_token(token)] = len(token)
    return out


class Splitter:
    """Cuts one text after the other with the same settings."""

    def __init__(self, path: str, limit: int, overlap: int) -> None:
        if not 0 <= overlap <= limit // 2 or limit < 8:
            raise ValueError(f"an overlap of {overlap} does not go with a limit of {limit} tokens")
        self.enc: tiktoken.Encoding = encoding(path)
        self.lengths = _lengths(path)
        self.limit, self.overlap = limit, overlap

    def _size(self, raw: bytes) -> int:
        return len(encode_text(self.enc, raw.decode("utf-8")))

    def split(self, text: str | None) -> list[Piece]:
        """The pieces of a text; one if it is within the limit, none if empty."""
        if not text:
            return []
        raw = text.encode("utf-8")
        if len(raw) <= self.limit:
            return [Piece(0, 0, len(raw), self._size(raw), PARAGRAPH)]
        ids = np.asarray(encode_text(self.enc, text), dtype=np.int64)
        n = len(ids)
        if n <= self.limit:
            return [Piece(0, 0, len(raw), n, PARAGRAPH)]
        ends = np.cumsum(self.lengths[ids])
        found = list(_NATURAL.finditer(raw))
        at = np.fromiter((m.end() for m in found), dtype=np.int64, count=len(found))
        kind = np.fromiter(
            (PARAGRAPH if m.lastindex == 1 else LINE if m.lastindex == 2 else SENTENCE for m in found),
            dtype=np.int64,
            count=len(found),
        )
        # Tokens that a prefix up to each boundary takes.
        place = np.searchsorted(ends, at, side="left") + 1
        pieces: list[Piece] = []
        cut = 0  # tokens before the part not yet covered
        step = self.limit - self.overlap
        while True:
            first = self._char_start(raw, ends, max(0, cut - self.overlap)) if cut else 0
            begin = int(ends[first - 1]) if first else 0
            fresh = pieces[-1].end if pieces else 0
            left = max(1, -(-(n - first - self.overlap) // step))
            if left == 1:
                size = self._size(raw[begin:])
                if size <= self.limit:
                    pieces.append(Piece(begin, fresh, len(raw), size, PARAGRAPH))
                    return pieces
                left = 2
            most = self.limit
            while True:
                end, boundary = self._end(raw, ends, place, at, kind, n, first, cut, left, most)
                size = self._size(raw[begin:end])
                if size <= self.limit:
                    break
                # Cut off from its surroundings the piece came out larger.
                most = max(self.overlap + 1, most - (size - self.limit) - 1)
            pieces.append(Piece(begin, fresh, end, size, boundary))
            cut = int(np.searchsorted(ends, end, side="left")) + 1

    @staticmethod
    def _char_start(raw: bytes, ends: np.ndarray, token: int) -> int:
        """The last token at or before ``token`` that begins with a character."""
        while token and raw[int(ends[token - 1])] & 0xC0 == 0x80:
            token -= 1
        return token

    def _end(self, raw, ends, place, at, kind, n, first, cut, left, most) -> tuple[int, int]:
        """Where the piece from token ``first`` on ends, and how strong that is.

        The target gives the ``left`` pieces still needed equal lengths. The
        strongest boundary near it wins, the nearest of equally strong ones;
        then the nearest natural one that leaves the others enough room, then
        the last one at all (which takes a piece more; one in the first eighth
        only if there is none beyond), then a blank before the target, or else
        after it, or else in the first eighth, then a character.
        """
        high = min(first + most, n - 1)
        target = first + -(-(n - first + (left - 1) * self.overlap) // left)
        target = min(target, high)
        low = max(cut + 1, n - (left - 1) * (self.limit - self.overlap))
        shortest = cut + max(1, (self.limit - self.overlap) // 8)

        def between(a: int, b: int) -> slice:
            return slice(int(np.searchsorted(place, a)), int(np.searchsorted(place, b, side="right")))

        near = self.limit // 8
        for window in (between(max(low, target - near), min(high, target + near)), between(max(low, shortest), high)):
            if window.start < window.stop:
                strength, distance = kind[window], np.abs(place[window] - target)
                if window.stop - window.start > 1:
                    best = int(np.lexsort((distance, -strength))[0])
                else:
                    best = 0
                return int(at[window][best]), int(strength[best])
        for window in (between(shortest, high), between(cut + 1, min(shortest - 1, high))):
            if window.start < window.stop:
                return int(at[window.stop - 1]), int(kind[window.stop - 1])
        top, bottom = int(ends[target - 1]), int(ends[min(shortest, target - 1)])
        fresh = int(ends[cut - 1]) if cut else 0
        blanks = [b for m in _BLANK.finditer(raw, fresh, int(ends[high - 1]) + 1) if (b := m.start()) > fresh]
        # The last one before the target, the first one after it, an early one.
        before, after = [b for b in blanks if b <= top], [b for b in blanks if b > top]
        if before and (before[-1] > bottom or not after):
            return before[-1], WORD
        if after:
            return after[0], WORD
        while top > fresh + 1 and top < len(raw) and raw[top] & 0xC0 == 0x80:
            top -= 1
        return top, CHARACTER


def split_documents(
    df: DataFrame,
    id_column: str,
    text_column: str,
    *,
    limit: int = 1024,
    overlap: int = 64,
    vocabulary: str | None = None,
    texts: bool = True,
    small: bool = False,
) -> DataFrame:
    """Pieces of the texts above ``limit`` tokens (with ``small`` of all texts).

    Result: ``id_column, piece_no`` (from 1)``, start_byte, fresh_byte,
    end_byte, n_tokens, boundary`` and, with ``texts``, ``piece``. The bytes
    are those of the text in UTF-8; from ``fresh_byte`` on a piece holds what
    no earlier one has, so the fresh parts in order give the text back. A
    piece begins ``overlap`` tokens of the whole text's encoding before the
    end of the one before it (a few more where that is inside a character).
    ``boundary`` tells what it ends at: 4 paragraph or end of text, 3 line,
    2 sentence, 1 blank, 0 none of these.

    The least number of pieces and equal targets come first; each target is
    snapped to the strongest boundary near it, and every piece is encoded by
    itself: where one is over the limit it is cut shorter, and pieces are
    added as needed. No piece is over the limit.

    Null and empty texts have no pieces; repeated rows are split each; extra
    columns are left out. Texts of at most ``limit`` bytes cannot exceed the
    limit, since a token has a byte or more, and are not encoded. There is no
    shuffle; memory is that of one text and its ids.
    """
    ship(df.sparkSession)
    path = vocabulary or vocabulary_path()
    fields = [df.schema[id_column]] + [
        T.StructField(n, T.LongType()) for n in ("start_byte", "fresh_byte", "end_byte")
    ]
    fields.insert(1, T.StructField("piece_no", T.IntegerType()))
    fields += [T.StructField("n_tokens", T.IntegerType()), T.StructField("boundary", T.IntegerType())]
    if texts:
        fields.append(T.StructField("piece", T.StringType()))
    schema = T.StructType(fields)
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(path, limit, overlap)
        for batch in batches:
            owner, rows, parts = [], [], []
            for i, text in enumerate(map(as_text, batch.column(1))):
                pieces = splitter.split(text)
                if len(pieces) < 2 and not small:
                    continue
                raw = text.encode("utf-8") if texts and text else b""
                for no, p in enumerate(pieces, 1):
                    owner.append(i)
                    rows.append((no, p.start, p.fresh, p.end, p.tokens, p.boundary))
                    if texts:
                        parts.append(raw[p.start : p.end].decode("utf-8"))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            arrays = [batch.column(0).take(pa.array(owner, pa.int64()))]
            arrays += [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            if texts:
                arrays.append(pa.array(parts, pa.string()))
            yield pa.record_batch(arrays, schema.names)

    rows = df.select(id_column, F.col(text_column).cast("binary").alias("_t"))
    if not small:
        rows = rows.where(F.octet_length("_t") > limit)
    return rows.mapInArrow(run, schema)
