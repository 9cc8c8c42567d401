import random

import pytest

from tidemark.llm import splitting as S
from tidemark.llm.tokenizer import encode_text, encoding, vocabulary_path

PATH = vocabulary_path()
ENC = encoding(PATH)


def texts():
    rng = random.Random(8)
    words = ["capital", "ação", "dividend", "of", "the", "R$", "1.234,56", "日本", "😀", "x"]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(4, 20))) + "."
    out = ["\n\n".join(" ".join(sentence() for _ in range(rng.randint(1, 6))) for _ in range(40)) for _ in range(4)]
    out += ["\n".join(sentence() for _ in range(200)), " ".join(rng.choice(words) for _ in range(3000)), "é" * 4000, "😀" * 1500, " " * 90_000]
    return [*out, "a,b;" * 3000, "line\n" * 2000]


@pytest.mark.parametrize("limit,overlap", [(128, 16), (1024, 64), (100, 0), (64, 32)])
def test_pieces(limit, overlap):
    splitter = S.Splitter(PATH, limit, overlap)
    for text in texts():
        raw, n = text.encode(), len(encode_text(ENC, text))
        pieces = splitter.split(text)
        assert b"".join(raw[p.fresh : p.end] for p in pieces) == raw
        assert (len(pieces) > 1) == (n > limit)
        for p in pieces:
            body = raw[p.start : p.end].decode()
            assert p.tokens == len(encode_text(ENC, body)) <= limit
        for a, b in zip(pieces, pieces[1:]):
            assert a.fresh < b.fresh == a.end and b.start <= a.end
            shared = raw[b.start : a.end].decode()
            assert bool(shared) == bool(overlap)
        least = -(-(n - overlap) // (limit - overlap))
        assert len(pieces) >= min(least, 1) and (limit < 1000 or len(pieces) <= least * 1.5 + 2)


def test_ends_are_natural_where_they_can_be():
    splitter = S.Splitter(PATH, 128, 16)
    paragraphs, _, _, _, lines, words, *_ = texts()
    raw = paragraphs.encode()
    for p in splitter.split(paragraphs)[:-1]:
        assert p.boundary >= S.SENTENCE
        assert raw[p.end - 1 : p.end] in b".\n"
    assert all(p.boundary >= S.LINE for p in splitter.split(lines))
    assert all(p.boundary >= S.WORD for p in splitter.split(words))


def test_overlap_is_the_given_number_of_tokens():
    splitter = S.Splitter(PATH, 128, 16)
    text = texts()[0].replace("日本", "jp").replace("😀", ":)")
    ids = encode_text(ENC, text)
    ends, at = {}, 0
    for i, token in enumerate(ids):
        at += len(ENC.decode_single_token_bytes(token))
        ends[at] = i + 1
    pieces = splitter.split(text)
    for a, b in zip(pieces, pieces[1:]):
        cut = ends.get(a.end) or min(v for k, v in ends.items() if k >= a.end)
        assert cut - ends[b.start] == 16


def test_documents(spark):
    long = "A sentence here. " * 400
    rows = [(1, long, "x"), (2, "short", "x"), (3, None, "x"), (4, "", "x"), (1, long, "x"), (5, "a " * 600, "x")]
    df = spark.createDataFrame(rows, "id bigint, text string, piece string")
    got = S.split_documents(df, "id", "text", limit=256, overlap=8)
    found = got.collect()
    assert {r.id for r in found} == {1, 5}
    assert sum(r.piece_no == 1 for r in found if r.id == 1) == 2
    assert all(r.piece == dict((i, t) for i, t, _ in rows)[r.id].encode()[r.start_byte : r.end_byte].decode() for r in found)
    every = S.split_documents(df, "id", "text", limit=256, overlap=8, small=True, texts=False).collect()
    assert {r.id for r in every} == {1, 2, 5}
    assert S.split_documents(df.limit(0), "id", "text").collect() == []
    with pytest.raises(ValueError):
        S.Splitter(PATH, 100, 60)


def test_an_early_boundary_is_taken_where_there_is_no_other():
    splitter = S.Splitter(PATH, 1024, 64)
    head, stretch = "A short heading\n", "x1y2" * 1500
    pieces = splitter.split(head + stretch)
    assert (pieces[0].end, pieces[0].boundary) == (len(head), S.LINE)
    # The same after a cut within a text: the last sentence before a stretch.
    body = "One more sentence of a text. " * 200 + "\n"
    first = splitter.split(body + head + stretch)
    assert len(head + body) in [p.end for p in first if p.boundary == S.LINE]


def test_a_blank_beyond_the_target_is_taken_before_a_word_is_cut():
    splitter = S.Splitter(PATH, 1024, 64)
    for blank_at in (800, 20):  # tokens; the target is about 580
        head = ENC.decode(encode_text(ENC, "x1y2" * 400)[:blank_at])
        text = head + " " + "z3w4" * 600
        text = ENC.decode(encode_text(ENC, text)[:1100])
        first = splitter.split(text)[0]
        assert (first.end, first.boundary) == (len(head), S.WORD)
