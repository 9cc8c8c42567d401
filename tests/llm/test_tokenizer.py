import random

import pytest

from tidemark.llm import tokenizer as K

ENC = K.encoding(K.vocabulary_path())
TEXTS = [
    "", " ", "\n\n", "Olá, mundo!  Dois  espaços.\n\n\tFim", "<|endoftext|> is text", "it's we'll 'quoted' 12345abc678", "日本語テキスト 😀😀 ção",
    "a" * 3000, " " * 9000, " " * 9000 + "x", "\n" * 5000 + " y", "x" + "　" * 6000 + "z", "tab\t" * 2000, "é" * 4000 + " " * 5000 + "9" * 50,
]


@pytest.mark.parametrize("chunk", [1, 7, 100, 5000])
def test_cut_texts_give_the_same_ids(chunk):
    rng = random.Random(chunk)
    mixed = ["".join(rng.choice(["word", " ", "  ", "\n", "7", ".", "'s", "\xa0", "ü", "😀"]) for _ in range(300)) for _ in range(20)]
    for text in [t for t in TEXTS if len(t) < 5000 or chunk > 50] + mixed:
        assert K.encode_text(ENC, text, chunk) == ENC.encode_ordinary(text), text[:40]


def test_very_long_runs_of_space():
    for text in (" " * 700_000, " " * 700_000 + "x", "a" + "\n " * 350_000 + "b", " " * 300_000):
        assert K.decode_ids(ENC, K.encode_text(ENC, text)) == text.encode()
    long = " " * 100_000 + "x y"
    assert K.encode_text(ENC, long) == ENC.encode_ordinary(long)


def test_white_space_is_that_of_the_pattern():
    """Each character counts as space here exactly if it does in the pattern."""
    import regex

    ours = regex.compile(f"[{K.SPACE}]")
    for c in map(chr, [*range(0x3100), 0xFEFF, 0x1F600]):
        if not 0xD800 <= ord(c) < 0xE000:
            # A space takes a blank before it into its run; anything else leaves it.
            theirs = regex.fullmatch(r"\p{White_Space}", c) is not None
            assert bool(ours.fullmatch(c)) == theirs, hex(ord(c))


def test_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None])] + [(0, "", "x"), (None, "a b", "y")]
    df = spark.createDataFrame(rows, "id bigint, text string, ids string")
    got = K.encode_documents(df, "id", "text")
    found = [(r.id, list(r.ids)) for r in got.collect()]
    want = [(i, ENC.encode_ordinary(t) if t else []) for i, t, _ in rows]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    raw = {r.id: bytes(r.raw) for r in K.decode_documents(got, "id", "ids").collect()}
    assert all(raw[i] == (t or "").encode() for i, t, _ in rows)
    assert K.encode_documents(df.limit(0), "id", "text").collect() == []


def test_damaged_bytes(spark):
    df = spark.sql("SELECT 1L AS id, cast(X'61FF62' AS string) AS text")
    assert K.encode_documents(df, "id", "text").first().ids == ENC.encode_ordinary("a�b")


def test_equals_the_other_public_library():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(K.vocabulary_path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    texts = [t for t in TEXTS if len(t) < 5000]
    assert [K.encode_text(ENC, t) for t in texts] == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]
