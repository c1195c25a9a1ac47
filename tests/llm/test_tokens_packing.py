from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from caseloom.llm import packing, tokens

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


TEXTS = [
    "", None, " ", "a", "Hello there, it's 12 o'clock.\n\n  Yes\t!", "<|endoftext|> in the <|endoftext|>text", "é漢字🙂 ñ", "x" * 3000, "\n" * 500,
    "the end " * 1500, "ab1 " * 700 + "  z",
]


def test_fast_encoder_equals_the_library(library):
    enc = tokens.encoder(PATH)
    assert isinstance(enc, tokens.ByteLevelEncoder)
    rng = random.Random(5)
    alphabet = "ab Z19.,'s\n\t é漢́ -_<|>" + "🙂"
    made = ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(3000)]
    for text in [t or "" for t in TEXTS] + made:
        assert enc.encode(text).tolist() == ids_of(library, text)


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (50, 3), (200, 40), (33, 1)])
def test_spliced_chunks_equal_the_whole(library, chunk, overlap):
    enc = tokens.encoder(PATH)
    rng = random.Random(chunk)
    made = [" ".join("".join(rng.choices("abcde é1'.", k=rng.randint(1, 12))) for _ in range(200)) for _ in range(30)]
    made += ["y" * 900, " " * 700 + "z", "<|endoftext|>" * 60, "a b<|endoftext|> c " * 80, "1 2 3 " * 200]
    for text in made:
        parts = list(tokens.encode_pieces(enc, text, chunk, overlap))
        assert np.concatenate(parts).tolist() == ids_of(library, text)


HARD = {
    "blanks": " " * 2_000_000, "lines": "\n" * 2_000_000, "one letter": "x" * 2_000_000, "blanks and a letter": " " * 1_200_000 + "x",
    "cyrillic": "привет, как дела? " * 70_000, "chinese": "汉字的文本，没有空格。" * 100_000, "chinese without marks": "汉字文本" * 300_000,
    "runs": ("a" * 70_000 + " " * 70_000 + "\n" + "1" * 70_000 + ".") * 3,
}


@pytest.mark.parametrize("name", HARD)
def test_long_texts_equal_the_library(library, name):
    enc, text = tokens.encoder(PATH), HARD[name]
    assert np.concatenate(list(tokens.encode_pieces(enc, text))).tolist() == ids_of(library, text)


@pytest.mark.parametrize(("name", "times"), [("cyrillic", 1.1), ("chinese", 1.1), ("runs", 1.5)])
def test_texts_without_latin_words_are_spliced(name, times, monkeypatch):
    enc, text, read = tokens.encoder(PATH), HARD[name], []
    encode = type(enc).encode
    monkeypatch.setattr(type(enc), "encode", lambda self, t: read.append(len(t)) or encode(self, t))
    parts = list(tokens.encode_pieces(enc, text))
    assert len(parts) > len(text) / 300_000 and sum(read) < times * len(text)


@pytest.mark.parametrize("chunk", [17, 40, 90])
def test_random_texts_are_spliced_without_a_change(library, chunk):
    enc, rng = tokens.encoder(PATH), random.Random(chunk)
    parts = ["a", "Ж", "字", "。", "，", " ", "  ", "\n", "\t", "'", "'re", "s", "1", "-", "<|endoftext|>", "<|", "|>", "\u00a0", "\x1c", "\u3000", "é", "🙂", "́"]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randint(1, 250)))
        got = [x for p in tokens.encode_pieces(enc, text, chunk, rng.randint(1, 9)) for x in p.tolist()]
        assert got == ids_of(library, text), repr(text)


def test_counts(spark, library):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(0, "", 1, "x"), (None, "null id", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, n_bytes string")
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(df, PATH).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), n := len(ids_of(library, t)), n > 1024) for i, t, *_ in rows), key=str)
    assert got == want
    assert tokens.count_tokens(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_files_use_their_library(name):
    enc = tokens.encoder(P.path(name))
    assert isinstance(enc, tokens.LibraryEncoder)
    assert len(enc.encode("some words of a text")) > 3


def check_packing(rows, got, library, window):
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, text in rows:
        ids = [*ids_of(library, text), 0]
        parts = sorted(by_doc[i], key=lambda r: r["start"])
        at = 0
        for r in parts:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            piece = np.array(ids[at : at + r["length"]], dtype="<u4")
            assert r["ids_crc32"] == zlib.crc32(piece.tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return by_seq


def test_packing_round_trip(spark, library):
    rng = random.Random(6)
    rows = list(enumerate(TEXTS + [" ".join(rng.choices(["red", "blue", "of"], k=rng.randint(0, 300))) for _ in range(200)]))
    df = spark.createDataFrame([(i, t, 3, 4) for i, t in rows], "doc_id long, text string, length int, offset int")
    got = packing.pack(df, PATH, 128, group_pieces=64).collect()
    check_packing(rows, got, library, 128)
    got = packing.pack(df, PATH, 128).collect()
    by_seq = check_packing(rows, got, library, 128)
    used = sum(r["length"] for r in got)
    assert used / (128 * len(by_seq)) > 0.97
    assert packing.pack(df.limit(0), PATH).count() == 0
    twice = packing.pack(df.limit(3).union(df.limit(3)), PATH).collect()
    assert len(twice) == 2 * len(packing.pack(df.limit(3), PATH).collect())


def test_ids_of_any_type_are_carried(spark, library):
    """Large, null and string ids come back as they are; full windows are sequences of their own."""
    long = "many words of a text " * 300
    rows = [(2**53 + 1, "one"), (2**53 + 3, long), (None, "three"), (None, None), (2**63 - 1, "x" * 5000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 128).collect()
    check_packing(rows[:2] + rows[4:], [r for r in got if r["doc_id"] is not None], library, 128)
    assert sorted(r["doc_tokens"] for r in got if r["doc_id"] is None) == [1, 2]
    owners = {}
    for r in got:
        owners.setdefault(r["sequence_id"], []).append(r["length"])
    assert sum(128 in v for v in owners.values()) > 10 and all(len(v) == 1 for v in owners.values() if 128 in v)
    named = packing.pack(spark.createDataFrame([("a", "t"), (None, "u")], "doc_id string, text string"), PATH).collect()
    assert sorted(str(r["doc_id"]) for r in named) == ["None", "a"]


def test_many_rows_of_one_id_are_spread(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    got = packing.pack(df, PATH, 64, group_pieces=200).collect()
    groups = Counter((r["sequence_id"] & ~packing.PACKED) >> 23 for r in got)
    assert len(got) == 4000 and len(groups) == 20 and max(groups.values()) < 400


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(7)
    for _ in range(30):
        lengths = np.array([rng.randint(1, 50) for _ in range(rng.randint(0, 120))])
        number, offset = packing.best_fit_decreasing(lengths, 50)
        room: list[int] = []
        want = []
        for i in np.argsort(-lengths, kind="stable"):
            fits = [(r, w) for w, r in enumerate(room) if r >= lengths[i]]
            if not fits:
                room.append(50)
                w = len(room) - 1
            else:
                w = min(fits)[1]
            want.append(50 - room[w])
            room[w] -= lengths[i]
        assert len(room) == (number.max() + 1 if len(number) else 0)
        assert [offset[i] for i in np.argsort(-lengths, kind="stable")] == want
