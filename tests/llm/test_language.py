from __future__ import annotations

import random
import zlib

import pytest

from caseloom.llm import language

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "ré"], "bb": ["sch", "ung", "ein", "ber", "öl"], "cc": ["日本", "語で", "文章", "です", "また"]}


def sentence(rng, lang, words):
    gap = "" if lang == "cc" else " "
    return gap.join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        lang = rng.choice(["aa", "aa", "bb", "cc"])
        rows.append((i, sentence(rng, lang, rng.randint(8, 120)), lang, "x"))
    rows += [(1000 + i, rows[0][1], rows[0][2], "x") for i in range(400)]  # copies of one text
    rows += [(2000, None, "aa", "x"), (2001, "", "bb", "x"), (2002, "12 34 !?", "aa", "x"), (2003, "²½ Ⅷ", "aa", "x"), (2004, "ka lo mi tu", None, "x")]
    rows += [rows[7], (None, rows[1][1], "zz", "x"), (2005, sentence(rng, "bb", 100_000), "bb", "x")]
    schema = "doc_id long, text string, lang string, score string"
    return rows, spark.createDataFrame(rows, schema).repartition(5)


def test_held_out_accuracy(docs):
    rows, df = docs
    got = language.predict(df).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang, _ in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held) and len(held) > 100
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) > 0.98 * len(held)
    by = {r["doc_id"]: r for r in got}
    for i in (2000, 2001, 2002, 2003):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True)
    assert by[2004]["lang_pred"] == "aa" and by[2005]["lang_pred"] == "bb"
    assert by[None]["held_out"] and by[None]["lang_pred"] == truth[1]
    assert {r["lang_pred"] for r in got} == {"aa", "bb", "cc", "und"}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in range(1000, 1400)}) == 1


def test_languages_are_learned_from_the_other_rows_only(spark, docs):
    """What held-out rows say of themselves changes nothing."""
    rows, df = docs
    changed = [(i, t, "lie" if i is not None and zlib.crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in rows]
    other = spark.createDataFrame(changed, df.schema).repartition(3)
    assert sorted(map(str, language.predict(df).collect())) == sorted(map(str, language.predict(other).collect()))


def test_narrow_margins_are_rejected():
    rng = random.Random(6)
    made = {x: language.make_dictionary([sentence(rng, x, 60) for _ in range(50)]) for x in ("aa", "bb")}
    encoder = language.Encoder(language.Model(["aa", "bb"], list(made.values())))
    clear, mixed = sentence(rng, "aa", 40), sentence(rng, "aa", 40) + " " + sentence(rng, "bb", 28)
    assert encoder.decide(clear)[0] == "aa" and not encoder.decide(clear)[3]
    assert encoder.decide("wxyz")[3] and encoder.decide("wxyz")[1] <= 0.5 + 1e-9
    assert encoder.decide(mixed)[2] < encoder.decide(clear)[2] * 2
    whole = sentence(rng, "bb", 4000)  # every block counts, not the head alone
    assert encoder.decide(sentence(rng, "aa", 400) + " " + whole)[0] == "bb"


def test_dictionaries_keep_their_bounds():
    rng = random.Random(7)
    texts = [sentence(rng, "aa", 100) for _ in range(80)]
    for size in (1, 200, 5000, 1 << 16):
        made = language.make_dictionary(texts, size)
        assert len(made) <= size + 1
    assert language.make_dictionary([]) == b" "


def test_no_labels_and_other_columns(spark):
    schema = "doc_id long, text string, lang string, rejected string, more int"
    df = spark.createDataFrame([(1, "some words", None, "mine", 5), (2, None, None, "mine", 6)], schema)
    assert [tuple(r) for r in language.predict(df).orderBy("doc_id").collect()] == [
        (1, False, "und", 0.0, 0, True) if zlib.crc32(b"1") % 4 != 2 else (1, True, "und", 0.0, 0, True),
        (2, zlib.crc32(b"2") % 4 == 2, "und", 0.0, 0, True),
    ]
    kept = language.identify(df, language.Model(["a"], [b" some words "])).collect()
    assert [(r["more"], r["lang_pred"]) for r in kept] == [(5, "a"), (6, "und")]
    assert language.predict(df.limit(0)).count() == 0
