"""SimHash fingerprints, in DataFrame functions only.

Terms are pairs of adjacent lower-cased words (the last word also stands alone, so that a text
of one word has a term); a text's distinct terms vote with a weight of 1 to 8 that grows with
their length.  Each of the 128 bits is set if the weights of the terms whose hash has it exceed
half of all weights.

The votes are added as plain long sums over exploded terms: one long holds the sums of two
bits, 32 bits wide each, so 64 sums count 128 bits within generated code, and no counter can
overflow below 500 million terms.

Rows are dealt once, by ranges of doc_id.  The next document's text, the votes and the next
document's fingerprint all use that one exchange; the first row of each range is repeated at the
end of the range before it, which keeps the order whole across ranges.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.llm.runtime import attach, durable, partitions, planned_bytes

BITS = 128
SPACES = r"[\x20\x09-\x0D]+"
#: Cut points are looked up in two steps of this many.
FAN = 64
#: Ranges hold about so many bytes of the table as stored; at most so many ranges, whose cut points
#: travel with the plan.  Beyond that they grow, and their sorts spill to disk.
RANGE_BYTES, MOST_RANGES = 64 << 20, 1 << 14


def term_hashes(text: Column) -> Column:
    """Distinct hashed terms; the low three bits hold the weight less one."""
    words = F.array_remove(F.split(F.lower(text), SPACES), "")
    pairs = F.zip_with(
        words,
        F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))),
        lambda a, b: F.xxhash64(a, b)
        .bitwiseAND(F.lit(-8))
        .bitwiseOR(
            F.least(
                F.lit(7), F.shiftright(F.length(a) + F.coalesce(F.length(b), F.lit(0)), 2)
            ).cast("long")
        ),
    )
    return F.array_distinct(pairs)


def _votes(term: Column) -> list[Column]:
    """64 sums; sum 32*h + k counts bits k and k + 32 of hash h."""
    weight = term.bitwiseAND(F.lit(7)) + 1
    lanes = F.lit((1 << 32) | 1)
    sums = []
    for h in range(2):
        hashed = F.xxhash64(term, F.lit(h))
        for k in range(32):
            sums.append(
                F.sum(F.shiftrightunsigned(hashed, k).bitwiseAND(lanes) * weight).alias(f"v{32 * h + k}")
            )
    return [*sums, F.sum(weight).alias("weights")]


def _half(h: int) -> Column:
    """64 bits of the fingerprint from the sums."""
    out = F.lit(0).cast("long")
    low = F.lit((1 << 32) - 1)
    for k in range(32):
        lane = F.coalesce(F.col(f"v{32 * h + k}"), F.lit(0))
        for shift, value in ((k, lane.bitwiseAND(low)), (k + 32, F.shiftrightunsigned(lane, 32))):
            bit = 1 << shift
            bit = bit - (1 << 64) if bit >= 1 << 63 else bit
            out = out.bitwiseOR(F.when(value * 2 > F.col("weights"), F.lit(bit)).otherwise(F.lit(0)).cast("long"))
    return out


def hex_of(a: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def likeness(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """1 less the share of differing bits."""
    distance = F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))
    return F.lit(1.0) - distance / F.lit(float(BITS))


def _range_of(cuts: list[int]) -> Column:
    """Number of cut points at or below doc_id."""
    if not cuts:
        return F.lit(0)
    fine = [cuts[i : i + FAN] for i in range(0, len(cuts), FAN)]
    # constant arrays, folded once by the optimizer
    coarse = F.from_json(F.lit(json.dumps([c[0] for c in fine])), "array<bigint>")
    table = F.from_json(F.lit(json.dumps(fine)), "array<array<bigint>>")
    step = F.size(F.filter(coarse, lambda c: c <= F.col("doc_id")))
    inner = F.size(F.filter(F.element_at(table, F.greatest(step, F.lit(1))), lambda c: c <= F.col("doc_id")))
    return F.when(step > 0, (step - 1) * FAN + inner).otherwise(F.lit(0))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(rng, pos, doc_id, body, next_body, real): documents in descending doc_id order.

    Rows of a range are together and sorted; real is false for the repeated first row of the
    range that follows.  Equal ids are in descending order of text, null ids come last.
    """
    spark = docs.sparkSession
    base = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("body"),
    )
    if ranges is None:
        ranges = min(MOST_RANGES, max(4 * partitions(spark), planned_bytes(base) // RANGE_BYTES))
    probs = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(base.approxQuantile("doc_id", probs, 0.2 / ranges))) if probs else []
    dealt = base.withColumn("rng", _range_of([int(c) for c in cuts]))
    # one row a range: bounded by their number
    firsts = sorted(dealt.groupBy("rng").agg(F.max("doc_id").alias("head")).collect(), key=lambda r: -r["rng"])
    after = [
        (r["rng"], firsts[(i + 1) % len(firsts)]["rng"], firsts[(i + 1) % len(firsts)]["head"])
        for i, r in enumerate(firsts)
    ]
    wanted = spark.createDataFrame(after, "into int, source int, head long")
    heads = (
        dealt.join(F.broadcast(wanted), (F.col("rng") == F.col("source")) & F.col("doc_id").eqNullSafe(F.col("head")))
        .groupBy("into")
        .agg(F.max("body").alias("body"), F.first("head").alias("doc_id"))
        .select("doc_id", "body", F.col("into").alias("rng"), F.lit(False).alias("real"))
    )
    order = Window.partitionBy("rng").orderBy(F.desc("real"), F.desc_nulls_last("doc_id"), F.desc("body"))
    return dealt.withColumn("real", F.lit(True)).unionByName(heads).select(
        "rng",
        F.row_number().over(order).alias("pos"),
        "doc_id",
        "body",
        F.lead("body").over(order).alias("next_body"),
        "real",
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likenesses.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    f0, f1): the edited text has the last floor(n_chars / 2) code points replaced by the first
    as many, or all, of the next document in descending doc_id order, after the last the first.

    A null text is empty; an empty text has the fingerprint 0.  Repeated rows give one row each
    and follow each other by descending text; rows with a null id come last.  A single document
    is its own next one.  An empty table gives no row; other columns are not read.
    """
    rows = with_next(docs)
    n = F.length("body")
    half = F.shiftright(n, 1)
    edited = F.concat(
        F.substring(F.col("body"), F.lit(1), n - half),
        F.substring(F.coalesce("next_body", F.lit("")), F.lit(1), half),
    )
    spread = (
        rows.select("rng", "pos", "doc_id", "real", n.cast("long").alias("n_chars"), "body", edited.alias("edited"))
        .withColumn("edited_sha256", F.sha2("edited", 256))
        .withColumn(
            "versions",
            F.when(
                F.col("real"),
                F.array(F.struct(F.lit(0).alias("v"), F.col("body").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t"))),
            ).otherwise(F.array(F.struct(F.lit(0).alias("v"), F.col("body").alias("t")))),
        )
        .select("rng", "pos", "doc_id", "real", "n_chars", "edited_sha256", F.explode("versions").alias("x"))
    )
    keys = ["rng", "pos", "v", "doc_id", "real", "n_chars", "edited_sha256"]
    terms = spread.select(
        *[k for k in keys if k != "v"], F.col("x.v").alias("v"), F.explode_outer(term_hashes(F.col("x.t"))).alias("term")
    )
    summed = terms.groupBy(*keys).agg(*_votes(F.col("term")))
    done = summed.select(*keys, _half(0).alias("f0"), _half(1).alias("f1"))
    order = Window.partitionBy("rng").orderBy("pos", "v")
    placed = done.select(
        *keys, "f0", "f1",
        *[F.lead(f, s).over(order).alias(f"{f}_{s}") for f in ("f0", "f1") for s in (1, 2)],
    ).where("real and v = 0")
    return placed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hex_of(F.col("f0"), F.col("f1")).alias("fingerprint"),
        hex_of(F.col("f0_1"), F.col("f1_1")).alias("edited_fingerprint"),
        likeness(F.col("f0"), F.col("f1"), F.col("f0_1"), F.col("f1_1")).alias("near_edited"),
        likeness(F.col("f0"), F.col("f1"), F.col("f0_2"), F.col("f1_2")).alias("near_next"),
        "f0",
        "f1",
    )


def within_radius(prints: DataFrame, radius: int = 3, kept_blocks: int = 2) -> DataFrame:
    """(f0, f1, copies, n_near): for each distinct fingerprint its rows, and the rows whose
    fingerprints lie within radius bits of it, its own among them.

    Permuted block tables: the bits are cut into radius + kept_blocks blocks; two fingerprints
    within radius agree in at least kept_blocks of them.  Each choice of kept_blocks blocks is
    one table keyed by their bits; a pair counts in the first table only that holds it, so
    nothing is found twice.  Copies are one class, and pairs are summed as they are found.
    """
    n_blocks = radius + kept_blocks
    classes = durable(prints.groupBy("f0", "f1").agg(F.count(F.lit(1)).alias("copies")))
    text = hex_of(F.col("f0"), F.col("f1"))
    width = 32 / n_blocks
    edges = [round(i * width) for i in range(n_blocks + 1)]
    blocks = [F.substring(text, edges[i] + 1, edges[i + 1] - edges[i]) for i in range(n_blocks)]
    chosen = list(combinations(range(n_blocks), kept_blocks))
    tables = classes.withColumn("blocks", F.array(*blocks)).select(
        "f0", "f1", "copies", "blocks",
        F.posexplode(F.array(*[F.xxhash64(*[blocks[i] for i in c]) for c in chosen])).alias("tbl", "bucket"),
    )
    a = tables.select(*[F.col(c).alias(f"a_{c}") for c in ("f0", "f1", "blocks")], "tbl", "bucket")
    b = tables.select(*[F.col(c).alias(f"b_{c}") for c in ("f0", "f1", "blocks")], "tbl", "bucket", "copies")
    distance = F.bit_count(F.col("a_f0").bitwiseXOR(F.col("b_f0"))) + F.bit_count(F.col("a_f1").bitwiseXOR(F.col("b_f1")))
    same = [F.col("a_blocks")[i] == F.col("b_blocks")[i] for i in range(n_blocks)]
    first = F.lit(len(chosen))
    for t, c in reversed(list(enumerate(chosen))):
        agree = same[c[0]]
        for i in c[1:]:
            agree = agree & same[i]
        first = F.when(agree, F.lit(t)).otherwise(first)
    a, b = a.withColumnRenamed("tbl", "a_tbl").withColumnRenamed("bucket", "a_bucket"), b
    pairs = a.join(
        b,
        (F.col("a_tbl") == F.col("tbl")) & (F.col("a_bucket") == F.col("bucket"))
        & ((F.col("a_f0") != F.col("b_f0")) | (F.col("a_f1") != F.col("b_f1")))
        & (distance <= radius) & (first == F.col("tbl")),
    )
    extra = pairs.groupBy(F.col("a_f0").alias("f0"), F.col("a_f1").alias("f1")).agg(F.sum("copies").alias("others"))
    return classes.join(extra, ["f0", "f1"], "left").select(
        "f0", "f1", "copies", (F.col("copies") + F.coalesce("others", F.lit(0))).alias("n_near")
    )


def fingerprint_table(docs: DataFrame, radius: int = 3) -> DataFrame:
    """fingerprints() with n_near, the number of other documents within radius bits."""
    prints = durable(fingerprints(docs))
    near = durable(within_radius(prints.select("f0", "f1"), radius))
    # copies of one text, and all empty texts, have one fingerprint: it may be that of any share of the rows
    return (
        attach(prints, near, ["f0", "f1"])
        .withColumn("n_near", F.col("n_near") - 1)
        .drop("f0", "f1", "copies")
    )
