"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return the
columns of documents; what they reject, change or reorder is what the next stage reads.

Every stage reads whole texts of any length, carries further columns whatever their names, and
gives no row for an empty table; what it does with nulls, empty texts, ties and repeated rows is
said with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import mixing, near_dedup, packing, secrets, toxicity
from caseloom.llm.queries import SOURCE_WEIGHTS, tokenizer_path
from caseloom.llm.runtime import discard, durable, scratch_path, table

#: Stages that SQL cannot express (a trained model, sketches, tokens) are tested by brute force.
ORACLE_SQL = None

SIMILARITY = 0.8


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels table, does not call toxic.

    A null or empty text is scored as one without words and so stays; a null id is no obstacle, as
    only texts are scored.  Repeated rows get one score and stay or go together; a score of 0.5 is
    toxic.  Without labelled rows all documents stay.
    """
    model = toxicity.fit(*toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    own = {c: f"_own_{c}" for c in docs.columns if c in ("score", "predicted")}
    scored = toxicity.score(docs.withColumnsRenamed(own), model).where("predicted = 0")
    return scored.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id.

    Of repeated rows of an id one stays, and one of each text where they differ.  Rows with a null
    id stay, and so do null and empty texts and those without words, which are copies of nothing.
    """
    verdict = durable(near_dedup.near_duplicates(docs, SIMILARITY))
    gone = verdict.where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = durable(
        verdict.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("doc_id")
    )
    if twice.isEmpty():
        return left
    once = left.join(twice, "doc_id", "left_anti").select(*docs.columns)
    repeated = left.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return once.unionByName(repeated)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each found secret replaced by a mask; n_chars is counted anew where the text
    changed.  Null texts stay null, empty ones empty; overlapping secrets get one mask; repeated
    rows are masked alike."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files that follow the interleaved order of their sources.

    A null source is a source of its own; sources without a target weight get the smallest one.
    Within a source rows come by a hash of doc_id, null ids too; ties and repeated rows by text.
    A table of one source comes in that order alone.
    """
    return mixing.mixed_documents(docs, SOURCE_WEIGHTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in the packed sequences, which follow the order
    of the documents in the files that the mixing stage made.

    A null or empty text is one piece, the end id; null and repeated ids are carried as they are,
    a piece list for each row; a document over a window is cut into full windows and a rest.
    """
    placed = mixing.file_positions(docs.select("doc_id", "text"), "pack_position")
    return packing.pack(placed, tokenizer_path(), position="pack_position")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result but the last is written to the shared folder and
    read again by the next stage, then deleted; the one that the result reads stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
