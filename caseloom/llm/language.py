"""Languages of texts by compression with zstandard dictionaries.

Method: each language has a raw-content dictionary, the words of its labelled texts that most
documents use, the commonest at the end, where matches are cheapest.  A text is lower-cased, all
but its letters becomes single blanks, and blocks of BLOCK_BYTES of it are compressed with every
dictionary.  The language whose dictionary makes the whole text smallest is chosen; where the
second is nearly as small, the choice is rejected.

A block that does not shrink is stored as it is, and all languages would tie; so each block is
followed by a pad of zeros, which always shrinks, and short texts are compared by their matches.

Dictionaries are fitted on a bounded sample: of each language, documents in order of a hash until
their texts reach SAMPLE_BYTES.  Which hashes can be among these is known from counts by leading
zeros, added up before they move, so no more than a few times the sample is ever gathered, a
language a task.  The driver holds one dictionary of at most DICT_BYTES a language, MODEL_BYTES
in all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.llm.runtime import BROADCAST_ROWS, durable
from caseloom.llm.textcore import slices

#: Bytes of text of each language that the dictionaries are made from, and bytes of a dictionary.
SAMPLE_BYTES, DICT_BYTES = 4 << 20, 1 << 16
#: Bytes of all dictionaries together: with more than 4,096 languages each gets an equal part.
MODEL_BYTES = 256 << 20
BLOCK_BYTES, PAD = 2048, bytes(96)
#: A choice is rejected if the second language needs less than so many bytes more, or less than
#: this share of the bytes.
MARGIN_BYTES, MARGIN_SHARE = 2, 0.01
#: Longer runs of letters (scripts without blanks) are cut into parts of so many for the dictionary.
PART_CHARS = 12
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The letters of text, lower-cased, with single blanks for all else; empty without letters."""
    kept = _OTHER.sub(" ", text.lower()).strip()
    return f" {kept} ".encode() if any(map(str.isalpha, kept)) else b""


def make_dictionary(texts: list[str], size: int = DICT_BYTES) -> bytes:
    """Words by the number of texts that use them, commonest last, until size bytes are full;
    what is left is filled with texts, before the words."""
    known: Counter = Counter()
    plain = [letters(t).decode() for t in texts]
    for text in plain:
        known.update({w[i : i + PART_CHARS] for w in text.split() for i in range(0, len(w), PART_CHARS)})
    words, used = [], 1
    for word, n in sorted(known.items(), key=lambda x: (-x[1], x[0])):
        part = word.encode()
        if n < 2 or used + len(part) + 1 > size:
            break
        words.append(part)
        used += len(part) + 1
    head, left = [], size - used
    for text in plain:
        if left <= 0:
            break
        head.append(text.encode()[:left])
        left -= len(head[-1])
    return b"".join([*head, b" ", *(w + b" " for w in reversed(words))])


@dataclass
class Model:
    """Languages with their dictionaries, the one with most documents first."""

    names: list[str]
    dictionaries: list[bytes]


class Encoder:
    """Compressed sizes of texts by every dictionary of a model."""

    def __init__(self, model: Model) -> None:
        import zstandard as zs

        form = zs.ZstdCompressionParameters(
            format=zs.FORMAT_ZSTD1_MAGICLESS, window_log=17, hash_log=14, chain_log=15, search_log=4, min_match=4, target_length=48,
            strategy=zs.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        raw = [zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT) for d in model.dictionaries]
        self._by = [zs.ZstdCompressor(dict_data=d, compression_params=form).compress for d in raw]
        self.names = model.names

    def sizes(self, plain: bytes) -> list[int]:
        blocks = [plain[at : at + BLOCK_BYTES] + PAD for at in range(0, len(plain), BLOCK_BYTES)]
        return [sum(len(c(b)) for b in blocks) for c in self._by]

    def decide(self, text: str | None) -> tuple[str, float, int, bool]:
        """(language, score, bytes that the second language needs more, rejected)."""
        plain = letters(text or "")
        if not plain or not self.names:
            return UNKNOWN, 0.0, 0, True
        sizes = self.sizes(plain)
        best = min(range(len(sizes)), key=sizes.__getitem__)  # of equal ones the first
        more = np.array(sizes) - sizes[best]
        score = 1.0 / np.exp2(-8.0 * np.minimum(more, 100)).sum()
        margin = int(np.partition(more, 1)[1]) if len(sizes) > 1 else sizes[best]
        return self.names[best], float(score), margin, margin < max(MARGIN_BYTES, MARGIN_SHARE * sizes[best])


def held_out(column: Column) -> Column:
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, size: int = SAMPLE_BYTES, dictionary: int = DICT_BYTES) -> Model:
    """A model of the documents that held_out() does not set aside, from text and lang.

    Rows with a null id, text or lang teach nothing; repeated rows count once in the sample.
    """
    known = docs.select(docs["doc_id"].alias("id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    known = known.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    known = known.withColumn("hash", F.xxhash64("id", "text"))
    zeros = 64 - F.length(F.bin("hash"))
    # texts of each number of leading zeros: distinct ones, as copies may be a third of the rows
    sized = known.groupBy("lang", zeros.alias("zeros")).agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct("hash").alias("texts"), F.avg(F.octet_length("text")).alias("mean")
    )
    more = Window.partitionBy("lang").orderBy(F.desc("zeros"))  # at most 65 rows a language
    reached = sized.select("lang", "zeros", "n", F.sum(F.col("texts") * F.col("mean")).over(more).alias("bytes"))
    least = durable(
        reached.groupBy("lang").agg(
            F.coalesce(F.max(F.when(F.col("bytes") >= 2 * size, F.col("zeros"))), F.lit(0)).alias("least"), F.sum("n").alias("n")
        )
    )
    languages = least.count()
    dictionary = max(1, min(dictionary, MODEL_BYTES // max(languages, 1)))
    bound = least.select("lang", "least")
    bound = F.broadcast(bound) if languages <= BROADCAST_ROWS else bound
    # what passes is two to four samples of each language
    chosen = known.join(bound, "lang").where(zeros >= F.col("least"))
    chosen = chosen.dropDuplicates(["lang", "hash"]).select("lang", "hash", "text")

    def made(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("hash", kind="stable")
        before = rows["text"].str.len().cumsum().shift(fill_value=0)
        content = make_dictionary(rows["text"][before < size].tolist(), dictionary)
        return pd.DataFrame({"lang": [key[0]], "content": [content]})

    made_of = chosen.groupBy("lang").applyInPandas(made, "lang string, content binary")
    counted = least.select("lang", "n").join(made_of, "lang").collect()  # a dictionary a language
    counted.sort(key=lambda r: (-r["n"], r["lang"]))
    return Model([r["lang"] for r in counted], [bytes(r["content"]) for r in counted])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score, margin_bytes and rejected for each row's whole text.

    lang_pred is a language of the model, UNKNOWN where the text is null or has no letter or the
    model is empty (score 0, rejected).  score (0 to 1): the share of the language if each byte
    saved counts as eight bits of evidence.  Equal sizes go to the language with more documents.
    rejected: the second language is within the margins; lang_pred is then only the likeliest.
    Repeated rows get equal results; an empty table gives no row.  Columns of these names in docs
    are replaced; all rows and other columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DICT_BYTES a language
    docs = docs.drop("lang_pred", "score", "margin_bytes", "rejected")
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in slices(batches):
            found = [encoder.decide(t.as_py()) for t in batch.column(place).cast(pa.string())]
            names, scores, margins, rejected = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.int64()), pa.array(rejected, pa.bool_())],
                [*batch.schema.names, "lang_pred", "score", "margin_bytes", "rejected"],
            )

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, margin_bytes long, rejected boolean")


def predict(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin_bytes, rejected) for each row of docs, by a
    model fitted on the others.  A null id counts as held out."""
    found = identify(docs.select(docs["doc_id"], docs["text"]), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin_bytes", "rejected")
