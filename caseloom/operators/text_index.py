"""A full-text index on disk: posting blocks with positions, and searches that read blocks of the
queries' words only.

Documents are dealt to ranges of about RANGE_DOCS by a hash of their ids.  The postings of a word
in one range are one block: how many documents hold it, how often the one that holds it most does,
and each document's positions.  However common a word, its blocks are bounded and spread over all
tasks.  Blocks lie in folders by a hash of the word, sorted by word, so a search opens few folders
and row groups.

A query is an `or` of conjunctions of words and "phrases", with - for exclusion, and its rank is the
cover density, both as in plans.keyword.  A search has three steps, none of which reads a text:

1. The heads of the blocks of the queries' words, without positions, tell in which ranges a
   conjunction has all its words, and the most that any document of the range can score: a document
   has at most as many shortest extents as it has positions of the words.
2. The ranges that promise most are evaluated for each query, which gives the score to beat.
3. Of the others, those that can reach that score are.

Blocks are read once for each of steps 2 and 3, whatever the number of conjunctions that name their
words: the blocks of a range go to one task together, which meets all conjunctions with them and lets
go of all but the n best documents of each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.operators.retrieval import MOST_QUERIES, slices_of
from caseloom.operators.topn import BLOCK_SCORES, ids_of
from caseloom.plans import keyword
from caseloom.session import durable

RANGE_DOCS, MOST_FOLDERS = 1 << 14, 1024
#: Ranges that are evaluated first for each query.
FIRST_RANGES = 4
#: Postings that one folder holds at least before there are more of them; a posting takes about so
#: many characters of text, or more.
FOLDER_POSTINGS, POSTING_CHARS = 1 << 22, 8
#: Ranges that lie in one file of a folder at most.
FILE_RANGES = 8
#: Scores are rounded to six digits; bounds leave so much room.
ROOM = 1e-6
ENTRIES = "array<struct<id:{id},at:array<int>>>"


def plain_words(text: str) -> list[tuple[str, int]]:
    """(lower-cased word, position) of all words, none left out or shortened."""
    return [(w, n) for n, w in enumerate(keyword._WORD.findall(text.lower()), 1)]


#: What makes the words of texts and queries.
ANALYSERS: dict[str, Callable[[str], list[tuple[str, int]]]] = {"english": keyword.lexemes, "plain": plain_words}


def build(chunks: DataFrame, path: str, analyser: str = "english", range_docs: int = RANGE_DOCS) -> TextIndex:
    """Write an index of chunks(id, content) to path.

    Null and empty texts have no words.  Rows that share an id are one document whose positions are
    those of all its texts, so ids should be unique.
    """
    spark = chunks.sparkSession
    split, kind = ANALYSERS[analyser], chunks.schema["id"].dataType.simpleString()
    n, size = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.col("content").cast("string"))), F.lit(0))).first()
    ranges = max(1, -(-n // range_docs))
    folders = max(1, min(MOST_FOLDERS, -(-size // (POSTING_CHARS * FOLDER_POSTINGS))))
    texts = chunks.select("id", F.col("content").cast("string").alias("content")).where("content is not null and id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                words, owner, places = [], [], []
                for row, text in enumerate(part.column(1)):
                    index: dict[str, list[int]] = {}
                    for w, p in split(text.as_py()):
                        index.setdefault(w, []).append(p)
                    words += index
                    owner += [row] * len(index)
                    places += index.values()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner, pa.int32())), pa.array(words, pa.string()), pa.array(places, pa.list_(pa.int32()))],
                    ["id", "word", "at"],
                )

    postings = texts.mapInArrow(run, f"id {kind}, word string, at array<int>")
    dealt = postings.withColumn("range", F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int")).withColumn("folder", _folder(F.col("word"), folders))
    # a folder's blocks are dealt by range too, so that a common word's are many files; blocks are
    # made where they are written, so postings move once
    dealt = dealt.withColumn("file", F.floor(F.col("range") / FILE_RANGES)).repartition("folder", "file")
    blocks = dealt.groupBy("folder", "file", "word", "range").agg(  # at most about range_docs entries each
        F.count(F.lit(1)).alias("docs"), F.max(F.size("at")).alias("most"),
        F.sort_array(F.collect_list(F.struct("id", "at"))).alias("entries"),
    )
    laid = blocks.drop("file").sortWithinPartitions("folder", "word", "range")
    laid.write.mode("overwrite").partitionBy("folder").parquet(f"{path}/blocks")
    facts = [(analyser, folders, ranges, n, kind)]
    spark.createDataFrame(facts, "analyser string, folders int, ranges int, docs long, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    return TextIndex(spark, path)


def _folder(word: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(folders)).cast("int")


#: A conjunction: numbers of the words that an extent must hold, (wanted, numbers of the words of a
#: phrase) for each part, and (query, times that it says so).
Rule = tuple[list[int], list[tuple[bool, list[int]]], list[tuple[int, int]]]


class _Range:
    """The postings of one range: for each word, sorted numbers of document << 32 | position."""

    def __init__(self, blocks: pa.Table, numbers: dict[str, int]) -> None:
        entries = blocks["entries"].combine_chunks()
        flat = entries.flatten()
        at = flat.field("at")
        sizes = np.asarray(pc.list_value_length(at), dtype=np.int64)
        self.ids, doc = np.unique(ids_of(flat.field("id")), return_inverse=True)
        place = (np.repeat(doc.astype(np.int64), sizes) << 32) | np.asarray(at.flatten(), dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(entries), dtype=np.int64))])]
        self.places: dict[int, np.ndarray] = {}
        for row, word in enumerate(blocks["word"].to_pylist()):
            own = place[ends[row] : ends[row + 1]]
            self.places[numbers[word]] = own if (np.diff(own) > 0).all() else np.unique(own)  # ids that repeat

    def of(self, word: int) -> np.ndarray:
        return self.places.get(word, np.zeros(0, np.int64))

    def holding(self, words: list[int]) -> np.ndarray:
        """Whether each document has the words one behind another."""
        rare = min(range(len(words)), key=lambda i: len(self.of(words[i])))
        start = self.of(words[rare]) - rare
        for i, word in enumerate(words):
            if i != rare and len(start):
                other = self.of(word)
                at = np.searchsorted(other, start + i)
                start = start[other[np.minimum(at, len(other) - 1)] == start + i] if len(other) else other
        found = np.zeros(len(self.ids), bool)
        found[start >> 32] = True
        return found

    def scored(self, needed: list[int], parts: list[tuple[bool, list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """The documents for which a conjunction holds, and their cover density."""
        good = np.ones(len(self.ids), bool)
        for wanted, words in sorted(parts, key=lambda p: -len(p[1])):
            good &= self.holding(words) == wanted
            if not good.any():
                return np.zeros(0, np.int64), np.zeros(0)
        own = [(p := self.of(word))[good[p >> 32]] for word in needed]
        if len(own) == 1:
            total = keyword.WEIGHT * np.bincount(own[0] >> 32, minlength=len(good))
        else:
            merged = np.concatenate(own)
            order = np.argsort(merged, kind="stable")
            merged, word = merged[order], np.repeat(np.arange(len(own)), [len(p) for p in own])[order]
            row, doc, at = np.arange(len(merged)), merged >> 32, merged & 0xFFFFFFFF
            # an extent ends where the earliest last place of any word moves on; it starts at that place
            left = np.minimum.reduce([np.maximum.accumulate(np.where(word == k, row, -1)) for k in range(len(own))])
            closes = np.flatnonzero((left > np.concatenate([[-1], left[:-1]])) & (left >= np.searchsorted(doc, doc)))
            first = left[closes]
            noise = np.maximum(at[closes] - at[first] - (closes - first), 0)
            total = np.bincount(doc[closes], keyword.WEIGHT / (1 + noise), minlength=len(good))
        found = np.flatnonzero(total)
        return found, total[found]

    def best(self, rules: list[Rule], asked: list[int], n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids of its n best documents, their scores), for the asked queries."""
        of: dict[int, list[int]] = {}
        for k, rule in enumerate(rules):
            for query, _ in rule[2]:
                of.setdefault(query, []).append(k)
        step = max(1, BLOCK_SCORES // max(1, len(self.ids)))
        for begin in range(0, len(asked), step):
            line = {query: i for i, query in enumerate(asked[begin : begin + step])}
            scores = np.zeros((len(line), len(self.ids)))
            for k in sorted({k for query in line for k in of.get(query, ())}):
                docs, score = self.scored(*rules[k][:2])
                for query, times in rules[k][2] if len(docs) else ():
                    if query in line:
                        scores[line[query], docs] += times * score
            for query, i in line.items():
                docs = np.flatnonzero(scores[i])
                score = scores[i, docs]
                if len(docs) > n:
                    near = score >= np.partition(score, -n)[-n] - 2 * ROOM
                    docs, score = docs[near], score[near]
                score = _rounded(score)
                order = np.lexsort((docs, -score))[:n]
                yield query, self.ids[docs[order]], score[order]


def _rounded(x: np.ndarray) -> np.ndarray:
    """x to six digits as round() of SQL does it: halves of its shortest decimal form go up."""
    big = x * 1e6
    out = np.floor(big + 0.5) / 1e6
    for i in np.flatnonzero(np.abs(big % 1 - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


@dataclass
class TextIndex:
    """An index that build() wrote."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        about = self.spark.read.parquet(f"{self.path}/about").first()
        self.split, self.folders, self.ranges, self.docs, self.kind = ANALYSERS[about[0]], *about[1:]

    def blocks(self, words: set[str]) -> DataFrame:
        """The blocks of the given words; other folders are not read, nor other row groups' pages
        where words are few."""
        schema = f"word string, range int, docs long, most int, entries {ENTRIES.format(id=self.kind)}, folder int"
        table = self.spark.read.schema(schema).parquet(f"{self.path}/blocks") if self.docs else self.spark.createDataFrame([], schema)
        wanted = F.broadcast(self.spark.createDataFrame([(w,) for w in sorted(words)], "word string"))
        hashes = wanted.select(_folder(F.col("word"), self.folders)).distinct().collect()  # at most MOST_FOLDERS
        low, high = (min(words), max(words)) if words else ("", "")
        return table.where(F.col("folder").isin([r[0] for r in hashes]) & F.col("word").between(low, high)).drop("folder").join(wanted, "word", "left_semi")

    def frequencies(self, words: set[str]) -> DataFrame:
        """(word, docs): in how many documents each word is."""
        return self.blocks(words).groupBy("word").agg(F.sum("docs").alias("docs"))

    def search(self, queries: DataFrame, n: int) -> DataFrame:
        """(query_id, id, score, rank): the n best documents of each query, as ranked_top() of
        plans.keyword finds them over the texts."""
        found = None
        for part in slices_of(queries, "query_id", MOST_QUERIES):
            rows = self._slice(part, n)
            found = rows if found is None else found.unionByName(rows)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= n)

    def _slice(self, queries: DataFrame, n: int) -> DataFrame:
        asked = queries.select("query_id", "query").toArrow()  # at most MOST_QUERIES
        found: dict[tuple, dict[int, int]] = {}
        ids: dict = {}
        for query_id, query in zip(asked["query_id"].to_pylist(), asked["query"].to_pylist(), strict=True):
            for c in keyword.parse(query or "", self.split):
                owners, number = found.setdefault(tuple(c), {}), ids.setdefault(query_id, len(ids))
                owners[number] = owners.get(number, 0) + 1  # a query may say the same twice: that counts twice
        words: dict[str, int] = {}
        rules: list[Rule] = []
        for c, owners in found.items():
            parts = [(wanted, [words.setdefault(w, len(words)) for w in said]) for wanted, said in c]
            rules.append((sorted({w for wanted, said in parts if wanted for w in said}), parts, list(owners.items())))
        make, names = self.spark.createDataFrame, list(words)
        terms = make([(names[w], k) for k, rule in enumerate(rules) for w in rule[0]], "word string, conjunction int")
        sizes = make([(k, len(rule[0])) for k, rule in enumerate(rules)], "conjunction int, size int")
        owners = make([(k, query, times) for k, rule in enumerate(rules) for query, times in rule[2]], "conjunction int, query int, times int")

        heads = self.blocks(set(words)).select("word", "range", "most").join(F.broadcast(terms), "word")
        able = (
            heads.groupBy("conjunction", "range").agg(F.count(F.lit(1)).alias("n"), (keyword.WEIGHT * F.sum("most")).alias("bound"))
            .join(F.broadcast(sizes), "conjunction").where("n = size").select("conjunction", "range", "bound")
        )
        bounds = able.join(F.broadcast(owners), "conjunction").groupBy("query", "range").agg(F.sum(F.col("bound") * F.col("times")).alias("bound"))
        order = Window.partitionBy("query").orderBy(F.desc("bound"), "range")  # a row a range
        bounds = durable(bounds.withColumn("place", F.row_number().over(order)))
        first = durable(self._evaluated(bounds.where(F.col("place") <= FIRST_RANGES), words, rules, n))
        best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        beat = first.withColumn("place", F.row_number().over(best)).where(F.col("place") == n).select("query", F.col("score").alias("beat"))
        left = bounds.where(F.col("place") > FIRST_RANGES).join(beat, "query", "left")
        left = durable(left.where(F.col("beat").isNull() | (F.col("bound") >= F.col("beat") - ROOM)))
        rows = first if left.isEmpty() else first.unionByName(self._evaluated(left, words, rules, n))
        known = make([(number, query_id) for query_id, number in ids.items()], f"query int, query_id {queries.schema['query_id'].dataType.simpleString()}")
        return rows.join(F.broadcast(known), "query").select("query_id", "id", "score")

    def _evaluated(self, asked: DataFrame, words: dict[str, int], rules: list[Rule], n: int) -> DataFrame:
        """(query, id, score): the n best documents of each asked range (query, range)."""
        mine = {r[0] for r in asked.select("query").distinct().collect()}  # at most MOST_QUERIES
        rules = [(needed, parts, own) for needed, parts, owners in rules if (own := [x for x in owners if x[0] in mine])]
        used = {w for _, parts, _ in rules for _, said in parts for w in said}
        numbers = {w: k for w, k in words.items() if k in used}
        kind = self.kind

        def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
            found = list(_Range(blocks, numbers).best(rules, queries["query"].to_pylist(), n)) if len(blocks) and len(queries) else []
            ids = blocks["entries"].combine_chunks().flatten().field("id")
            if not found:
                return pa.table({"query": pa.array([], pa.int32()), "id": pa.array([], ids.type), "score": pa.array([], pa.float64())})
            return pa.table({
                "query": pa.array(np.repeat([q for q, _, _ in found], [len(d) for _, d, _ in found]), pa.int32()),
                "id": pa.array(np.concatenate([d for _, d, _ in found]), ids.type),
                "score": pa.array(np.concatenate([s for _, _, s in found]), pa.float64()),
            })

        ranges = F.broadcast(asked.select("range").distinct())
        blocks = self.blocks(set(numbers)).select("word", "range", "entries").join(ranges, "range", "left_semi")
        return blocks.groupBy("range").cogroup(asked.select("query", "range").groupBy("range")).applyInArrow(run, f"query int, id {kind}, score double")
