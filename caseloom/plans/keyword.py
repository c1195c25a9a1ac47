"""Full-text ranking: query grammar, English stems, and cover density.

Texts and queries are reduced to stems by a suffix stemmer after the published Porter rules with
stop words left out.  A query is a conjunction of words and "phrases", with `or` between
alternatives and a leading - for exclusion.  The rank is the cover density of Clarke et al.: each
shortest extent that holds all query words adds the mean weight over its length.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.operators.retrieval import MOST_QUERIES, slices_of
from caseloom.operators.topn import Best, best_rows, ids_of

#: English words without a rank.
STOP = frozenset(
    "a about above after again all am an and any are as at be because been before being below between both but by can did do does"
    " doing don down during each few for from further had has have having he her here hers him his how i if in into is it its just me"
    " more most my no nor not now of off on once only or other our out over own s same she should so some such t than that the their"
    " theirs them then there these they this those through to too under until up very was we were what when where which while who whom"
    " why will with you your".split()
)
_WORD = re.compile(r"[^\W_]+", re.U)
_VOWELS = "aeiouy"
WEIGHT = 0.1


def _measure(stem: str) -> int:
    """Number of vowel-consonant changes."""
    flags = [c in "aeiou" or (c == "y" and i > 0 and stem[i - 1] not in "aeiou") for i, c in enumerate(stem)]
    return sum(a and not b for a, b in zip(flags, flags[1:], strict=False))


def _has_vowel(stem: str) -> bool:
    return any(c in _VOWELS for c in stem)


def _short_end(stem: str) -> bool:
    """Whether stem ends in consonant, vowel, consonant, the last none of w, x, y."""
    return len(stem) > 2 and stem[-3] not in "aeiou" and stem[-2] in _VOWELS and stem[-1] not in "aeiouwxy"


#: Suffixes and what replaces them when the stem before has measure 1 or more.
_LONG = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "icate": "ic", "ative": "", "alize": "al", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "",
}
_LAST = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou",
)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and _has_vowel(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeioulsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for _ in range(2):
        for end in sorted(_LONG, key=len, reverse=True):
            if word.endswith(end):
                if _measure(word[: -len(end)]):
                    word = word[: -len(end)] + _LONG[end]
                break
    for end in _LAST:
        if word.endswith(end):
            base = word[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        measure = _measure(word[:-1])
        if measure > 1 or (measure == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def lexemes(text: str) -> list[tuple[str, int]]:
    """(stem, position) of the words that are no stop words; positions count all words."""
    return [(stem(w), n) for n, w in enumerate(_WORD.findall(text.lower()), 1) if w not in STOP]


def parse(query: str, split: Callable[[str], list[tuple[str, int]]] = lexemes) -> list[list[tuple[bool, tuple[str, ...]]]]:
    """Alternatives of conjunctions of (wanted, stems of a word or phrase), as split makes them."""
    out: list[list[tuple[bool, tuple[str, ...]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if word.lower() == "or" and not minus:
            out.append([])
            continue
        stems = tuple(s for s, _ in split(phrase or word))
        if stems:
            out[-1].append((not minus, stems))
    return [c for c in out if any(wanted for wanted, _ in c)]


def _places(index: dict[str, list[int]], stems: tuple[str, ...]) -> list[int]:
    first = index.get(stems[0], [])
    rest = [set(index.get(s, ())) for s in stems[1:]]
    return [p for p in first if all(p + i + 1 in r for i, r in enumerate(rest))]


def matches(conjunction, index: dict[str, list[int]]) -> bool:
    return all(bool(_places(index, stems)) == wanted for wanted, stems in conjunction)


def cover_density(index: dict[str, list[int]], stems: set[str]) -> float:
    """Sum over the shortest extents that hold all stems."""
    at = sorted((p, s) for s in stems for p in index.get(s, ()))
    count: dict[str, int] = {}
    left, total = 0, 0.0
    for right, (p, s) in enumerate(at):
        count[s] = count.get(s, 0) + 1
        if len(count) < len(stems):
            continue
        while count[at[left][1]] > 1:
            count[at[left][1]] -= 1
            left += 1
        noise = (p - at[left][0]) - (right - left)
        total += WEIGHT / (1 + max(noise, 0))
        del count[at[left][1]]
        left += 1
    return total


def ranked_top(chunks: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, id, score, rank): the n best chunks for each query.

    The parsed queries travel with the task, MOST_QUERIES at a time.  Equal conjunctions of all
    queries are one, found by its longest stem, so a chunk is stemmed once and meets only
    conjunctions that it may match.  An index (operators.text_index) spares the stemming.
    """
    found = None
    for part in slices_of(queries, "query_id", MOST_QUERIES):
        rows = _ranked_slice(chunks, part, n)
        found = rows if found is None else found.unionByName(rows)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n)


def _ranked_slice(chunks: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, id, score): each task's n best chunks of each query."""
    rows = queries.select("query_id", "query").toArrow()  # at most MOST_QUERIES
    names = rows["query_id"].combine_chunks()
    asked: dict[tuple, list[int]] = {}
    for number, query in enumerate(rows["query"].to_pylist()):
        for c in parse(query or ""):
            asked.setdefault(tuple(c), []).append(number)
    by_stem: dict[str, list[tuple[tuple, set[str], np.ndarray]]] = {}
    for c, owners in asked.items():
        stems = {s for wanted, found in c if wanted for s in found}
        by_stem.setdefault(max(stems, key=lambda s: (len(s), s)), []).append((c, stems, np.array(owners)))

    def fill(best: Best, batch: pa.RecordBatch) -> None:
        ids = ids_of(batch.column(0))
        for row, text in enumerate(batch.column(1)):
            index: dict[str, list[int]] = {}
            for s, p in lexemes(text.as_py() or ""):
                index.setdefault(s, []).append(p)
            owner, score = [], []
            for s in index.keys() & by_stem.keys():
                for c, stems, owners in by_stem[s]:
                    if matches(c, index):
                        owner.append(owners)
                        score.append(np.full(len(owners), cover_density(index, stems)))
            if owner:
                found, at = np.unique(np.concatenate(owner), return_inverse=True)
                best.add(found, np.repeat(ids[row : row + 1], len(found)), np.round(np.bincount(at, np.concatenate(score)), 6))

    return best_rows(chunks.select("id", "content"), names, "score", n, "double", fill)
