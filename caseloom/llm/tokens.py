"""Token counts of whole texts by a public tokenizer.

Method: overlap resynchronisation.  A text longer than one chunk is encoded in overlapping
chunks; two neighbours are spliced at a position that both chunks have as a token boundary and
that is proven stable.  An overlap without such a position is widened, in the end to the whole
chunk; a chunk without one is lengthened to the next one in the text.

A position is proven stable when the byte-level pre-tokenizer must open a piece there whatever
stands before, so that every scan of any chunk reads the same pieces from there on:

* a single blank between two characters other than white space: only the next piece takes it;
* any character but white space after a line break or tab: such a run never joins what follows;
* a mark after a letter: no piece with a letter goes on with a mark.

Letters and marks are taken from ranges that are such in every version of Unicode, so the rule
holds whatever version an engine has; scripts without blanks are spliced at their punctuation.
Positions within a special string, or at its start, are left out.

Byte-level BPE files are read from their own vocabulary and run by a second implementation of
the same merges, about seven times faster than the file's library and equal to it in results
(tests hold the two against each other).  Its pattern engine gives up on very long runs of white
space; such chunks run in the file's own library, as do other files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caseloom.llm.textcore import slices

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 10

#: Fixed value: the piece pattern of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters of common scripts, and marks of ASCII (but the apostrophe, which opens a
#: contraction) and of CJK and full-width punctuation.
_LETTERS = (
    "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u052f\u0531-\u0556"
    "\u0561-\u0586\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u0904-\u0939\u0e01-\u0e30\u10d0-\u10f0\u3041-\u3096\u30a1-\u30fa"
    "\u4e00-\u9fa5\uac00-\ud7a3"
)
_MARKS = r"!-&(-/:-@\[-`{-~" + "\u00a1\u00ab\u00bb\u00bf\u2010-\u2027\u3001-\u3003\u3008-\u3011\uff01-\uff0f\uff1a-\uff20"
_STABLE = re.compile(rf"(?<=\S) (?=\S)|(?<=[\n\r\t])(?=\S)|(?<=[{_LETTERS}])(?=[{_MARKS}])")


def _byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable Latin-1 stands for itself, the
    other bytes take code points from 256 on in ascending order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteLevelEncoder:
    """Ids of a byte-level BPE file, special strings in texts taken as special tokens."""

    splices = True

    def __init__(self, spec: dict, path: str) -> None:
        import tiktoken

        self._path = path
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = _byte_alphabet()
        ranks = {
            bytes(alphabet[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in special
        }
        self._tt = tiktoken.Encoding(
            "byte-level", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special
        )
        self.sizes = np.zeros(self._tt.max_token_value + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        for token, i in special.items():
            self.sizes[i] = len(token.encode())
        self._special = tuple(special)

    @staticmethod
    def fits(spec: dict) -> bool:
        """Whether the file is plain byte-level BPE whose ids follow the order of its merges."""
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            return False
        if not pre.get("use_regex", True) or model.get("type") != "BPE" or model.get("dropout"):
            return False
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            return False
        if model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            return False
        vocab = model["vocab"]
        merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [vocab[a + b] for a, b in merged]
        return all(x < y for x, y in zip(ids, ids[1:], strict=False))

    def encode(self, text: str) -> np.ndarray:
        try:
            if any(s in text for s in self._special):
                return np.asarray(
                    self._tt.encode(text, allowed_special="all", disallowed_special=()), np.uint32
                )
            return self._tt.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # a run that is too long for the pattern engine
            return _library(self._path).encode(text)

    def within_special(self, text: str, place: int) -> bool:
        """Whether place lies inside a special string of text or before one: white space in front
        of it is cut as at the end of a text, which a chunk that cuts the string does not see."""
        return any(text.find(s, max(0, place - len(s) + 1), place + len(s)) >= 0 for s in self._special)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token's end."""
        return np.cumsum(self.sizes[ids])


class LibraryEncoder:
    """Ids by the file's own library, each text in one piece."""

    splices = False

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda text: sp.encode(text, num_threads=1)
        else:
            from tokenizers import Tokenizer

            hf = Tokenizer.from_file(path)
            hf.no_truncation()
            hf.no_padding()
            self._encode = lambda text: hf.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self._encode(text), dtype=np.uint32)


@lru_cache(maxsize=2)
def _library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


@lru_cache(maxsize=4)
def encoder(path: str) -> ByteLevelEncoder | LibraryEncoder:
    """The encoder of a tokenizer file, kept by each Python worker."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if ByteLevelEncoder.fits(spec):
            return ByteLevelEncoder(spec, path)
    return LibraryEncoder(path)


def encode_pieces(
    enc: ByteLevelEncoder | LibraryEncoder,
    text: str,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> Iterator[np.ndarray]:
    """Ids of the whole text in order, in arrays of about one chunk each."""
    if not enc.splices or len(text) <= chunk:
        yield enc.encode(text)
        return
    start = 0
    end, at = _chunk_end(enc, text, 0, chunk, overlap)
    ids = enc.encode(text[:end])
    while end < len(text):
        later_end, later_at = _chunk_end(enc, text, at, end - at + chunk, overlap)
        later = enc.encode(text[at:later_end])
        cut = _common_boundary(enc, text, start, ids, at, end, later)
        if cut:
            place, n_ids, skip = cut
            yield ids[:n_ids]
            start, end, at, ids = place, later_end, max(later_at, place), later[skip:]
        elif at > start:
            at = max(start, end - 2 * (end - at))
        else:  # no place after the start: go on with the longer one
            end, at, ids = later_end, later_at, later
    yield ids


def _places(enc, text: str, first: int, stop: int) -> Iterator[int]:
    """Stable positions p with first < p and p + 1 < stop, in order."""
    for m in _STABLE.finditer(text, first + 1, stop):
        if m.start() + 1 < stop and not enc.within_special(text, m.start()):
            yield m.start()


def _chunk_end(enc, text: str, start: int, chunk: int, overlap: int) -> tuple[int, int]:
    """End of a chunk from start, and the start of an overlap before it with a stable position:
    the overlap is widened, then the chunk lengthened, until there is one."""
    end = min(len(text), start + chunk)
    if end == len(text):
        return end, end
    width = overlap
    while True:
        at = max(start, end - width)
        if next(_places(enc, text, at, end), None) is not None:
            return end, at
        if at == start:
            break
        width *= 2
    place = next(_places(enc, text, max(start, end - 2), len(text)), None)
    if place is None:
        return len(text), len(text)
    end = min(len(text), place + overlap + 2)
    return end, max(start, place - 1)


def _common_boundary(enc, text, start, ids, at, end, later):
    """Last stable position in text[at:end - 1] that both encodings have as a boundary, with
    the number of tokens before it in each; None if there is none."""
    places = list(_places(enc, text, at, end))
    if not places:
        return None
    ends, later_ends = enc.ends(ids), enc.ends(later)
    for place in reversed(places):
        left = len(text[start:place].encode())
        right = len(text[at:place].encode())
        i, j = np.searchsorted(ends, left), np.searchsorted(later_ends, right)
        if i < len(ends) and j < len(later_ends) and ends[i] == left and later_ends[j] == right:
            return place, i + 1, j + 1
    return None


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """One row (doc_id, n_bytes, n_tokens, over_limit) for each row of docs.

    A null text counts as empty: 0 bytes, 0 tokens.  Repeated rows and ties give one row each;
    an empty table gives none; other columns, also those named like results, are not read.
    over_limit: n_tokens > limit.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in slices(batches):
            sizes, tokens = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                sizes.append(len(text.encode()))
                tokens.append(sum(len(x) for x in encode_pieces(enc, text, chunk, overlap)))
            n = pa.array(tokens, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), n, pa.array([x > limit for x in tokens])],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(
        count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
