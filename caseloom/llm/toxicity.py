"""Toxicity of whole texts by a convolutional classifier trained in numpy.

Words are lower-cased runs of letters and digits.  Each word has the sum of two hashed
embeddings, of the word and of its first bytes, each from a table of 2**BUCKET_BITS buckets; words
of one bucket share its embedding, and buckets met in fewer than LEAST_DOCS training texts have
none (a zero).  Filters of widths 1, 2 and 3 slide over them, the
maximum of each filter over the whole text goes through a rectifier into a logistic output.
Thresholds are calibrated for each language on a part of the training rows that the weights have
not seen.  The language is that whose common words are most frequent in the text: it is read
from the text alone.  A text's score is the logistic of its distance to its language's threshold,
so 0.5 is the threshold for every language.

Fitting uses a bounded sample of labelled rows (SAMPLE_ROWS of each label at most, SAMPLE_BYTES of
text in all), drawn by a hash of doc_id.  The model has a bounded size and is broadcast; scoring
reads every word of every text, in segments, so long texts need no more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm import textcore
from caseloom.llm.runtime import durable

#: Bounds of the training sample.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 48 << 20
#: Buckets of a hash table, and the texts that a bucket must occur in to be trained.
BUCKET_BITS, LEAST_DOCS = 20, 3
PREFIX = 6
DIM, FILTERS, WIDTHS = 8, 6, (1, 2, 3)
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.02, 1e-4
#: A label may be wrong: targets are kept this far from 0 and 1.
SMOOTH = 0.05
#: The most common words of each language.
COMMON = {
    "en": "the of and to in is it that for was with be by are on this from",
    "fr": "le la les de des du et est une que qui dans pour pas sur par au avec",
    "de": "der die das und den von zu mit sich des auf für ist nicht ein eine dem",
    "es": "el los las del que y en por con para una su al se lo como más",
}


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


@dataclass
class Model:
    words: np.ndarray  # row of each bucket of words in embed, 0 for none
    heads: np.ndarray  # the same for first bytes
    embed: np.ndarray  # row 0 is zero
    kernels: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    common: dict[str, np.ndarray]
    thresholds: dict[str, float]

    # --- forward ------------------------------------------------------------------------

    def tables(self) -> list[list[np.ndarray]]:
        """embed @ kernel for each width and place: a convolution is then a sum of look-ups."""
        return [[np.ascontiguousarray(self.embed @ k[j]).astype(np.float32) for j in range(len(k))] for k in self.kernels]

    def pooled(self, tables, w: np.ndarray, h: np.ndarray, offsets: np.ndarray, places: int | None = None) -> np.ndarray:
        """Maximum of each filter over each text: (texts, all filters).

        places: of a part of a text, so many places at which a filter starts; the words after them
        belong to the filters of the last ones only.
        """
        n = np.diff(offsets)
        out = np.zeros((len(n), FILTERS * len(WIDTHS)), dtype=np.float32)
        owner = np.flatnonzero(n > 0)
        if not len(owner):
            return out
        starts = offsets[:-1][owner]
        left = np.repeat(offsets[1:][owner], n[owner]) - np.arange(offsets[-1])
        for i, parts in enumerate(tables):
            z = parts[0][w] + parts[0][h]
            for j in range(1, len(parts)):
                z[: len(z) - j] += np.where((left > j)[: len(z) - j, None], parts[j][w[j:]] + parts[j][h[j:]], 0)
            out[owner, i * FILTERS : (i + 1) * FILTERS] = np.maximum.reduceat(z[:places], starts, axis=0)
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + np.concatenate(self.bias), 0) @ self.out + self.out_bias

    def languages(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Index of each text's language; the first language for texts without common words."""
        votes = []
        for table in self.common.values():
            hits = np.concatenate([[0], np.cumsum(np.isin(words, table))])
            votes.append(hits[offsets[1:]] - hits[offsets[:-1]])
        return np.argmax(np.array(votes), axis=0)


def _encode(texts: list[str]) -> list[bytes]:
    return [t.lower().encode() for t in texts]


def _hash_words(words: str) -> np.ndarray:
    return np.unique(textcore.word_hashes(words.encode(), alnum=True)[0])


# --- fitting ----------------------------------------------------------------------------


def _trained(per_text: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in LEAST_DOCS texts or more, with their log-odds of the label."""
    n, pos = (np.zeros(1 << BUCKET_BITS) for _ in range(2))
    for found, y in zip(per_text, labels, strict=True):
        seen = np.unique(found)
        n[seen] += 1
        pos[seen] += y
    keep = np.flatnonzero(n >= LEAST_DOCS)
    n, pos = n[keep], pos[keep]
    ratio = np.log((pos + 0.5) / (labels.sum() + 1.0)) - np.log((n - pos + 0.5) / ((1 - labels).sum() + 1.0))
    return keep, ratio


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """A model of whole texts; with one label only, one that gives every text that label."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=float)
    part = rng.permutation(len(texts))
    n_held = len(texts) // 5
    held, train = part[:n_held], part[n_held:]
    kept = set(held.tolist())
    # buckets of a batch are one array of four bytes a word, later overwritten by rows of the table, and
    # the texts' words are views of it; hashes stay for the texts that calibrate languages only
    hashes: dict[int, np.ndarray] = {}
    words, heads, batches = [], [], []
    for _, _, w, offsets, h in textcore.batch_word_hashes(_encode(texts), PREFIX, alnum=True):
        own = [buckets(x).astype(np.int32) for x in (w, h)]
        batches.append(own)
        for i in range(len(offsets) - 1):
            if len(words) in kept:
                hashes[len(words)] = w[offsets[i] : offsets[i + 1]].copy()
            words.append(own[0][offsets[i] : offsets[i + 1]])
            heads.append(own[1][offsets[i] : offsets[i + 1]])
        w = h = None  # the last batch's would stay
    embed = [np.zeros((1, DIM))]
    row_of = []
    for dim, found in enumerate((words, heads)):
        known, odds = _trained([found[i] for i in train], y[train])
        rows = np.zeros(1 << BUCKET_BITS, np.int32)
        rows[known] = sum(map(len, embed)) + np.arange(len(known))
        row_of.append(rows)
        made = rng.normal(0, 0.02, (len(known), DIM))
        made[:, dim] = np.clip(odds, -3, 3) / 3  # the first two dimensions start at the shrunken log-odds
        embed.append(made)
    kernels = [rng.normal(0, 0.1, (k, DIM, FILTERS)) for k in WIDTHS]
    for k in kernels:
        k[:, 0] += 1.0 / len(k)
        k[:, 1] += 1.0 / len(k)
    bias = [np.full(FILTERS, -0.3) for _ in WIDTHS]
    out = np.full(FILTERS * len(WIDTHS), 0.3)
    common = {lang: _hash_words(w) for lang, w in COMMON.items()}
    model = Model(*row_of, np.concatenate(embed), kernels, bias, out, -1.0, common, dict.fromkeys(COMMON, 0.0))
    if len(set(labels)) < 2 or len(train) < 2:
        model.out[:] = 0
        model.out_bias = 4.0 if labels and labels[0] else -4.0
        return model
    for w, h in batches:
        w[:], h[:] = model.words[w], model.heads[h]
    _train(model, words, heads, y, train, rng)
    _calibrate(model, hashes, words, heads, y, held)
    return model


def _forward_one(model: Model, w: np.ndarray, h: np.ndarray):
    """Maxima of the filters over one text, with the positions that give them."""
    x = model.embed[w] + model.embed[h]
    best, where = [], []
    for k in model.kernels:
        z = x @ k[0]
        for j in range(1, len(k)):
            z[: len(x) - j] += x[j:] @ k[j]
        at = z.argmax(axis=0)
        where.append(at)
        best.append(z[at, np.arange(FILTERS)])
    return x, best, where


def _train(model: Model, w_slots, h_slots, y, train, rng) -> None:
    """Adam on the mean logistic loss of balanced classes; embeddings get the gradient of the
    positions that give a maximum."""
    n_pos = max(1.0, y[train].sum())
    cost = np.where(y == 1, len(train) / (2 * n_pos), len(train) / (2 * max(1.0, len(train) - n_pos)))
    dense = [*model.kernels, *model.bias, model.out, np.array([model.out_bias])]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in dense]
    e_mean, e_var = np.zeros_like(model.embed), np.zeros_like(model.embed)
    step = 0
    n_w = len(WIDTHS)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(train)
        for start in range(0, len(order), BATCH):
            step += 1
            grads = [np.zeros_like(p) for p in dense]
            e_rows: list[np.ndarray] = []
            e_grad: list[np.ndarray] = []
            chosen = order[start : start + BATCH]
            for i in chosen:
                w, h = w_slots[i], h_slots[i]
                if not len(w):
                    hidden = np.maximum(np.concatenate(model.bias), 0)
                else:
                    x, best, where = _forward_one(model, w, h)
                    hidden = np.maximum(np.concatenate(best) + np.concatenate(model.bias), 0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + dense[-1][0], -30, 30)))
                target = SMOOTH + (1 - 2 * SMOOTH) * y[i]
                d = (p - target) * cost[i] / len(chosen)
                grads[2 * n_w] += d * hidden
                grads[-1][0] += d
                back = d * model.out * (hidden > 0)
                for a in range(n_w):
                    g = back[a * FILTERS : (a + 1) * FILTERS]
                    grads[n_w + a] += g
                    if not len(w) or not g.any():
                        continue
                    k = model.kernels[a]
                    for j in range(len(k)):
                        at = where[a] + j
                        fits = at < len(w)
                        if not fits.any():
                            continue
                        at, gf = at[fits], g[fits]
                        grads[a][j][:, fits] += x[at].T * gf
                        dx = k[j][:, fits].T * gf[:, None]
                        e_rows += [w[at], h[at]]
                        e_grad += [dx, dx]
            for p, g, (m1, m2) in zip(dense, grads, moment, strict=True):
                g = g + DECAY * p
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
            model.out_bias = float(dense[-1][0])
            if e_rows:
                rows, inverse = np.unique(np.concatenate(e_rows), return_inverse=True)
                g = np.zeros((len(rows), DIM))
                np.add.at(g, inverse, np.concatenate(e_grad))
                g += DECAY * model.embed[rows]
                e_mean[rows] += 0.1 * (g - e_mean[rows])
                e_var[rows] += 0.01 * (g * g - e_var[rows])
                model.embed[rows] -= rate * 0.5 * e_mean[rows] / (np.sqrt(e_var[rows]) + 1e-6)
                model.embed[0] = 0


def _calibrate(model: Model, words, w_slots, h_slots, y, held) -> None:
    """For each language the threshold with the best F1 on the held rows; languages with few
    rows of a label take that of all rows."""
    if not len(held):
        return
    logit, lang = np.zeros(len(held)), np.zeros(len(held), dtype=int)
    for n, i in enumerate(held):
        if len(w_slots[i]):
            _, best, _ = _forward_one(model, w_slots[i], h_slots[i])
            pooled = np.concatenate(best)[None]
        else:
            pooled = np.zeros((1, FILTERS * len(WIDTHS)))
        logit[n] = model.logits(pooled)[0]
        lang[n] = model.languages(words[i], np.array([0, len(words[i])]))[0]
    everyone = _best_threshold(logit, y[held], 0.0)
    for code, name in enumerate(model.thresholds):
        mine = lang == code
        good, bad = (y[held][mine] == 1).sum(), (y[held][mine] == 0).sum()
        model.thresholds[name] = _best_threshold(logit[mine], y[held][mine], everyone) if min(good, bad) >= 20 else everyone


def _best_threshold(logit: np.ndarray, y: np.ndarray, fallback: float) -> float:
    """Middle of the widest gap among the thresholds of best F1."""
    if not len(y) or not y.any() or y.all():
        return fallback
    order = np.argsort(logit, kind="stable")
    s, t = logit[order], y[order]
    hit = t.sum() - np.concatenate([[0], np.cumsum(t)[:-1]])
    taken = len(t) - np.arange(len(t))
    f1 = 2 * hit / (taken + t.sum())
    gaps = np.diff(s, prepend=s[0] - 1.0)
    f1 = np.where(gaps > 1e-9, f1, -1.0)
    close = np.flatnonzero(f1 >= f1.max() - 0.002)
    at = close[np.argmax(gaps[close])]
    return float(s[at] - gaps[at] / 2)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """Texts and labels of at most `rows` documents of each label with crc32(doc_id) mod 5
    other than 0, in order of a hash of doc_id, until their texts reach `size` bytes."""
    known = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    chosen = None
    for value in (0, 1):
        some = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = some if chosen is None else chosen.union(some)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    # at most 2 * rows ids are broadcast and as many texts gathered
    found = durable(texts.join(F.broadcast(chosen), "doc_id"))
    x, y, total, seen = [], [], 0, set()
    for row in found.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        if row["doc_id"] in seen:
            continue
        seen.add(row["doc_id"])
        text = row["text"] or ""
        total += len(text.encode())
        if total > size and x:
            break
        x.append(text)
        y.append(row["toxic"])
    return x, y


def held_out(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


class Scorer:
    """Scores of texts by a model, whose look-up tables are made once."""

    def __init__(self, model: Model) -> None:
        self.model, self.tables = model, model.tables()
        self.limits = np.array(list(model.thresholds.values()))

    def pooled(self, words: np.ndarray, heads: np.ndarray, offsets: np.ndarray, places: int | None = None) -> np.ndarray:
        m = self.model
        return m.pooled(self.tables, m.words[buckets(words)], m.heads[buckets(heads)], offsets, places)

    def __call__(self, texts: list[str]) -> np.ndarray:
        m = self.model
        out = np.zeros(len(texts))
        empty = m.logits(np.zeros((1, FILTERS * len(WIDTHS))))[0]
        for first, last, words, offsets, heads in textcore.batch_word_hashes(_encode(texts), PREFIX, alnum=True):
            if last - first == 1 and len(words) > LONG_WORDS:
                # segments overlap by the widest filter less one, so each window of words lies in one
                step, more = LONG_WORDS, max(WIDTHS) - 1
                cuts = [(a, min(len(words), a + step + more)) for a in range(0, len(words), step)]
                best = [self.pooled(words[a:b], heads[a:b], np.array([0, b - a]), step) for a, b in cuts]
                logit = m.logits(np.max(best, axis=0))
            else:
                logit = np.where(np.diff(offsets) > 0, m.logits(self.pooled(words, heads, offsets)), empty)
            logit = logit - self.limits[m.languages(words, offsets)]
            out[first:last] = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5).

    A null or empty text is scored as one without words.  Columns of these names in docs are
    replaced; all rows and other columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the buckets
    docs = docs.drop("score", "predicted")
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in textcore.slices(batches):
            out = scorer([t.as_py() or "" for t in batch.column(place).cast(pa.string())])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out), pa.array((out >= 0.5).astype(np.int32))],
                [*batch.schema.names, "score", "predicted"],
            )

    return docs.mapInArrow(
        run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", score double, predicted int"
    )


LONG_WORDS = 1 << 18


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs, by a model fitted on labels.

    held_out: crc32 of doc_id as text is divisible by 5; these rows' labels are never read.  A
    null id counts as held out.  Repeated rows get one row each and equal scores; an empty
    table gives no row; without labelled rows every score is that of a clean text.
    """
    model = fit(*training_rows(docs, labels))
    rows = docs.select(docs["doc_id"], docs["text"])
    return score(rows, model).select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(True)).alias("held_out"), "score", "predicted"
    )
