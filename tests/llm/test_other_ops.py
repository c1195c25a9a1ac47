from __future__ import annotations

import math
import os
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from caseloom.llm import embedding_dedup, html_text, mixing, toxicity

# --- html -------------------------------------------------------------------------------

PROSE = "This is a paragraph of the article and it has many of the words that are in all of the texts."
PAGE = f"""<html><head><title>Not me</title><style>p{{}}</style></head><body><header class="top"><h1>Site</h1></header>
<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><script>var x = "<p>no</p>";</script><!-- gone -->
<div class="cookie-notice"><p>{PROSE}</p></div><div id="sidebar">{PROSE}</div><article><h2>A title</h2><p><b>{PROSE}<br>Tom &amp; J&eacute;r&#244;me&nbsp;x
<p>Short.</p><div class="ad">{PROSE}</div><ul><li>{PROSE}</ul><form><p>{PROSE}</p><input></form></article>
<div class="comments"><p>{PROSE}</p></div><footer>&copy; me</footer></body></html>"""


def test_main_text_with_an_article():
    assert html_text.main_text(PAGE) == f"A title {PROSE} Tom & Jérôme x Short. {PROSE}"


def test_main_text_without_an_article():
    page = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    got = html_text.main_text(page)
    assert got.count(PROSE) == 2 and "Tom & Jérôme" in got and "Short." in got
    for word in ("Site", "One", "var x", "gone", "©", "Not me"):
        assert word not in got


@pytest.mark.parametrize("html", [None, "", "<p>", "<<<>>", "<a", "plain words only", "<div" + " x" * 50000, "<b>" * 20000, "<!-- open", "<script>open"])
def test_odd_pages_do_not_fail(html):
    assert isinstance(html_text.main_text(html), str)


@pytest.mark.parametrize(
    "title", ["title=it's", "title=5\"x", "title='a > b'", 'title="<b>"', "title = it's x", "disabled/", 'data-x="never closed'],
)
def test_quotes_in_attributes_lose_no_text(title):
    page = f"<article><p {title}>{PROSE} 1</p><p>{PROSE} 2</p><p>{PROSE} 3</p></article>"
    assert html_text.main_text(page) == f"{PROSE} 1 {PROSE} 2 {PROSE} 3"


@pytest.mark.parametrize("part", ['<a href="', "<a title='x ", "<b", "</a", "<!-- ", "<![CDATA[", "<x-y>", "<p title=it's>a<p>", "<div><p>", '<a b="c> ', "&lt;<"])
def test_time_grows_with_the_page(part):
    def seconds(n):
        start = time.perf_counter()
        html_text.main_text(part * (n // len(part)))
        return time.perf_counter() - start

    assert min(seconds(1 << 20) for _ in range(2)) < 4


def test_languages_without_listed_stop_words():
    russian = "Это длинный абзац статьи на языке, слов которого нет в списках, и он всё равно часть текста страницы."
    chinese = "这是一篇文章的段落，它的语言没有列在停用词表中，但它仍然是页面正文的一部分，所以不应该丢失。"
    polish = "To jest długi akapit artykułu napisanego w języku, którego wyrazów nie ma na żadnej z list, a jednak należy do tekstu."
    menu = "<ul>" + "".join(f"<li><a href=/{i}>{w}</a></li>" for i, w in enumerate(russian.split())) + "</ul>"
    for prose in (russian, chinese, polish):
        page = f"<body><div>{menu}<p>{prose}</p><p>{prose} {prose}</p></div><div class=footer>{prose}</div></body>"
        assert html_text.main_text(page) == f"{prose} {prose} {prose}"


@pytest.mark.parametrize("name", ["form-of-government", "comment-on-text", "history of-the-search-form-x", "formation", "notices-board-history"])
def test_titles_as_names_are_no_noise(name):
    assert html_text.main_text(f'<article><div class="{name}"><p>{PROSE}</p></div></article>') == PROSE


@pytest.mark.parametrize("name", ["ad", "AdBox2", "site-footer", "main-nav", "cookie-law-info", "comment-list", "social_media_icons", "newsletterSignup", "td-sidebar-wrap x"])
def test_names_of_other_parts_are_noise(name):
    assert html_text.main_text(f'<article><div class="{name}"><p>{PROSE} no</p></div><p>{PROSE}</p></article>') == PROSE


def test_elements_within_a_line():
    page = f"<article><p>{PROSE} Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math>, wo<font>r</font>ds, &am<b>p; A&amp;B <nobr>y</nobr><![CDATA[z]]>.</article>"
    assert html_text.main_text(page) == f"{PROSE} Let x=2, words, &amp; A&B y."


class Article(HTMLParser):
    """All text of <article>, by the library's parser: an independent version for the test pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.parts.append("\n" if tag in ("p", "h1", "h2", "br", "li") else "")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.parts.append("\n" if tag in ("p", "h1", "h2", "li") else "")

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_pages_equal_an_independent_parser():
    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are not here")
    hit = found = wanted = 0
    for page in pq.read_table(path)["html"].to_pylist():
        parser = Article()
        parser.feed(page)
        parser.close()
        want = " ".join("".join(parser.parts).split())
        assert html_text.main_text(page) == want
        bare = Counter(html_text.main_text(re.sub("</?article>", "", page)).split())  # without the hint of the element
        hit += sum((bare & Counter(want.split())).values())
        found, wanted = found + bare.total(), wanted + len(want.split())
    assert hit / found > 0.99 and hit / wanted > 0.95


def test_extract(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "v", "", "x"), (1, "u", PAGE, "x"), (None, "w", f"<main><p>{PROSE}</p></main>" * 300, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert sorted(len(r["text"]) == 0 for r in got) == [False, False, False, True, True]
    assert next(r for r in got if r["page_id"] is None)["text"].count("paragraph") == 300
    assert html_text.extract(df.limit(0)).count() == 0


SENTENCE = "It was not the end of the story that we had told to them on the way."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<main><article><p>{p}</p></article><article class='comment'><p>{p} I agree.</p></article></main>", "{p}"),
        ("<article><p>{p}</p></article><article id='comment-12'><p>{p}</p></article>", "{p}"),
        ("<article class='post comments-open'><p>{p}</p></article>", "{p}"),
        ("<article><div class='content-header'><p>{p}</p></div><p>{p}</p></article>", "{p} {p}"),
        ("<article><div class='red-alert'><p>{p}</p></div></article>", "{p}"),
        ("<article><section class='copyright law'><p>{p}</p></section></article>", "{p}"),
        ("<article><fieldset><p>{p}</p></fieldset><p>{p}</p></article>", "{p} {p}"),
        ("<article><p>{p}</p><div class='alert'>Sign up now</div><div class='newsletter-box'><p>{p}</p></div></article>", "{p}"),
        ("<article><p>{p}</p><div class='notice'><p>{p}</p></div><div class='ad'>{p}</div></article>", "{p}"),
        ("<body><h2>Title</h2><p>A short line it is.</p><p>And a second one here.</p><ul><li><a href=x>Home</a></ul></body>",
         "Title A short line it is. And a second one here."),
        ("<body><div class='menu'>Go to the next page.</div><p>Only this one counts.</p></body>", "Only this one counts."),
        ("<body><ul><li><a href=x>Go to it now.</a><li><a href=y>Come to us here.</a></ul></body>", ""),
    ],
)
def test_names_are_votes_within_articles(page, want):
    assert html_text.main_text(page.replace("{p}", SENTENCE)) == want.replace("{p}", SENTENCE)


def test_open_blocks_follow_their_neighbours():
    b = [html_text.Block(text=str(i)) for i in range(5)]
    assert html_text.second_pass(b, [1, 0, 0, 0, -1]) == [1, 1, -1, -1, -1]
    assert html_text.second_pass(b, [0, 0, 1, 0, 0]) == [1, 1, 1, 1, 1]
    assert html_text.second_pass(b, [0] * 5) == [-1] * 5


# --- mixing -----------------------------------------------------------------------------


def test_every_source_stays_within_one_block():
    rng = random.Random(3)
    for _ in range(60):
        blocks = {f"s{i}": rng.randint(1, 60) for i in range(rng.randint(1, 12))}
        weights = {s: rng.random() + 0.01 for s in blocks}
        order = mixing.edf_order(blocks, weights)
        assert sorted((s, b) for s, b, _ in order) == sorted((s, b) for s, n in blocks.items() for b in range(n))
        parts = mixing.integer_weights(weights)
        done, base, phase, slot = dict.fromkeys(blocks, 0), dict.fromkeys(blocks, 0), 0, 0
        for s, _, p in order:
            if p != phase:
                phase, base, slot = p, dict(done), 0
            active = [x for x in blocks if base[x] < blocks[x]]
            total = sum(parts[x] for x in active)
            done[s] += 1
            slot += 1
            for x in active:
                assert abs(done[x] - base[x] - Fraction(parts[x] * slot, total)) < 1


def plain_schedule(blocks, parts):
    """(source, block, phase) by slot: a second scheduler that looks at every source in every slot."""
    left = {s: n for s, n in blocks.items() if n}
    done, out, phase = dict.fromkeys(left, 0), [], 0
    while left:
        total, base, slot = sum(parts[s] for s in left), dict(done), 0
        while all(left.values()):
            best = None
            for s in sorted(left):
                j = done[s] - base[s] + 1
                if (j - 1) * total // parts[s] <= slot:
                    rank = (-(-j * total // parts[s]), -parts[s])
                    best = min(best or (rank, s), (rank, s))
            s = best[1]
            out.append((s, done[s], phase))
            done[s] += 1
            left[s] -= 1
            slot += 1
        left = {s: n for s, n in left.items() if n}
        phase += 1
    return out


def test_periods_equal_a_plain_scheduler(monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(mixing, "LEAST_PARTS", 1)
    for most in (7, 40, 1000):  # the last has periods longer than any phase
        monkeypatch.setattr(mixing, "MOST_PARTS", most)
        for _ in range(40):
            blocks = {f"s{i}": rng.randint(0, 90) for i in range(rng.randint(1, 7))}
            weights = {s: rng.random() + 0.01 for s in blocks}
            assert mixing.edf_order(blocks, weights) == plain_schedule(blocks, mixing.integer_weights(weights))


@pytest.mark.parametrize("most", [9, 1 << 16])
def test_mix_equals_a_plain_scheduler(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "LEAST_PARTS", 1)
    monkeypatch.setattr(mixing, "MOST_PARTS", most)
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 50)
    sizes, weights, block = {"a": 700, "b": 333, "c": 41, "": 120}, {"a": 2.0, "b": 3.0, "c": 1.0}, 4
    rows = [(n, f"text {n}", s or None) for n, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights, block).collect()
    order = plain_schedule({s: -(-n // block) for s, n in sizes.items()}, mixing.integer_weights({**weights, "": 1.0}))
    at, want = 0, {}
    for slot, (s, b, phase) in enumerate(order):
        want[s, b] = (slot, phase, at)
        at += min(block, sizes[s] - b * block)
    seen = {}
    for r in got:
        assert (r["mix_slot"], r["mix_phase"]) == want[r["mix_source"], r["mix_block"]][:2]
        seen.setdefault((r["mix_source"], r["mix_block"]), []).append(r["mix_position"])
    assert all(sorted(p) == list(range(want[k][2], want[k][2] + len(p))) for k, p in seen.items()) and len(seen) == len(order)


def test_blocks_do_not_grow_with_the_table():
    """Two thousand million blocks: the plan has one period a phase."""
    blocks = {f"s{i}": 10**8 + i * 10**7 for i in range(20)}
    phases = mixing.schedule(blocks, dict.fromkeys(blocks, 1.0) | {"s0": 7.5})
    assert sum(p.slots for p in phases) == sum(blocks.values()) and sum(len(p.period) for p in phases) <= 2 * mixing.PLAN_SLOTS
    assert all(a.start + a.slots == b.start for a, b in zip(phases, phases[1:], strict=False))


def test_many_sources_are_grouped(spark):
    rows = [(i, f"t{i}", f"s{min(i % 60, i % 7)}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in (None, {"s0": 3.0, "s9": 1.0}):
        got = mixing.mix(df, weights, block_docs=4, most_sources=5, in_order=True).collect()
        assert [r["mix_position"] for r in got] == list(range(1200)) and {r["doc_id"] for r in got} == set(range(1200))
        assert sum(not r["mix_source"].startswith("s") for r in got) > 0
        assert len({r["mix_source"] for r in got if r["mix_source"].startswith("s")}) == 5


def test_mix_keeps_all_rows(spark):
    rows = [(i, f"t{i}", "big" if i % 3 else f"s{i % 12}", i) for i in range(900)] + [(7, "t7", "big", 7), (None, None, None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_slot long")
    got = mixing.mix(df, block_docs=8).collect()
    assert sorted(r["mix_position"] for r in got) == list(range(len(rows)))
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    slots = {}
    for r in got:
        slots.setdefault(r["mix_slot"], set()).add(r["mix_source"])
    assert all(len(s) == 1 for s in slots.values())
    again = mixing.mix(df, block_docs=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.exceptAll(df).count() == 0 and mixed.count() == len(rows)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_follows_given_weights(spark):
    df = spark.createDataFrame([(i, "t", "a" if i < 300 else "b") for i in range(600)], "doc_id long, text string, source string")
    got = sorted(mixing.mix(df, {"a": 3.0, "b": 1.0}, block_docs=4).collect(), key=lambda r: r["mix_position"])
    first = [r["source"] for r in got[:320]]
    assert abs(first.count("a") - 240) <= 4


# --- embeddings -------------------------------------------------------------------------


def brute(rows, limit=0.93):
    ok = {}
    for n, (i, v, label) in enumerate(rows):
        if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[n] = np.array(v, float) / np.linalg.norm(v)
    links, parent = dict.fromkeys(range(len(rows)), 0), {n: n for n in range(len(rows))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= limit:
                links[a] += 1
                links[b] += 1
                parent[root(b)] = root(a)
    ids = {}
    for n, (i, _, _) in enumerate(rows):
        if i is not None:
            ids.setdefault(root(n), []).append(i)
    return sorted(((i, links[n], min(ids[root(n)]) if i is not None else None) for n, (i, _, _) in enumerate(rows)), key=str)


def vectors(rng):
    rows = []
    for c in range(25):
        center = rng.normal(size=16)
        for _ in range(rng.integers(1, 8)):
            rows.append((center + rng.normal(size=16) * rng.choice([0.0, 0.02, 0.1, 0.2])).tolist())
    hot = rng.normal(size=16).tolist()
    rows += [hot] * 30
    return [(n, [float(np.float32(x)) for x in v], n % 3 if n % 5 else 1) for n, v in enumerate(rows)]


def test_links_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = vectors(rng)
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [], 1), (n + 4, rows[0][1], None), (n + 5, [1.0, None], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    for block in (1024, 4):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        out = embedding_dedup.near_duplicates(df).collect()
        assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=str) == brute(rows)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_recall_on_close_pairs(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(600, 64))
    near = base + rng.normal(size=base.shape) * 0.045 * np.linalg.norm(base, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([base, near]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute(rows)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()), key=str)
    assert sum(w[1] for w in want) > 400
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want)


@pytest.mark.parametrize("part", [3, 1.25])
def test_recall_in_a_large_group(spark, monkeypatch, part):
    """Near, not equal vectors of one group, a third or four fifths of all, and many pivots."""
    monkeypatch.setattr(embedding_dedup, "VECTORS_PER_PIVOT", 2)
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    n, g = 1500, int(1500 / part)
    group = np.sqrt(0.93) * unit(rng.normal(size=(1, 64))) + np.sqrt(0.07) * unit(rng.normal(size=(g, 64)))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([group, unit(rng.normal(size=(n - g, 64)))]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df).collect()}
    x = unit(np.array([r[1] for r in rows]))
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert want.sum() > 50_000 and all(got[i] <= want[i] for i in range(n))
    assert sum(got.values()) >= 0.99 * want.sum()


# --- toxicity ---------------------------------------------------------------------------

COMMON = {k: v.split() for k, v in toxicity.COMMON.items()}
BAD = {"en": ["grumble", "snark", "blight"], "de": ["mistkram", "doofian", "quatschkopf"]}


def corpus(rng, n):
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        words = [rng.choice(COMMON[lang]) if rng.random() < 0.5 else f"{lang}{rng.randrange(3000)}" for _ in range(rng.randint(8, 80))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(BAD[lang])
        rows.append((i, " ".join(words), lang, int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(random.Random(1), 1500)
    docs = spark.createDataFrame(
        [(i, t, "x", 1) for i, t, _, _ in rows] + [(5000, None, "x", 1), (5001, "", "x", 1), (5002, "the " * 300000, "x", 1), (None, "no id", "x", 1)],
        "doc_id long, text string, score string, toxic int",
    )
    labels = spark.createDataFrame([(i, 1, y) for i, _, _, y in rows] + [(None, 1, 1), (99999, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == 1504
    held = [(i, y) for i, _, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i, _ in held) and not any(got[i]["held_out"] for i, *_ in rows if zlib.crc32(str(i).encode()) % 5)
    assert np.mean([got[i]["predicted"] == y for i, y in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert got[5000]["score"] == got[5001]["score"] and got[5000]["predicted"] == 0


def test_single_labels():
    assert toxicity.fit(["a b"], [1]).out_bias > 0 > toxicity.fit([], []).out_bias


def plain_score(model, text):
    """The score of a text by loops over its words, filters and places."""
    hashes, heads = toxicity.textcore.word_hashes(text.lower().encode(), toxicity.PREFIX, alnum=True)
    row = lambda table, h: int(table[int(h) >> (64 - toxicity.BUCKET_BITS)])
    x = [model.embed[row(model.words, w)] + model.embed[row(model.heads, h)] for w, h in zip(hashes, heads, strict=True)]
    total = model.out_bias
    for a, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            sums = [
                sum(float(x[at + j] @ model.kernels[a][j][:, f]) for j in range(width) if at + j < len(x)) for at in range(len(x))
            ]
            pooled = max(sums, default=0.0) + model.bias[a][f]
            total += max(pooled, 0.0) * model.out[a * toxicity.FILTERS + f]
    votes = [sum(int(w) in {int(v) for v in known} for w in hashes) for known in model.common.values()]
    total -= list(model.thresholds.values())[votes.index(max(votes))]
    return 1 / (1 + math.exp(-total))


def test_scores_equal_a_plain_network(spark, monkeypatch):
    rows = corpus(random.Random(4), 500)
    model = toxicity.fit([t for _, t, _, _ in rows], [y for *_, y in rows])
    model.thresholds.update(en=0.3, de=-0.4)
    texts = [t for _, t, _, _ in rows[:40]] + ["", "one", "unseen words zzz qqq", "The Of " + rows[0][1].upper(), "-- ..", " ".join(t for _, t, _, _ in rows)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(plain_score(model, text), abs=1e-5)
    long = texts[-1]
    whole = got[len(texts) - 1]
    monkeypatch.setattr(toxicity, "LONG_WORDS", 100)  # the same text in segments
    assert toxicity.Scorer(model)([long])[0] == pytest.approx(whole, abs=1e-6)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.classify(docs, labels).collect()] == [0, 0]
    assert toxicity.classify(docs.limit(0), labels).count() == 0
