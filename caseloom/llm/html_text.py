"""Main text of web pages.

Method: two passes over the blocks of a page.  The first pass decides blocks by stop-word
density, length and link density, with the element they stand in as a hint; short blocks that
these rules leave open are labelled in the second pass after their nearest decided neighbours in
the same region.  The page is read by one scan over its tags with a stack of open elements, in
time and memory proportional to the page, whatever quotes or brackets it leaves open.

Stop words tell nothing in languages that are not listed: where a block is not in Latin letters,
or hardly any word of the page is a listed one, length, marks at sentence ends and link density
decide alone.  Scripts without blanks count two characters as a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from caseloom.llm.textcore import slices

_TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTR_NAME = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
#: Fixed values of HTML: elements without content, with content that is no text of the page, and
#: those that make blocks; others stand within a line, custom ones (with a hyphen) make blocks.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(
    "script style noscript template textarea title svg iframe object select datalist canvas audio video"
    " annotation annotation-xml".split()
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in _RAW}
_BLOCK = frozenset(
    "address article aside blockquote body button caption center colgroup dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main"
    " menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
#: Opening one of these ends an open element of the listed names.
_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
_BREAKS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav"
    " ol p pre section table ul figure".split()
)
_SCOPES = frozenset("article main body table section div td th ul ol nav aside footer header form".split())
_NOISE_TAGS = frozenset("nav footer aside form button menu dialog fieldset".split())
_MAIN_TAGS = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: One part of a class or id, cut at hyphens, underscores and capitals.
_NOISE_PART = re.compile(
    r"(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|header"
    r"|masthead|cookies?|consent|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing"
    r"|social|related|recommend\w*|comments?|commentlist|disqus|replies|reply|respond|widget|toolbar|pagination|pager|tags"
    r"|skip|copyright|disclaimer|gdpr|form)\d*"
)
#: Of these, parts that an article's own sections have in their names too: within an article they
#: are one vote, which the words of a block can outvote.
_WEAK_PART = re.compile(r"(?:header|masthead|banner|alert|copyright|disclaimer|form|tags|search|skip|overlay|widget|module)\d*")
#: Parts by which the element of an article is one of readers' comments.
_COMMENT_PART = re.compile(r"(?:comments?|commentlist|disqus|replies|reply|respond)\d*")
#: Parts that go with these in names of page elements, and words that only phrases have.
_LAYOUT = frozenset(
    "site main page top bottom left right upper lower inner outer global primary secondary first last box bar wrap wrapper"
    " container block area list item section row col column module slot unit zone group panel content text body title link"
    " links icon icons button buttons post posts side mobile desktop sticky fixed wp".split()
)
_PHRASE = frozenset("a an and at by for from in of on or the to with without de des du la le les und der die das el los".split())
_NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split()
)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_NO_BLANKS = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")
_LATIN = re.compile("[A-Za-z\u00c0-\u024f]")
_SENTENCE_END = re.compile("[.!?\u2026\u3002\uff01\uff1f\u0964\u061f\u06d4]")
#: Common words of the languages of the corpus.
STOP_WORDS = frozenset(
    # English
    "a an and are as at be been but by can for from had has have he her his i if in is it its more not"
    " of on or our she so that the their there they this to was we were which will with would you"
    # French
    " au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou"
    " par pas pour qu que qui sa se ses son sur un une vous"
    # German
    " als am auch auf aus bei bin das dass dem den der des die du ein eine einem einen einer er es für"
    " hat ich im ist mit nach nicht sich sie sind über und vom von war wie wir zu zum zur"
    # Spanish
    " al como con del el ella era es esta este fue ha las lo los más muy no nos para pero por se si sin"
    " son su sus también una y ya".split()
)

GOOD, BAD, OPEN = 1, -1, 0


@dataclass
class Block:
    text: str = ""
    linked: int = 0
    region: int = 0
    main: bool = False
    noise: bool = False
    doubt: bool = False
    heading: bool = False
    parts: list[str] = field(default_factory=list)
    link_parts: list[str] = field(default_factory=list)


def _name_parts(value: str) -> Iterator[list[str]]:
    """The parts of each name in a class or id; phrases are titles, not names of elements."""
    for name in value.split():
        parts = [x for x in re.split(r"[-_\W]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if x]
        if len(parts) <= 2 or _PHRASE.isdisjoint(parts[1:-1]):
            yield parts


def _noisy_name(value: str, strict: bool, pattern: re.Pattern = _NOISE_PART, weak: bool = True) -> bool:
    """Whether a class or id names something that is no article: one of its parts does; where
    strict the last one, or one among layout words; weak: whether weak parts count."""
    for parts in _name_parts(value):
        noisy = [bool(pattern.fullmatch(x)) and (weak or not _WEAK_PART.fullmatch(x)) for x in parts]
        layout = all(n or x in _LAYOUT or x.isdigit() for n, x in zip(noisy, parts, strict=True))
        if any(noisy) and (not strict or noisy[-1] or layout):
            return True
    return False


def _is_noise(name: str, attrs: list[tuple[str, str]], in_main: bool) -> tuple[bool, bool]:
    """Whether an element is no part of an article, and whether only its words can tell."""
    if in_main and name == "fieldset":
        return False, True
    if name in _NOISE_TAGS or (name == "header" and not in_main):
        return True, False
    if "-" in name and _noisy_name(name, True):
        return True, False
    if not attrs or name in ("html", "body", "main") or name in _HEADINGS:
        return False, False
    if name == "article":
        return any(k in ("class", "id") and _noisy_name(v, True, _COMMENT_PART) for k, v in attrs), False
    doubt = False
    for key, value in attrs:
        if key == "hidden" or (key == "style" and _HIDDEN.search(value)):
            return True, False
        if key == "role" and value.strip().lower() in _NOISE_ROLES:
            return True, False
        if key in ("class", "id") and _noisy_name(value, key == "id"):
            if not in_main or _noisy_name(value, key == "id", weak=False):
                return True, False
            doubt = True
    return False, doubt


def _tag_end(html: str, at: int) -> tuple[int, list[tuple[str, str]], bool]:
    """End of the tag whose name ends at `at`, its attributes, and whether it closes itself.

    A quote opens a value only after an equals sign; one that is never closed ends with the tag.
    A tag that is never closed ends with the page.  Each quote is searched in vain once at most.
    """
    attrs: list[tuple[str, str]] = []
    while True:
        at = _GAP.match(html, at).end()
        if at >= len(html):
            return at, attrs, False
        if html[at] == ">":
            return at + 1, attrs, html[at - 1] == "/"
        name = _ATTR_NAME.match(html, at)
        at = name.end()
        equals = _EQUALS.match(html, at)
        value = ""
        if equals:
            at = equals.end()
            quote = html[at : at + 1]
            if quote in ("'", '"'):
                stop = html.find(quote, at + 1)
                if stop < 0:
                    stop = html.find(">", at + 1)
                    attrs.append((name[0].lower(), html[at + 1 : stop] if stop >= 0 else ""))
                    return (stop + 1 if stop >= 0 else len(html)), attrs, False
                value, at = html[at + 1 : stop], stop + 1
            else:
                bare = _BARE.match(html, at)
                value, at = bare[0], bare.end()
        attrs.append((name[0].lower(), value))


def _comment_end(html: str, at: int) -> int:
    """End of the comment, declaration or other mark-up without a name that starts at `at`."""
    if html.startswith("<!--", at):
        if html.startswith(("<!-->", "<!--->"), at):
            return html.index(">", at) + 1
        stop = html.find("-->", at + 4)
        return stop + 3 if stop >= 0 else len(html)
    stop = html.find(">", at)
    return stop + 1 if stop >= 0 else len(html)


def blocks(html: str) -> list[Block]:
    """Text blocks of a page in order, with the element hints."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool, int, bool]] = []  # name, noise, main, region, doubt
    opened: dict[str, int] = {}  # how many of each name are on the stack
    block = Block()
    regions = links = 0
    at = 0

    def flush() -> None:
        nonlocal block
        text = " ".join("".join(block.parts).split())
        if text:
            block.text = text
            block.linked = len(" ".join("".join(block.link_parts).split()))
            found.append(block)
        _, noise, main, region, doubt = stack[-1] if stack else ("", False, False, 0, False)
        block = Block(region=region, main=main, noise=noise, doubt=doubt, heading=any(s[0] in _HEADINGS for s in stack[-3:]))

    def add(text: str) -> None:
        if text:
            text = unescape(text)
            block.parts.append(text)
            if links:
                block.link_parts.append(text)

    def pop_to(index: int) -> None:
        nonlocal links
        for name, *_ in stack[index:]:
            links -= name == "a"
            opened[name] -= 1
        del stack[index:]

    def close(names: tuple[str, ...], scoped: bool) -> None:
        if not any(opened.get(n) for n in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                pop_to(i)
                return
            if scoped and stack[i][0] in _SCOPES:
                return

    while True:
        mark = html.find("<", at)
        if mark < 0:
            add(html[at:])
            break
        closing = html.startswith("/", mark + 1)
        named = _TAG_NAME.match(html, mark + 1 + closing)
        if not named:
            if closing or html[mark + 1 : mark + 2] in ("!", "?"):
                add(html[at:mark])
                at = _comment_end(html, mark)
            else:
                add(html[at : mark + 1])
                at = mark + 1
            continue
        add(html[at:mark])
        name = named[0].lower()
        at, attrs, empty = _tag_end(html, named.end())
        if name in _RAW:
            if not closing and not (empty and name == "svg"):
                end = _RAW_END[name].search(html, at)
                at = end.end() if end else len(html)
            if name not in ("svg", "annotation", "annotation-xml"):
                flush()
            continue
        inline = name not in _BLOCK and "-" not in name
        if inline and name != "a":
            add(" " if name == "br" else "")
            continue
        if closing:
            close((name,), inline or name not in _SCOPES)
            if not inline:
                flush()
            continue
        if name in _VOID:
            flush()
            continue
        if name in _ENDS:
            close(_ENDS[name], True)
        if name in _BREAKS_P:
            close(("p",), True)
            if name in _HEADINGS:
                close(tuple(_HEADINGS), True)
        _, noise, main, region, doubt = stack[-1] if stack else ("", False, False, 0, False)
        here, unsure = _is_noise(name, attrs, main)
        if name in _MAIN_TAGS and not noise:
            regions += 1
            main, region = True, regions
        stack.append((name, noise or here, main, region, doubt or unsure))
        opened[name] = opened.get(name, 0) + 1
        if inline:
            links += 1
        else:
            flush()
    stack.clear()
    flush()
    return found


def _n_words(text: str) -> tuple[list[str], int]:
    """The words of a text, and how many they count as."""
    words = _WORD.findall(text.lower())
    return words, len(words) + len(_NO_BLANKS.findall(text)) // 2


def _listed_share(words: list[str]) -> float:
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(block: Block, has_main: bool, listed: bool = True) -> int:
    """GOOD, BAD or OPEN by the rules of one block alone; listed: whether the page is in a language
    with listed stop words."""
    if block.noise or (has_main and not block.main):
        return BAD
    words, n = _n_words(block.text)
    link_density = block.linked / len(block.text)
    if link_density > (0.8 if block.main else 0.33) and n < 60:
        return BAD
    if block.main and block.doubt and n < 15:
        return BAD  # a name against it, and too few words for it
    if n < 8:
        return OPEN
    if block.main and not block.doubt:
        return GOOD
    if block.heading or n < 15:
        return OPEN
    stops = _listed_share(words)
    if stops >= 0.12:
        return GOOD
    letters = sum(map(len, words))
    if not listed or 2 * len(_LATIN.findall(block.text)) < letters:
        return GOOD if link_density < 0.2 and (n >= 60 or _SENTENCE_END.search(block.text)) else BAD
    return GOOD if n >= 60 and stops >= 0.05 and link_density < 0.1 else BAD


def second_pass(found: list[Block], labels: list[int]) -> list[int]:
    """Open blocks take the label of the nearest decided neighbour of their region; at equal
    distance, and for headings, the one that follows; without any, that of the region.  Blocks
    of menus, adverts and the like are no neighbours."""
    out = list(labels)
    n = len(found)
    before, after = [None] * n, [None] * n
    tells = [label != OPEN and not b.noise for label, b in zip(labels, found, strict=True)]
    last: dict[int, int] = {}
    for i in range(n):
        before[i] = last.get(found[i].region)
        if tells[i]:
            last[found[i].region] = i
    last = {}
    for i in range(n - 1, -1, -1):
        after[i] = last.get(found[i].region)
        if tells[i]:
            last[found[i].region] = i
    for i in range(n):
        if labels[i] != OPEN:
            continue
        b, a = before[i], after[i]
        if b is None and a is None:
            out[i] = GOOD if found[i].main else BAD
        elif a is not None and (b is None or found[i].heading or a - i <= i - b):
            out[i] = labels[a]
        else:
            out[i] = labels[b]
    return out


def _is_sentence(block: Block) -> bool:
    """A block that ends a sentence, has four words and hardly a link."""
    _, n = _n_words(block.text)
    return n >= 4 and not block.heading and 5 * block.linked < len(block.text) and bool(_SENTENCE_END.search(block.text[-3:]))


def main_text(html: str | None) -> str:
    """The main text of one page; '' for a null, empty or text-free page."""
    if not html:
        return ""
    found = blocks(html)
    has_main = any(b.main and not b.noise for b in found)
    words = [w for b in found if not b.noise and 3 * b.linked <= len(b.text) for w in _WORD.findall(b.text.lower())]
    listed = _listed_share(words) >= 0.15
    first = [first_pass(b, has_main, listed) for b in found]
    if not has_main and GOOD not in first:
        # nothing long enough to decide: sentences outside of links are the text
        first = [GOOD if label == OPEN and _is_sentence(b) else label for b, label in zip(found, first, strict=True)]
    labels = second_pass(found, first)
    return " ".join(b.text for b, label in zip(found, labels, strict=True) if label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each page; n_chars counts code points.

    A null or empty html gives an empty text.  Repeated rows give one row each; an empty table
    gives none; a page of any length is read whole, also where it leaves tags or quotes open;
    other columns, also those named like results, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    key, url = pages.schema["page_id"].dataType, pages.schema["url"].dataType
    return pages.select(pages["page_id"], pages["url"], pages["html"].cast("string")).mapInArrow(
        run, f"page_id {key.simpleString()}, url {url.simpleString()}, text string, n_chars long"
    )
