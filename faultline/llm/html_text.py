"""HTML extraction: a conditional random field over the leaf blocks of a page, decoded by Viterbi."""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.crf import Crf, fit

#: Pages the field is fitted on, at most, and how often each is drawn anew in other markup.
TRAIN_PAGES, DRAWINGS = 150, 5
#: Weight of the pages as they are.
AS_THEY_ARE = 4
#: Blocks of a training sequence, at most; longer pages are fitted in pieces.
PIECE = 60

# names of HTML: what starts a new block, what is never text, what has no end tag
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead tr ul title".split())
# What runs to its own end tag whatever stands in it; what holds no prose but is marked up like anything else.
RAW = frozenset("script style textarea iframe".split())
DROPPED = frozenset("noscript template object svg select button canvas audio video".split())
#: Of these the next one cannot begin before the last has ended.
ALONE = frozenset("select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the first set is closed by a start tag of the second.
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
             "tr": {"tr"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|[^<]+|<", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPACE = re.compile(r"\s+")

#: Parts of class, id and role names, by what they say.
HINTS = {
    "menu": ("nav", "menu", "breadcrumb", "toolbar", "pagination", "pager", "tabs"),
    "top": ("header", "masthead", "banner", "topbar", "logo"),
    "foot": ("footer", "copyright", "colophon", "legal", "contentinfo"),
    "side": ("side", "aside", "related", "widget", "recommend", "popular", "trending", "complementary", "toc", "tags", "share",
             "social"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner"),
    "notice": ("cookie", "consent", "notice", "gdpr", "popup", "modal", "alert", "overlay", "privacy"),
    "form": ("form", "login", "signup", "subscribe", "newsletter", "search", "contact"),
    "talk": ("comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "review", "reviews"),
    "main": ("article", "content", "main", "post", "entry", "story", "body", "text", "page"),
}
_TAGS = ("article", "main", "nav", "header", "footer", "aside", "form", "section", "table", "ul", "ol", "blockquote", "figure",
         "head", "h1", "h2", "h3", "h4", "p", "li", "td", "div", "pre", "dl", "label", "button", "title")
_OWN = ("bias", "links<5", "links<50", "links+", "words<4", "words<10", "words<30", "words+", "stop", "nostop", "sign", "rights")
FEATURES = {n: i for i, n in enumerate([f"in:{t}" for t in _TAGS] + [f"last:{t}" for t in _TAGS]
                                       + [f"hint:{h}" for h in HINTS] + [f"near:{h}" for h in HINTS] + list(_OWN))}
_BY_PART = {part: [h for h, parts in HINTS.items() if part in parts] for parts in HINTS.values() for part in parts}


@dataclass
class Block:
    """Text of one leaf, the tags above it and the nearest block among them, what their names hint at (and the nearest
    one's), and its linked characters."""

    text: str
    tags: frozenset
    last: str
    hints: frozenset
    near: frozenset
    linked: int


def name_hints(attributes: str) -> frozenset:
    """What class, id and role names say, by their parts: whole parts for short words, starts for longer ones."""
    found = set()
    for m in _NAMES.finditer(attributes):
        for part in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", m[1] or m[2] or m[3] or "").lower()):
            for known, hints in _BY_PART.items():
                if part == known or len(known) >= 4 and part.startswith(known):
                    found.update(hints)
    return frozenset(found)


class _Ends:
    """Where elements end, if they do. Places are asked for in rising order, so each page is searched once a name."""

    def __init__(self, page: str):
        self.page, self.found = page, {}

    def next(self, mark: str, tag: str, at: int) -> tuple[int, int] | None:
        """(start, end) of the first tag from there on; `mark` is "</" or "<"."""
        known = self.found.get((mark, tag))
        if known is None or known[0] is not None and known[0] < at:
            m = re.compile(rf"{mark}{re.escape(tag)}(?![^\s/>])[^>]*(?:>|\Z)", re.I).search(self.page, at)
            known = self.found[mark, tag] = m.span() if m else (None, None)
        return known if known[0] is not None else None

    def closed(self, tag: str, at: int) -> bool:
        """Whether the element that starts before this place has an end tag of its own."""
        end = self.next("</", tag, at)
        if end is None or tag not in ALONE:
            return end is not None
        again = self.next("<", tag, at)
        return again is None or again[0] > end[0]


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page in order: text between block-level tags, character references decoded, white space joined.

    Comments, scripts and other elements that hold no prose are left out with all they contain; one of these that is
    never closed holds nothing, but for scripts and styles, which then reach to the end of the page. Missing end tags are
    supplied as browsers do: a block start ends an open paragraph, an end tag closes what is open inside it. Elements may
    be nested to any depth.
    """
    out: list[Block] = []
    stack: list[tuple[str, frozenset]] = []
    open_tags: Counter = Counter()
    open_blocks: list[str] = []
    named: list[frozenset] = []
    hints: Counter = Counter()
    pieces: list[str] = []
    ends = _Ends(page)
    linked, at, dropped = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(pieces)).strip()
        if text:
            out.append(Block(text, frozenset(open_tags), open_blocks[-1] if open_blocks else "", frozenset(hints),
                             named[-1] if named else frozenset(), linked))
        pieces.clear()
        linked = 0

    def close(i: int) -> None:
        nonlocal dropped
        if any(t in BLOCKS for t, _ in stack[i:]):
            flush()
        while len(stack) > i:
            tag, own = stack.pop()
            open_tags[tag] -= 1
            if not open_tags[tag]:
                del open_tags[tag]
            dropped -= tag in DROPPED
            if tag in BLOCKS:
                open_blocks.pop()
            if own:
                named.pop()
                hints.subtract(own)
                for h in own:
                    if not hints[h]:
                        del hints[h]

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[3]
        if tag is None:
            piece = m[1] if m[1] is not None else m[0] if m[0][0] != "<" or m[0] == "<" else None
            if piece and not dropped:
                piece = html.unescape(piece) if "&" in piece and m[1] is None else piece
                pieces.append(piece)
                if "a" in open_tags:
                    linked += len(piece)
            continue
        tag = tag.lower()
        if m[2]:
            if tag in open_tags:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            elif tag in BLOCKS and not dropped:
                flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                pieces.append(" ")
            continue
        if m[4].rstrip().endswith("/") and tag in RAW | DROPPED:
            continue
        if tag in RAW:
            end = ends.next("</", tag, at)
            at = end[1] if end else len(page) if tag in ("script", "style") else at
            continue
        if tag in DROPPED and not ends.closed(tag, at):
            continue
        if tag in BLOCKS:
            for i in range(len(stack) - 1, -1, -1):
                if tag in CLOSED_BY.get(stack[i][0], ()):
                    close(i)
                    break
                if stack[i][0] in BLOCKS and stack[i][0] not in CLOSED_BY or stack[i][0] in DROPPED:
                    break
            if not dropped:
                flush()
            open_blocks.append(tag)
        own = name_hints(m[4]) if "=" in m[4] else frozenset()
        stack.append((tag, own))
        open_tags[tag] += 1
        dropped += tag in DROPPED
        if own:
            named.append(own)
            hints.update(own)
    flush()
    return out


def features(blocks: list[Block]) -> list[list[int]]:
    """Ancestor tags, what their names hint at, links, length and sentence signs."""
    out = []
    for b in blocks:
        words = b.text.count(" ") + 1
        share = b.linked / len(b.text)
        names = ["bias", "links<5" if share < .05 else "links<50" if share < .5 else "links+",
                 "words<4" if words < 4 else "words<10" if words < 10 else "words<30" if words < 30 else "words+",
                 "stop" if b.text[-1] in ".!?…:\"”»)" else "nostop"]
        names += ["rights"] if "©" in b.text or "copyright" in b.text.lower() else []
        names += ["sign"] if any(c in b.text for c in "|»›•→") and words < 20 else []
        names += [f"in:{t}" for t in _TAGS if t in b.tags]
        names += [f"last:{b.last}"] if b.last in _TAGS else []
        names += [f"hint:{h}" for h in b.hints] + [f"near:{h}" for h in b.near]
        out.append([FEATURES[n] for n in names])
    return out


def _labelled(page: str) -> tuple[list[Block], list[int]]:
    """Blocks of a page that marks its article by tag: those in it, outside of side matter, are main text."""
    blocks = leaf_blocks(page)
    other = {"nav", "header", "footer", "aside", "form", "head"}
    return blocks, [int("article" in b.tags and not other & b.tags and not b.hints & set(HINTS) - {"main"}) for b in blocks]


#: Ways to mark up each kind of block, for drawings: (tag, class or id names).
_STYLES = {
    "main": [("article", ""), ("main", ""), ("div", "content"), ("div", "post-body"), ("section", "entry-content"), ("div", "story"),
             ("article", "post"), ("div", "article-text"), ("div", "")],
    "menu": [("nav", ""), ("div", "nav"), ("ul", "menu"), ("div", "breadcrumb")],
    "top": [("header", ""), ("div", "header"), ("div", "masthead")],
    "foot": [("footer", ""), ("div", "footer"), ("div", "copyright")],
    "side": [("aside", ""), ("div", "sidebar"), ("div", "related"), ("section", "widget")],
    "advert": [("div", "ad"), ("div", "ads"), ("div", "sponsored"), ("section", "promo")],
    "notice": [("div", "cookie-notice"), ("div", "consent"), ("div", "modal"), ("aside", "notice")],
    "form": [("form", ""), ("form", "newsletter"), ("div", "login-form")],
    "talk": [("div", "comments"), ("section", "comment-list"), ("ol", "replies"), ("div", "comment")],
}


def drawings(blocks: list[Block], tags: list[int], rng: random.Random) -> Iterator[tuple[list[Block], list[int]]]:
    """The labelled page in other markup: its main text and its side matter under other names, with side matter of
    kinds that it lacks before, after and inside the main part."""
    main = [b.text for b, y in zip(blocks, tags, strict=True) if y]
    rest = [b.text for b, y in zip(blocks, tags, strict=True) if not y] or ["Home"]
    if not main:
        return
    for _ in range(DRAWINGS):
        def part(kind: str, texts: list[str], outer: str = "") -> str:
            tag, name = rng.choice(_STYLES[kind])
            inner = "li" if kind in ("menu",) or tag in ("ul", "ol") else rng.choice(("p", "div", "p"))
            link = kind == "menu" or kind in ("side", "foot") and rng.random() < 0.5
            body = "".join(f"<{inner}>" + (f"<a href='#'>{html.escape(t)}</a>" if link else html.escape(t)) + f"</{inner}>" for t in texts)
            return f"<{tag}" + (f" {rng.choice(('class', 'id'))}='{name}'" if name else "") + f">{outer}{body}</{tag}>"

        def some(kind: str) -> str:
            texts = [rng.choice(rest + main) if kind in ("talk", "side", "advert", "notice") else rng.choice(rest)
                     for _ in range(rng.randint(1, 4))]
            return part(kind, [t[: rng.choice((40, 120, 400))] for t in texts])

        before = [some(k) for k in rng.sample(("top", "menu", "notice", "advert", "side", "form"), rng.randint(0, 4))]
        after = [some(k) for k in rng.sample(("talk", "foot", "side", "advert", "form", "notice", "menu"), rng.randint(0, 5))]
        tag, name = rng.choice(_STYLES["main"])
        heads = rng.choice(("h1", "h2", "h1"))
        inside = [f"<{heads}>{html.escape(main[0])}</{heads}>"] + [
            f"<{(k := rng.choice(('p', 'p', 'p', 'div', 'li', 'blockquote', 'h2', 'td')))}>{html.escape(t)}</{k}>" for t in main[1:]]
        strange = -1
        if rng.random() < 0.5:
            strange = rng.randint(1, len(inside))
            inside.insert(strange, some(rng.choice(("advert", "side", "talk", "form", "top", "foot"))))
        own = [(len(leaf_blocks(part_)), int(i != strange)) for i, part_ in enumerate(inside)]
        middle = f"<{tag}" + (f" {rng.choice(('class', 'id'))}='{name}'" if name else "") + ">" + "".join(inside) + f"</{tag}>"
        middle = "".join(inside) if rng.random() < 0.1 else middle
        if rng.random() < 0.3:
            middle = f"<div id='{rng.choice(('wrapper', 'page', 'main'))}'>{middle}</div>"
        drawn = leaf_blocks("<body>" + "".join(before) + middle + "".join(after) + "</body>")
        # a block is what the part it was drawn in is
        parts = [*[(len(leaf_blocks(p)), 0) for p in before], *own, *[(len(leaf_blocks(p)), 0) for p in after]]
        wanted = [y for n, y in parts for _ in range(n)]
        yield drawn, wanted


def train(pages: DataFrame, html_column: str = "html", id_column: str = "page_id") -> Crf:
    """Fits on a bounded sample of pages that mark their article by tag, taken in hash order of their ids, as they
    are and drawn anew in other markup."""
    marked = pages.where(F.col(html_column).contains("<article"))
    chosen = marked.select(F.col(id_column).alias("k")).distinct().orderBy(F.xxhash64(F.lit("pages"), "k"), "k").limit(TRAIN_PAGES)
    own = pages.select(F.col(f"`{id_column}`").alias("k"), F.col(f"`{html_column}`").alias("h"))
    sample = own.join(F.broadcast(chosen), "k").orderBy(F.xxhash64("h"), "k").limit(TRAIN_PAGES).collect()
    rng = random.Random(11)
    items, tags = [], []
    for row in sample:
        blocks, wanted = _labelled(row.h)
        for own, y in [(blocks, wanted)] * AS_THEY_ARE + list(drawings(blocks, wanted, rng)):
            seen = features(own)
            for k in range(0, len(own), PIECE):
                items.append(seen[k: k + PIECE])
                tags.append(y[k: k + PIECE])
    return fit(items, tags, len(FEATURES), 2, epochs=120)


def main_text(page: str, field: Crf) -> str:
    blocks = leaf_blocks(page)
    tags = field.viterbi(features(blocks))
    return "\n".join(b.text for b, y in zip(blocks, tags, strict=True) if y)


def extract(pages: DataFrame, field: Crf, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page, from its whole html.

    Null, empty and tagless pages give what their blocks give, an empty text if there are none; broken markup is read
    as far as it goes and never refused; pages alike give the same text; null ids and urls are passed on; an empty
    table stays empty; other columns are not read.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_column, url_column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "", field) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{url_column}`").alias("url"),
                        F.col(f"`{html_column}`").cast("string").alias("html"))
    return rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnsRenamed(
        {"id": id_column, "url": url_column})
