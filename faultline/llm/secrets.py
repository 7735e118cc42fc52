"""Secret scan: fixed patterns, and a conditional random field that tags words as begin, inside or outside of a secret.

The field is fitted on sequences drawn from what the patterns find: the value stays, while its key word, separator, quotes
and line breaks change or go, and what only looks like a secret is drawn beside it. So it finds values that no pattern
reaches. Scanning looks at every word: scores of a word come from tables, a word that is outside on every best path is
settled at once, and the stretches left between such words are decoded by Viterbi, all of one length together.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import buffers
from faultline.llm.crf import Crf, fit, viterbi_many

# The base patterns, in order of kinds.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")
_KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Rows with and without a pattern that pieces are taken from, at most; pieces taken from them, and words of one to either side.
TRAIN_FOUND, TRAIN_OTHER, TRAIN_PIECES, CONTEXT = 1200, 600, 1500, 8
#: Sequences drawn from each piece, and drawn in all at least.
DRAWN, LEAST_DRAWN = 4, 4000
#: Words looked at to either side.
REACH = 3
#: Text bytes tagged at a time; a longer text is tagged alone.
CHUNK = 4 << 20

OUTSIDE, BEGIN, INSIDE = range(3)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TRIM = "\"'`.,;:!?()[]{}<>#$%&*|"

Span = tuple[int, int, int]
"""(start, end, number of the kind), in code points."""


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, by start and then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


# --- features -------------------------------------------------------------------------------------------------
_SHAPES = ("none", "plain", "key", "hint", "keyvalue", "separator", "number", "mail", "link", "dotted", "hex", "mixed", "strong", "other")
NONE, PLAIN = 0, 1
_OWN = ("bias", "len<6", "len<9", "len<12", "len<20", "len<36", "len+", "classes2", "classes3", "classes4", "switches", "digits",
        "quoted", "prefixed", "long text", "odd text")
FEATURES = {name: i for i, name in enumerate([f"{d:+d}:{s}" for d in range(-REACH, REACH + 1) for s in _SHAPES] + list(_OWN))}
# Words around a secret, beside the key words of the patterns.
_HINTS = frozenset("key keys pass pwd login credential credentials auth bearer passphrase".split())
_SEPARATORS = frozenset("= : := - -- -> => is was equals".split())
_KEY = re.compile("|".join(_KEYWORDS))
_LINK = re.compile(r"(https?://|www\.|[./~]*/).*|.*\.(com|org|net|io|html?|txt|md|py|js|css|json|csv|png|jpe?g|pdf|gz|zip|exe)", re.A)
_MAIL = re.compile(r"[\w.+-]+@[\w.-]+")
_NUMBER = re.compile(r"[+~]?[0-9][0-9.,:/x+-]*")


def look(word: str) -> tuple[int, tuple[int, ...]]:
    """(shape, own features) of a word without its neighbours."""
    core = word.strip(_TRIM)
    n = len(core)
    size = FEATURES["len<6" if n < 6 else "len<9" if n < 9 else "len<12" if n < 12 else "len<20" if n < 20 else "len<36" if n < 36 else "len+"]
    low = core.lower()
    key = _KEY.search(low)
    if core.isalpha() and not key:
        kind = "hint" if low in _HINTS else "separator" if low in _SEPARATORS else "plain"
        return _SHAPES.index(kind), (FEATURES["bias"], size)
    if not n or core in _SEPARATORS:
        return _SHAPES.index("separator" if word.strip("\"'`") in _SEPARATORS else "other"), (FEATURES["bias"], size)
    classes = [any(map(test, core)) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum())]
    digits = sum(map(str.isdigit, core))
    letters = [c.isalpha() for c in core if c.isalnum()]
    switches = sum(a != b for a, b in zip(letters, letters[1:], strict=False))
    if key and (classes.count(True) < 3 or len(low) < len(key[0]) + 8):
        kind = "keyvalue" if re.search(r"[:=].", core) else "key"
    elif _NUMBER.fullmatch(core):
        kind = "number"
    elif _MAIL.fullmatch(core):
        kind = "mail"
    elif _LINK.fullmatch(low):
        kind = "link"
    elif n >= 7 and digits and re.fullmatch(r"[0-9a-f]+", low):
        kind = "hex"
    elif not digits and re.fullmatch(r"[^\W\d_]+([._-][^\W\d_]+)+", core):
        kind = "dotted"
    elif digits and (classes.count(True) >= 3 or switches >= 4):
        kind = "strong"
    elif digits and core.isalnum():
        kind = "mixed"
    else:
        kind = "other"
    own = ["bias"]
    own += [f"classes{classes.count(True)}"] * (classes.count(True) >= 2) + ["switches"] * (switches >= 4)
    own += ["digits"] * (digits * 4 > n) + ["quoted"] * (word[:1] in "\"'`") + ["prefixed"] * bool(re.match(r"[A-Za-z]{2,6}[_-][A-Za-z0-9]{8}", core))
    return _SHAPES.index(kind), (size, *(FEATURES[f] for f in own))


def _of_text(n_bytes: int, odd: int, words: int) -> list[int]:
    """Features of the whole text: whether it is long, and whether many of its words are not plain."""
    return [FEATURES["long text"]] * (n_bytes > 4000) + [FEATURES["odd text"]] * (odd * 20 > words)


def features(words: list[str], long: bool = False, odd: bool = False) -> list[list[int]]:
    """Active features of each word of a sequence."""
    looks = [look(w) for w in words]
    shapes = [NONE] * REACH + [k for k, _ in looks] + [NONE] * REACH
    of_text = [FEATURES["long text"]] * long + [FEATURES["odd text"]] * odd
    width = len(_SHAPES)
    return [[d * width + shapes[i + d] for d in range(2 * REACH + 1)] + [*own, *of_text] for i, (_, own) in enumerate(looks)]


# --- what the field learns from -----------------------------------------------------------------------------------
@dataclass
class Piece:
    """Words around a place, and the value that a pattern found there (empty where none did)."""

    before: list[str]
    value: str
    after: list[str]


def _pick(rng: random.Random, letters: str, low: int, high: int) -> str:
    return "".join(rng.choices(letters, k=rng.randint(low, high)))


_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_LETTERS = _LOWER + _LOWER.upper()
_VOWELS = "aeiou"


def _name(rng: random.Random, low: int = 4, high: int = 8) -> str:
    return "".join(rng.choice(_VOWELS if i % 2 else _LOWER) for i in range(rng.randint(low, high)))


def _mixed(rng: random.Random, letters: str, low: int, high: int) -> str:
    """Random signs that hold a digit and a letter."""
    out = list(_pick(rng, letters, low, high))
    out[rng.randrange(len(out) // 2)] = rng.choice(_DIGITS)
    out[rng.randrange(len(out) // 2, len(out))] = rng.choice(_LOWER)
    return "".join(out)


def _dense(rng: random.Random) -> str:
    """Values that show what they are without a key."""
    kind = rng.randrange(5)
    if kind == 0:
        return _mixed(rng, "abcdef" + _DIGITS, 33, 64).upper()
    if kind == 1:
        return f"{_pick(rng, _LOWER, 2, 5)}{rng.choice('_-')}{_mixed(rng, _LETTERS + _DIGITS, 18, 40)}"
    if kind == 2:
        return _mixed(rng, _LETTERS + _DIGITS + "+/", 24, 64) + "=" * rng.randrange(3)
    if kind == 3:
        return _mixed(rng, _LETTERS + _DIGITS, 20, 44)
    return ".".join(_mixed(rng, _LETTERS + _DIGITS + "_-", 16, 30) for _ in range(3))


def _chosen(rng: random.Random) -> str:
    """Values that people choose, which need a key beside them."""
    kind = rng.randrange(3)
    if kind == 0:
        return rng.choice(".-_").join(_name(rng) for _ in range(rng.randint(2, 5)))
    if kind == 1:
        word = "".join(rng.choice((c, c.upper(), rng.choice(_DIGITS))) for c in _name(rng, 5, 10))
        return f"{word}{rng.choice('!@#$%&*?-_+')}{_pick(rng, _LETTERS + _DIGITS, 2, 5)}{rng.choice(_DIGITS)}"
    return _mixed(rng, _LETTERS + _DIGITS, 8, 16)


def _lookalike(rng: random.Random) -> list[str]:
    """Words that are no secrets, some of them beside a key word."""
    number = lambda n: _pick(rng, _DIGITS, n, n)
    return rng.choice((
        lambda: [f"{_name(rng)}{rng.choice(('', '.', '_', number(2)))}{_name(rng)}@{_name(rng)}.{rng.choice(('com', 'org', 'example.com', 'de'))}"],
        lambda: [f"{_name(rng)}{rng.choice(('_', '-', ''))}{rng.choice((_name(rng), number(2)))}.{rng.choice(('txt', 'py', 'pdf', 'csv', 'json', 'html'))}"],
        lambda: [f"https://{_name(rng)}.{rng.choice(('com', 'org'))}/{_name(rng)}/{number(4)}"],
        lambda: [f"{number(4)}-{number(2)}-{number(2)}"], lambda: [f"{number(2)}:{number(2)}"], lambda: [number(rng.randint(1, 16))],
        lambda: [f"+{number(1)}", f"({number(3)})", f"{number(3)}-{number(4)}"], lambda: [".".join(number(2) for _ in range(4))],
        lambda: [rng.choice(("commit", "revision", "build", "id", "hash")), _mixed(rng, "abcdef" + _DIGITS, 7, 12)],
        lambda: [f"v{number(1)}.{number(1)}.{number(1)}"], lambda: [f"{_pick(rng, _LOWER.upper(), 2, 4)}-{number(rng.randint(2, 5))}"],
        lambda: [f"{_name(rng)}-{_name(rng)}"], lambda: [f"{_name(rng)}.{_name(rng)}.{_name(rng)}"], lambda: [_name(rng) + _name(rng).title()],
        lambda: [f"{_name(rng)}{number(rng.randint(1, 3))}"], lambda: [rng.choice(_KEYWORDS), _name(rng), _name(rng)],
        lambda: [rng.choice(_KEYWORDS), rng.choice(("is", "was", "-", "")), _name(rng)], lambda: ["the", rng.choice((*_KEYWORDS, "key")), "of", _name(rng)],
        lambda: [rng.choice(("token", "key", "password")), rng.choice(("count", "length", "limit")), number(rng.randint(1, 5))],
        lambda: ["-".join(_mixed(rng, "abcdef" + _DIGITS, n, n) for n in (8, 4, 4, 4, 12))],
        lambda: [f"{_name(rng)}{m}" for m in rng.choices(("%%%", "&&&", "***", "$$$", "###", ",", "."), k=3)],
    ))()


_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey", "API_KEY", "Password", "Token", "api key", "access token", "auth key",
         "secret key", "login password", "client_secret", "passphrase", "credentials", "pwd")


def draw(piece: Piece, rng: random.Random) -> tuple[list[str], list[int]]:
    """A labelled sequence from a piece: the found value or a random one under another key, separator and quotes, or
    something that only looks like one."""
    words, tags = [], []

    def add(more: list[str], tag: int = OUTSIDE) -> None:
        words.extend(w for w in more if w)
        tags.extend([tag] * (len(words) - len(tags)))

    add(piece.before[-rng.randint(0, CONTEXT):] if piece.before else [])
    if rng.random() < 0.4:
        add([rng.choice(("is", "was", "=", ":", "-", "->"))] if rng.random() < 0.3 else [])
        add(_lookalike(rng))
        add([_name(rng) for _ in range(rng.randint(0, 2))])
    if rng.random() < 0.6:
        found = bool(piece.value) and rng.random() < 0.4
        dense = found or rng.random() < 0.5
        value = piece.value if found else _dense(rng) if dense else _chosen(rng)
        quote = rng.choice(("", "", "", '"', "'", "`"))
        parts = [value]
        if dense and len(value) > 30 and rng.random() < 0.15:          # broken by a line end
            at = rng.randint(12, len(value) - 12)
            parts = [value[:at], value[at:]]
        parts = [*parts]
        parts[0], parts[-1] = quote + parts[0], parts[-1] + quote
        if not dense or rng.random() < 0.7:
            add(rng.choice(_KEYS).split())
            if rng.random() < 0.2:
                add(["for", "the", _name(rng)])
            add([rng.choice(("", "=", ":", "is", "-", "->", "=>", "was", ":="))])
        if rng.random() < 0.2:
            parts[-1] += rng.choice(".,;!")
        add(parts[:1], BEGIN)
        add(parts[1:], INSIDE)
    if rng.random() < 0.3:
        add([_name(rng) for _ in range(rng.randint(0, 2))])
        add(_lookalike(rng))
    add(piece.after[: rng.randint(0, CONTEXT)])
    return words, tags


def draws(pieces: list[Piece], seed: int, least: int = LEAST_DRAWN) -> list[tuple[list[str], list[int]]]:
    rng = random.Random(seed)
    if not pieces:
        pieces = [Piece([], "", [])]
    out = [draw(p, rng) for p in pieces * max(DRAWN, -(-least // len(pieces)))]
    return [s for s in out if s[0]]


def pieces_of(text: str, place: int) -> Iterator[tuple[list[str], str, list[str]]]:
    """(words before, value, words after) of each base match; without any, the words around a place."""
    spans = base_spans(text)
    reach = 40 * CONTEXT
    for a, b, kind in spans:
        if kind == 2 and any(k == 0 and c <= a and b <= d for c, d, k in spans):
            continue
        value = _ASSIGN.fullmatch(text, a, b)[2] if kind == 0 else text[a:b]
        yield (_WORD.findall(text[max(0, a - reach): a])[-CONTEXT:], value, _WORD.findall(text[b: b + reach].lstrip("\"'"))[:CONTEXT])
    if not spans:
        at = place % (len(text) + 1)
        yield _WORD.findall(text[max(0, at - reach): at])[1:][-CONTEXT:], "", _WORD.findall(text[at: at + reach])[1:-1][:CONTEXT]


def sample_pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> list[Piece]:
    """From a bounded sample of rows with a pattern and of others, in hash order of their ids; whole texts are read in the
    tasks, and TRAIN_PIECES pieces at most reach the driver."""
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    found = text.rlike(r"(?i)password|passwd|secret|token|api_?key|AKIA[A-Z0-9]{12}|[0-9a-f]{32}")
    ids = docs.select(F.col(f"`{id_column}`").alias("k"), found.alias("f"), F.xxhash64(F.lit("secrets"), F.col(f"`{id_column}`")).alias("h"))
    chosen = ids.where("f").orderBy("h", "k").limit(TRAIN_FOUND).unionAll(ids.where("not f").orderBy("h", "k").limit(TRAIN_OTHER))
    own = docs.select(F.col(f"`{id_column}`").alias("k"), text.alias("t"))
    sample = own.join(F.broadcast(chosen.select("k").distinct()), "k").select("t", F.xxhash64("t").alias("h"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [p for t, h in zip(batch.column(0), batch.column(1).to_pylist(), strict=True) for p in pieces_of(t.as_py(), h)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 3
            words = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], words), pa.array(columns[1], pa.string()), pa.array(columns[2], words)],
                                             ["before", "value", "after"])

    rows = sample.mapInArrow(cut, "before array<string>, value string, after array<string>")
    mix = F.xxhash64("before", "value", "after")
    return [Piece(r.before, r.value, r.after) for r in rows.orderBy(mix, "value", "before", "after").limit(TRAIN_PIECES).collect()]


def fit_field(pieces: list[Piece], seed: int = 1) -> Crf:
    rng = random.Random(seed)
    drawn = draws(pieces, seed)
    items = [features(words, rng.random() < 0.5, rng.random() < 0.5) for words, _ in drawn]
    return fit(items, [tags for _, tags in drawn], len(FEATURES), 3, epochs=80)


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Crf:
    return fit_field(sample_pieces(docs, id_column, text_column))


def precision_recall(field: Crf, drawn: list[tuple[list[str], list[int]]]) -> tuple[float, float]:
    """Of whole values in drawn sequences."""
    def values(tags: list[int]) -> set[tuple[int, int]]:
        out, first = set(), None
        for i, tag in enumerate([*tags, OUTSIDE]):
            if first is not None and tag != INSIDE:
                out.add((first, i))
                first = None
            if tag != OUTSIDE and first is None:
                first = i
        return out

    hit = got = want = 0
    for words, tags in drawn:
        found, real = values(field.viterbi(features(words))), values(tags)
        hit, got, want = hit + len(found & real), got + len(found), want + len(real)
    return hit / max(got, 1), hit / max(want, 1)


# --- scanning -----------------------------------------------------------------------------------------------------
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True


class Tagger:
    """The field as tables: what a shape at each distance adds, what a word adds by itself, and what its text adds."""

    def __init__(self, field: Crf):
        weights = np.array(field.weights)
        self.around = weights[: (2 * REACH + 1) * len(_SHAPES)].reshape(2 * REACH + 1, len(_SHAPES), 3)
        self.weights, self.moves = weights, np.array(field.moves)
        self.first, self.last = np.array(field.first), np.array(field.last)
        self.most = field.most_moves(OUTSIDE)

    def scores(self, words: list[bytes], starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores of all words of some texts; `starts` says where each text's words begin, `sizes` its bytes."""
        numbers: dict[bytes, int] = {}
        which = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
        looks = [look(w.decode()) for w in numbers]
        shape = np.array([k for k, _ in looks], np.int64)[which]
        own = np.array([self.weights[list(f)].sum(axis=0) for f in _distinct(looks)[0]])[_distinct(looks)[1]][which]
        counts = np.diff(np.append(starts, len(words)))
        odd = np.add.reduceat(np.append(shape != PLAIN, 0), starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        text = np.array([self.weights[_of_text(n, o, c)].sum(axis=0) if c else np.zeros(3) for n, o, c in zip(
            sizes.tolist(), odd.tolist(), counts.tolist(), strict=True)]).reshape(-1, 3)
        out = own + np.repeat(text, counts, axis=0)
        # texts lie REACH apart, so that no window sees another text
        gap = np.repeat(np.arange(len(starts)) * REACH, counts) + REACH
        padded = np.full(len(words) + REACH * (len(starts) + 2), NONE)
        place = np.arange(len(words)) + gap
        padded[place] = shape
        for d in range(2 * REACH + 1):
            out += self.around[d][padded[place + d - REACH]]
        return out

    def values(self, scores: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
        """(first word, end) of each value on the best paths of the texts."""
        lead = scores[:, OUTSIDE] - scores[:, [BEGIN, INSIDE]].max(axis=1, initial=-np.inf)
        loose = lead <= self.most
        begins, ends = np.zeros(len(scores), bool), np.zeros(len(scores), bool)
        begins[starts[starts < len(scores)]] = True
        ends[np.append(starts[1:], len(scores))[starts < np.append(starts[1:], len(scores))] - 1] = True
        # stretches of loose words, cut where a text begins
        first = np.flatnonzero(loose & (begins | ~np.append(False, loose[:-1])))
        last = np.flatnonzero(loose & (ends | ~np.append(loose[1:], False)))
        found = []
        for n in np.unique(last - first + 1).tolist():
            own = first[last - first + 1 == n]
            enter = np.where(begins[own][:, None], self.first, self.moves[OUTSIDE])
            leave = np.where(ends[own + n - 1][:, None], self.last, self.moves[:, OUTSIDE])
            tags = np.pad(viterbi_many(scores[own[:, None] + np.arange(n)], self.moves, enter, leave), ((0, 0), (0, 1)))
            for row, at in zip(*np.nonzero((tags == BEGIN) | (tags == INSIDE) & (np.pad(tags, ((0, 0), (1, 0)))[:, :-1] == OUTSIDE)), strict=True):
                end = at + 1
                while tags[row, end] == INSIDE:
                    end += 1
                found.append((int(own[row] + at), int(own[row] + end)))
        return sorted(found)


def _distinct(looks: list[tuple[int, tuple[int, ...]]]) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """(the different own features, the number of each word's)."""
    numbers: dict[tuple[int, ...], int] = {}
    which = np.array([numbers.setdefault(f, len(numbers)) for _, f in looks], np.int64)
    return list(numbers), which


def scan_texts(texts: list[bytes], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each UTF-8 text. A tagged run of words, without the marks around it, becomes a span unless
    a base span overlaps it."""
    data = b"\n".join(texts)
    space = np.append(_SPACE[np.frombuffer(data, np.uint8)], True)
    begin = np.flatnonzero(~space[:-1] & np.append(True, space[:-2])) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1 if len(data) else np.zeros(0, np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.cumsum(sizes + 1) - sizes - 1
    starts = np.searchsorted(begin, offsets)
    out = []
    for t in texts:
        base = base_spans(t.decode())
        out.append((base, [*base]))
    held = np.append(starts[1:], len(begin)) > starts             # texts without words have nothing to tag
    if len(begin):
        scores = tagger.scores(data.split(), starts[held], sizes[held])
        numbers = np.flatnonzero(held)
        chars: dict[int, np.ndarray] = {}
        for a, b in tagger.values(scores, starts[held]):
            i = int(numbers[np.searchsorted(starts[held], a, "right") - 1])
            if i not in chars:
                bytes_ = np.frombuffer(texts[i], np.uint8)
                chars[i] = np.append(0, np.cumsum((bytes_ & 0xC0) != 0x80))
            low, high = int(begin[a] - offsets[i]), int(end[b - 1] - offsets[i])
            word = texts[i][low:high].decode()
            left = len(word) - len(word.lstrip(_TRIM))
            first = int(chars[i][low]) + left
            last = first + len(word.strip(_TRIM))
            base, spans = out[i]
            if first < last and not any(first < e and s < last for s, e, _ in base):
                spans.append((first, last, 3))
    return [(base, sorted(spans, key=lambda s: (s[0], s[2]))) for base, spans in out]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, field: Crf, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every row's whole text.

    Null, empty and plain texts have no spans; every row is judged alone, so rows alike get the same; null ids are
    passed on; an empty table stays empty; other columns are not read. A text of any length is scanned whole, all its
    words by the same rule.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            raw, rows, at = data.tobytes(), [], 0
            while at < batch.num_rows:
                last = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1), batch.num_rows)
                for base, spans in scan_texts([raw[a:b] for a, b in zip(offsets[at:last], offsets[at + 1: last + 1], strict=True)], tagger):
                    kinds = [k for _, _, k in base]
                    rows.append((kinds.count(0), kinds.count(1), kinds.count(2),
                                 hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
                at = last
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], *[pa.array(c, pa.string()) for c in columns[3:]]],
                ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed(
        "id", id_column)
