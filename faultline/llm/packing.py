"""Best-two-fit packing of tokenized documents into sequences of bounded length."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.sources.scratch import stored

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
END = 1
#: Pieces that are packed together; more of them are dealt to more tasks.
GROUP_PIECES = 50_000
#: Parts of words whose ids a task remembers before it starts anew.
CACHE_PARTS = 300_000
#: White space that the tokenizer drops, so no token spans it.
_WORD = re.compile(r"[^ \t\n\r]+")
#: Characters whose normal form is themselves and whose class is the same for any Unicode version: ASCII and Latin-1
#: without the special cases (control characters, no-break space, ordinals, micro, superscripts and fractions).
_PLAIN = re.compile(r"[ \t\n\r!-~\xA1-\xA9\xAB-\xB1\xB4\xB6-\xB8\xBB\xBF-\xFF]*")
# Fixed value: the tokenizer's own split pattern, for these characters in lower case.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xDF-\xF6\xF8-\xFF]+|[0-9]|[^\sa-z0-9\xDF-\xF6\xF8-\xFF]+")


class TextIds:
    """Ids of a text as little-endian 32-bit numbers, equal to the tokenizer's own.

    Plain texts are split as the tokenizer splits them and the ids of each part are remembered; unknown parts are
    encoded together, without the steps that plain text does not need. A part's last token, and no other, is marked
    as the end of a word, which separates the parts again. Other texts are encoded word by word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path = path
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.bare.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = tuple(t.content for t in self.bare.get_added_tokens_decoder().values())
        self.known: dict[str, bytes] = {}

    @cached_property
    def whole(self):
        """The tokenizer as it is, loaded when a text first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _learn(self, parts: list[str]) -> None:
        ids = np.array(self.bare.encode(" ".join(parts), add_special_tokens=False).ids, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        raw = ids.tobytes()
        self.known.update((p, raw[4 * a: 4 * b]) for p, a, b in zip(parts, [0, *ends], ends, strict=False))

    def __call__(self, text: str) -> bytes:
        if len(self.known) > CACHE_PARTS:
            self.known.clear()
        if not _PLAIN.fullmatch(text) or any(t in text for t in self.special):
            return b"".join(np.array(self.whole.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
                            for w in _WORD.findall(text))
        parts = _PARTS.findall(text.lower())
        new = set(parts).difference(self.known)
        if new:
            self._learn(list(new))
        return b"".join(map(self.known.__getitem__, parts))


@cache
def text_ids(path: str) -> TextIds:
    """One per Python worker: the vocabulary is loaded once."""
    return TextIds(path)


PIECES = "id {}, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY,
           tokenizer: str | None = None, end: int = END) -> DataFrame:
    """One row per piece: a document's ids and the end id, cut only where longer than `capacity`."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    kind = docs.schema[id_column].dataType.simpleString()
    closing = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = text_ids(path)
        for batch in batches:
            owner, rows = [], []
            for i, text in enumerate(batch.column(1)):
                ids = ids_of(text.as_py() or "") + closing
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at: at + 4 * capacity]
                    owner.append(i)
                    rows.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(owner, pa.int64())), pa.array(columns[0], pa.int32()),
                *[pa.array(c, pa.int64()) for c in columns[1:]]],
                ["id", "piece", "start", "length", "ids_crc32"])
        ids_of.known = {}      # idle workers hold no words

    return docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text")).mapInArrow(
        cut, PIECES.format(kind))


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length.

    A bin starts with the longest piece left and takes the longest that fits until none does. If a gap stays, its
    smallest piece gives way to the two left pieces that fit the gap so widened most tightly, if they fill more.
    Equal lengths are interchangeable, so the search is over lengths: a bit mask of those left.
    """
    order = np.argsort(-lengths, kind="stable")
    stock: dict[int, list[int]] = {}
    for i in order[::-1]:
        stock.setdefault(int(lengths[i]), []).append(int(i))
    mask = sum(1 << n for n in stock)

    def take(n: int) -> int:
        nonlocal mask
        left = stock[n]
        item = left.pop()
        if not left:
            mask ^= 1 << n
        return item

    def give(n: int, item: int) -> None:
        nonlocal mask
        stock[n].append(item)
        mask |= 1 << n

    def longest(room: int) -> int:
        return max((mask & ((1 << (room + 1)) - 1)).bit_length() - 1, 0) if room > 0 else 0

    def two(room: int, above: int) -> tuple[int, int] | None:
        """The two lengths left with the largest sum in (above, room]."""
        best, pair = above, None
        a = longest(room - 1)
        while a and 2 * a > best:
            b = longest(min(a, room - a))
            if b == a and len(stock[a]) < 2:
                b = longest(a - 1)
            if b and a + b > best:
                best, pair = a + b, (a, b)
                if best == room:
                    break
            a = longest(a - 1)
        return pair

    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    while mask:
        content, room = [], capacity
        while n := longest(room):
            content.append((n, take(n)))
            room -= n
        if room and len(content) > 1:
            smallest, item = content[-1]
            if pair := two(room + smallest, smallest):
                content.pop()
                content += [(n, take(n)) for n in pair]
                give(smallest, item)
        at = 0
        for n, item in content:
            bins[item], offsets[item] = number, at
            at += n
        number += 1
    return bins, offsets


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY,
         tokenizer: str | None = None, end: int = END) -> DataFrame:
    """Pieces with the sequence that holds them and their place in it.

    Pieces are dealt at random to groups of about GROUP_PIECES, each packed in one task, so no key gathers many and
    waste beyond a single packing is at most a sequence per group. Null and empty texts are one end id; repeated
    rows are packed as often as they occur; pieces of equal length take each other's place; no rows give no rows.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    cut = stored(pieces(docs, id_column, text_column, capacity, tokenizer, end), "pieces")
    groups = max(1, -(-cut.count() // GROUP_PIECES))

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending")])
        bins, offsets = best_two_fit(group["length"].to_numpy(), capacity)
        bins = bins + (group["pack"][0].as_py() << 40)
        return group.drop_columns(["pack"]).append_column("sequence_id", pa.array(bins)).append_column(
            "offset", pa.array(offsets))

    dealt = cut.withColumn("pack", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    packed = dealt.groupBy("pack").applyInArrow(fill, PIECES.format(kind) + ", sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_column)
