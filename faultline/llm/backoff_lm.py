"""Language-model scores by a weighted backoff automaton over n-grams of the whole corpus.

1. Each block of texts lists its distinct n-grams with their counts in training texts, and deals them by hash to parts of
   even size, so a frequent n-gram is one entry a block and no word or context gathers in one place.
2. A part adds up the counts of all blocks and answers each block in the order it asked.
3. With the answers a block has all states and arcs of the corpus-wide automaton that its texts can reach: a context that
   occurs in training is a state, an n-gram an arc with its smoothed log-probability, and a failure arc leads to the
   next shorter context and carries the weight of backing off. One pass from left to right carries the state.

Smoothing draws each context to the next shorter one (Dirichlet prior of `strength` tokens), so that
p(w | h) = (c(hw) + strength p(w | h')) / (c(h) + strength), and words are smoothed by adding `added` counts.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import flat_ids, text_blocks, unpack
from faultline.sources.scratch import stored

ORDER = 2
STRENGTH = 150.0
ADDED = 0.1
#: Text bytes of a block, and of the corpus for each part.
BLOCK_BYTES, PART_BYTES = 4 << 20, 8 << 20
#: Bytes that name a word and a longer n-gram within its part.
WORD_NAME, GRAM_NAME = 12, 7
BEGIN, END = 0, 1
#: Names of the two marks; words hold no white space.
_MARKS = (b" begin", b" end")
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that nothing is learned from; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")), F.lit(10)) == 0, F.lit(True))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Grams:
    """The n-grams of a block by order, numbered within it.

    `tokens` are word numbers, every text from a begin mark to an end mark. at[k][i] is the number of the (k + 1)-gram
    that ends at token i, or -1; prefix, suffix and word say what each gram is made of; `keys` names it in the corpus.
    """

    tokens: np.ndarray
    starts: np.ndarray
    at: list[np.ndarray]
    prefix: list[np.ndarray]
    suffix: list[np.ndarray]
    word: list[np.ndarray]
    keys: list[np.ndarray]

    def counts(self, texts: np.ndarray) -> list[np.ndarray]:
        """How often each gram occurs in the texts marked."""
        wanted = np.repeat(texts, np.diff(np.append(self.starts, len(self.tokens))))
        return [np.bincount(at[wanted & (at >= 0)], minlength=len(key)) for at, key in zip(self.at, self.keys, strict=True)]

    def names(self) -> list[np.ndarray]:
        """Names within a part, as rows of bytes."""
        raw = [key.view(np.uint8).reshape(-1, 16) for key in self.keys]
        return [raw[0][:, 16 - WORD_NAME:], *[r[:, 8: 8 + GRAM_NAME] for r in raw[1:]]]

    def parts(self, n: int) -> list[np.ndarray]:
        return [(key[:, 0] % np.uint64(n)).astype(np.int64) for key in self.keys]


def grams(lengths: bytes, payload: bytes, order: int) -> Grams:
    """Of whole texts, lower-cased from A to Z and cut at ASCII white space."""
    data, offsets = unpack(lengths, payload)
    raw = data.tobytes().lower()
    numbers = dict(zip(_MARKS, (BEGIN, END), strict=True))
    number = numbers.setdefault
    tokens: list[int] = []
    starts = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        starts.append(len(tokens))
        tokens.append(BEGIN)
        tokens += [number(w, len(numbers)) for w in raw[a:b].split()]
        tokens.append(END)
    seq = np.array(tokens, np.int64)
    words = len(numbers)
    digest = xxhash.xxh3_128_digest
    key = np.frombuffer(b"".join([digest(w) for w in numbers]), np.uint64).reshape(-1, 2)
    everything = np.arange(words)
    out = Grams(seq, np.array(starts, np.int64), [seq], [np.zeros(words, np.int64)], [np.zeros(words, np.int64)], [everything], [key])
    place = np.arange(len(seq)) - np.repeat(out.starts, np.diff(np.append(out.starts, len(seq))))
    for k in range(1, order):
        ends = np.flatnonzero(place >= k)
        # the gram before, then the word
        code = out.at[k - 1][ends - 1] * words + seq[ends]
        known, first, which = np.unique(code, return_index=True, return_inverse=True)
        at = np.full(len(seq), -1)
        at[ends] = which
        prefix, last = known // words, known % words
        mix = out.keys[k - 1][prefix] * _FIRST + key[last] * _SECOND + np.uint64(k)
        out.at.append(at)
        out.prefix.append(prefix)
        out.suffix.append(out.at[k - 1][ends[first]])
        out.word.append(last)
        out.keys.append(_mixed(mix))
    return out


# --- counts of the whole corpus -----------------------------------------------------------------------------------
ASKED = "part int, block long, words binary, word_counts binary, grams binary, gram_counts binary"


def _dealt(values: np.ndarray, part: np.ndarray, held: np.ndarray, kind: type) -> pa.Array:
    """The values of each part in `held`, in their order, as bytes."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], held)
    raw, size = values[order].astype(kind).tobytes(), int(np.prod(values.shape[1:])) * np.dtype(kind).itemsize
    ends = (np.append(cut[1:], len(part)) * size).tolist()
    return pa.array([raw[a:b] for a, b in zip((cut * size).tolist(), ends, strict=True)], pa.binary())


def _ask(blocks: DataFrame, parts: int, order: int) -> DataFrame:
    """For each block and part the names of its n-grams with their counts in training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = grams(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), order)
                trains = ~batch.column(1)[i].values.field("held_out").to_numpy(zero_copy_only=False)
                counts, part, names = own.counts(trains), own.parts(parts), own.names()
                longer = np.concatenate([np.zeros((0, GRAM_NAME), np.uint8), *names[1:]])
                long_part = np.concatenate([np.zeros(0, np.int64), *part[1:]])
                long_counts = np.concatenate([np.zeros(0, np.int64), *counts[1:]])
                held = np.unique(np.concatenate([part[0], long_part]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(held.astype(np.int32)), pa.array(np.full(len(held), batch.column(0)[i].as_py())),
                    *[_dealt(a, p, held, t) for a, p, t in (
                        (names[0], part[0], np.uint8), (counts[0], part[0], np.uint32),
                        (longer, long_part, np.uint8), (long_counts, long_part, np.uint32))]],
                    ["part", "block", "words", "word_counts", "grams", "gram_counts"])

    return blocks.select("block", "ids", "lengths", "payload").mapInArrow(run, ASKED)


ANSWERED = "part int, block long, word_counts binary, gram_counts binary, tokens long, distinct long"


def _total(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the sum over equal names beside each, the sum of each distinct one)."""
    if names.shape[1] <= 8:
        whole = np.zeros((len(names), 8), np.uint8)
        whole[:, : names.shape[1]] = names
        names = whole.view(np.uint64).ravel()
    else:
        names = np.ascontiguousarray(names).view(f"V{names.shape[1]}").ravel()
    _, which = np.unique(names, return_inverse=True)
    sums = np.zeros(which.max(initial=-1) + 1, np.int64)
    np.add.at(sums, which, counts)
    return sums[which], sums


def _answer(group: pa.Table) -> pa.Table:
    """Corpus-wide counts in the order of each block's names; the part's tokens and distinct words stand in its first row."""
    def column(name: str, kind: type) -> list[np.ndarray]:
        return [np.frombuffer(v, kind) for v in group[name].to_pylist()]

    words, word_counts, longer, long_counts = (column(c, t) for c, t in (
        ("words", np.uint8), ("word_counts", np.uint32), ("grams", np.uint8), ("gram_counts", np.uint32)))
    begin = np.frombuffer(xxhash.xxh3_128_digest(_MARKS[0])[16 - WORD_NAME:], np.uint8)
    names = np.concatenate(words).reshape(-1, WORD_NAME)
    beside, sums = _total(names, np.concatenate(word_counts))
    marks = beside[(names == begin).all(axis=1)][:1].sum()                       # begin marks are no tokens
    beside_long, _ = _total(np.concatenate(longer).reshape(-1, GRAM_NAME), np.concatenate(long_counts))
    cut = lambda a, like: [c.astype(np.int64).tobytes() for c in np.split(a, np.cumsum([len(w) for w in like])[:-1])]
    first = np.arange(group.num_rows) == 0
    return pa.table({
        "part": group["part"], "block": group["block"], "word_counts": pa.array(cut(beside, word_counts), pa.binary()),
        "gram_counts": pa.array(cut(beside_long, long_counts), pa.binary()),
        "tokens": pa.array(first * int(sums.sum() - marks), pa.int64()),
        "distinct": pa.array(first * int((sums > 0).sum() - (marks > 0)), pa.int64())})


def corpus_counts(own: Grams, answers: list[tuple[int, bytes, bytes]], parts: int) -> list[np.ndarray]:
    """The answers of all parts put back to the numbers of the block."""
    part = own.parts(parts)
    sizes = [len(p) for p in part[1:]]
    long_part = np.concatenate(part[1:]) if sizes else np.zeros(0, np.int64)
    got = sorted(answers)
    words, longer = np.zeros(len(part[0]), np.int64), np.zeros(len(long_part), np.int64)
    words[np.argsort(part[0], kind="stable")] = np.frombuffer(b"".join(w for _, w, _ in got), np.int64)
    longer[np.argsort(long_part, kind="stable")] = np.frombuffer(b"".join(g for _, _, g in got), np.int64)
    return [words, *np.split(longer, np.cumsum(sizes)[:-1])] if sizes else [words]


# --- the automaton ------------------------------------------------------------------------------------------------
@dataclass
class Automaton:
    """States are contexts, 0 the empty one. arcs[state * words + word] is the number of an arc, which leads to `to` and
    weighs `weight`; where a state has no arc for a word, `fail` leads on at the price of `fail_weight`."""

    words: int
    begin: int
    arcs: dict[int, int]
    to: array
    weight: array
    fail: array
    fail_weight: array

    def score(self, tokens: list[int]) -> float:
        """log10 probability of the tokens after a begin mark."""
        state, total = self.begin, 0.0
        arc, words, fail, fail_weight, to, weight = self.arcs.get, self.words, self.fail, self.fail_weight, self.to, self.weight
        for w in tokens:
            a = arc(state * words + w)
            while a is None:
                total += fail_weight[state]
                state = fail[state]
                a = arc(state * words + w)
            total += weight[a]
            state = to[a]
        return total


def automaton(own: Grams, counts: list[np.ndarray], n_tokens: int, n_distinct: int, strength: float, added: float) -> Automaton:
    """All states and arcs that the block's texts can reach."""
    words, order = len(counts[0]), len(counts)
    contexts = [c.copy() for c in counts[:-1]]                # no context ends in an end mark
    for c, word in zip(contexts, own.word, strict=False):
        c[word == END] = 0
    state_of, states = [], 1
    fail, fail_weight = [np.zeros(1, np.int64)], [np.zeros(1)]
    for k, c in enumerate(contexts):
        is_state = c > 0
        back = state_of[k - 1][own.suffix[k]] if k else np.zeros(words, np.int64)
        number = np.where(is_state, states + np.cumsum(is_state) - 1, back)      # of the longest suffix that is a state
        states += int(is_state.sum())
        state_of.append(number)
        fail.append(back[is_state])
        fail_weight.append(np.log10(strength / (c[is_state] + strength)))
    p = (counts[0] + added) / (n_tokens + added * (n_distinct + 1))
    longest = lambda k: state_of[min(k, order - 2)] if order > 1 else np.zeros(words, np.int64)
    codes, to, weight = [np.arange(words)], [longest(0)], [np.log10(p)]
    for k in range(1, order):
        prefix, suffix = own.prefix[k], own.suffix[k]
        p = (counts[k] + strength * p[suffix]) / (contexts[k - 1][prefix] + strength)
        seen = np.flatnonzero(counts[k] > 0)
        codes.append(state_of[k - 1][prefix[seen]] * words + own.word[k][seen])
        to.append(longest(k)[seen] if k < order - 1 else state_of[k - 1][suffix[seen]])
        weight.append(np.log10(p[seen]))
    code = np.concatenate(codes)
    begin = int(state_of[0][BEGIN]) if order > 1 else 0
    whole = lambda a: array("q", np.concatenate(a).astype(np.int64).tobytes())
    real = lambda a: array("d", np.concatenate(a).tobytes())
    return Automaton(words, begin, dict(zip(code.tolist(), range(len(code)), strict=True)), whole(to), real(weight), whole(fail),
                     real(fail_weight))


RESULT = "id {}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", order: int = ORDER,
          strength: float = STRENGTH, added: float = ADDED, hold_out: Column | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row's whole text.

    A null or empty text is its end mark alone. A text of any length is read whole; rows alike are learned as often as
    they occur and score alike; null ids are held out by the default rule, null and repeated ids are passed on; other
    columns are not read; an empty table stays empty. Where nothing can be learned every token has the same probability, 1.
    Words are told apart by 96 bits of a hash and longer n-grams by 56, each beside its part.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    hold_out = held_out(id_column) if hold_out is None else hold_out
    blocks = text_blocks(docs.select(F.struct(F.col(f"`{id_column}`").alias("id"), hold_out.alias("held_out")).alias("row"),
                                     F.col(f"`{text_column}`").alias("text")), "row", "text", BLOCK_BYTES)
    parts = max(1, math.ceil((blocks.agg(F.sum("size")).first()[0] or 0) / PART_BYTES))
    answers = stored(_ask(blocks, parts, order).groupBy("part").applyInArrow(_answer, ANSWERED), "counts")
    sums = answers.agg(F.sum("tokens"), F.sum("distinct")).first()
    n_tokens, n_distinct = (int(v or 0) for v in sums)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = grams(left["lengths"][0].as_py(), left["payload"][0].as_py(), order)
        counts = corpus_counts(own, list(zip(*(right[c].to_pylist() for c in ("part", "word_counts", "gram_counts")), strict=True)), parts)
        machine = automaton(own, counts, n_tokens, n_distinct, strength, added)
        ends = np.append(own.starts, len(own.tokens))
        base = np.log10((counts[0] + added) / (n_tokens + added * (n_distinct + 1)))
        real = own.tokens != BEGIN
        sums = np.add.reduceat(base[own.tokens] * real, own.starts)
        known = np.add.reduceat((counts[0][own.tokens] > 0) & real, own.starts, dtype=np.int64)
        scores = [machine.score(own.tokens[a + 1: b].tolist()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        ids = flat_ids(left)
        return pa.table({"id": ids.field("id"), "held_out": ids.field("held_out"), "n_tokens": pa.array(np.diff(ends) - 1),
                         "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(known), n_tokens)),
                         "base_score": pa.array(sums), "score": pa.array(scores, pa.float64())})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        run, RESULT.format(kind)).withColumnRenamed("id", id_column)
