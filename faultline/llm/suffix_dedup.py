"""Suffix-array dedup: removes bytes covered by a long string that starts more than once in the corpus.

A string of `length` bytes contains an anchor: the place with the smallest hash of the next GRAM bytes among its
first SPAN places. Equal strings have it at the same place, so repeats are looked for among strings around equal
anchors, a sparse suffix array.
1. `core`: the bytes that every string of an anchor shares. An anchor whose core is unique has no repeats.
2. `full`: all bytes that its strings cover. Where it occurs twice all of them are repeats, and nothing is compared.
3. The rest, the ends of repeated passages, are sorted as suffixes from the anchor: each block sorts its own,
   front-codes the run and sends it by range; a loser tree merges the runs of a range. It compares the prefix that
   an entry shares with the last output first, so no byte known to be equal is read again. With the common prefixes
   to the right and those of the sorted bytes to the left, classes of equal strings follow for each distance.
Contexts of a core that are more than MANY are dealt out before they are sorted: by sector of the anchor's distance and by
the bytes that all strings of a sector share, ever narrower sectors until a group is small enough. A sector of
one distance shares whole strings, so nothing is left to compare.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import text_blocks, unpack
from faultline.sources.scratch import stored

LENGTH = 400
SPAN = 240
GRAM = 12
#: Contexts of one core that are sorted in one task, at most; beyond that the core is dealt out by sectors of these widths.
MANY = 50_000
SECTORS = (60, 15, 4, 1)
#: Suffixes merged in one task, about.
RANGE_SUFFIXES = 20_000
#: Cores of which one in so many contexts is a candidate for a range bound.
SAMPLE = 512

_POWERS = np.cumprod(np.full(GRAM, 0x9E3779B97F4A7C15, np.uint64))
_LETTER = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
CORE = LENGTH - SPAN + 1


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last): each anchor and the starts of the strings it stands for."""
    starts = len(text) - LENGTH + 1
    if starts <= 0:
        return (np.zeros(0, np.int64),) * 3
    letters = _LETTER[text]
    places = starts + SPAN - 1
    hashed = np.zeros(places, np.uint64)
    for k in range(GRAM):
        hashed += letters[k: k + places] * _POWERS[k]
    hashed = (hashed ^ (hashed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    key = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(places, dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < SPAN:
        key = np.minimum(key[: starts], key[SPAN - width: SPAN - width + starts])
    place = (key[:starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [starts]])
    return place[cut[:-1]], cut[:-1], cut[1:] - 1


ANCHORS = "core long, full long, doc int, place int, first int, last int, block long, sample binary"


def _signed(values: Sequence[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _find_anchors(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column(0)[i].as_py()
                data, offsets = unpack(batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                docs, found, cores, fulls, samples = [], [], [], [], []
                for doc in range(len(offsets) - 1):
                    if offsets[doc + 1] - offsets[doc] < LENGTH:
                        continue
                    text = data[offsets[doc]: offsets[doc + 1]]
                    place, first, last = anchors(text)
                    raw = text.tobytes()
                    for p, a, b in zip(place.tolist(), first.tolist(), last.tolist(), strict=True):
                        core = digest(raw[p: p + CORE])
                        cores.append(core)
                        fulls.append(digest(raw[a: b + LENGTH], p - a))
                        samples.append(raw[p: p + CORE] if fulls[-1] % SAMPLE == 0 else None)
                    docs.append(np.full(len(place), doc, np.int32))
                    found.append(np.stack([place, first, last]).astype(np.int32))
                if found:
                    place, first, last = np.concatenate(found, axis=1)
                    yield pa.RecordBatch.from_arrays([
                        _signed(cores), _signed(fulls), pa.array(np.concatenate(docs)), pa.array(place), pa.array(first),
                        pa.array(last), pa.array(np.full(len(cores), block)), pa.array(samples, pa.binary())],
                        ["core", "full", "doc", "place", "first", "last", "block", "sample"])

    return blocks.select("block", "lengths", "payload").mapInArrow(run, ANCHORS)


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first `known` bytes are not read."""
    end = min(len(a), len(b))
    step = 16
    while known < end:
        if a[known: known + step] != b[known: known + step]:
            while step > 1:
                step >>= 1
                if a[known: known + step] == b[known: known + step]:
                    known += step
            return min(known, end)
        known += step
        step = min(step * 2, 256)
    return end


def front_code(run: list[bytes]) -> tuple[list[int], list[bytes]]:
    """(prefix shared with the entry before, the bytes after it) of a sorted run."""
    shared = [0] + [common_prefix(a, b) for a, b in zip(run, run[1:], strict=False)]
    return shared, [s[n:] for s, n in zip(run, shared, strict=True)]


class LoserTree:
    """Merges front-coded sorted runs. Yields (run, index, suffix, prefix shared with the suffix yielded before).

    A loser keeps the length of the prefix that it shares with the winner that passed it, which is the last output
    by the time it is asked again. Of two entries the one that shares more with the last output comes first; only if
    both share the same length are bytes compared, from there on.
    """

    def __init__(self, runs: Sequence[tuple[Sequence[int], Sequence[bytes]]]):
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.at = [0] * len(runs)
        self.head: list[bytes | None] = [None] * self.size
        self.shared = [0] * self.size
        for r, (_, rests) in enumerate(runs):
            self.head[r] = rests[0] if rests else None
        self.loser = [-1] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.loser[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared prefix is then one with the winner."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        m, n = self.shared[a], self.shared[b]
        if m != n:
            return (a, b) if m > n else (b, a)
        n = common_prefix(x, y, m)
        if x[n: n + 1] <= y[n: n + 1]:
            self.shared[b] = n
            return a, b
        self.shared[a] = n
        return b, a

    def __iter__(self) -> Iterator[tuple[int, int, bytes, int]]:
        while (suffix := self.head[self.winner]) is not None:
            run, shared = self.winner, self.shared[self.winner]
            index = self.at[run]
            yield run, index, suffix, shared
            codes, rests = self.runs[run]
            self.at[run] = index = index + 1
            if index < len(rests):
                self.shared[run] = codes[index]
                self.head[run] = suffix[: codes[index]] + rests[index]
            else:
                self.head[run] = None
            winner, node = run, (run + self.size) >> 1
            while node:
                winner, self.loser[node] = self._play(winner, self.loser[node])
                node >>= 1
            self.winner = winner


RUNS = "part int, block long, head binary, shared binary, rest binary, left binary"


def _send_runs(blocks: DataFrame, wanted: DataFrame, bounds: list[bytes]) -> DataFrame:
    """The contexts of each block as sorted front-coded runs, cut at the range bounds."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        data, offsets = unpack(left["lengths"][0].as_py(), left["payload"][0].as_py())
        doc, place, first, last = (right[c].to_numpy().astype(np.int64) for c in ("doc", "place", "first", "last"))
        ask = right["ask"].to_numpy(zero_copy_only=False)
        raw, base = data.tobytes(), offsets[doc]
        suffix = [raw[s:e] for s, e in zip((base + place).tolist(), (base + last + LENGTH).tolist(), strict=True)]
        before = [raw[s:e] for s, e in zip((base + first).tolist(), (base + place).tolist(), strict=True)]
        order = sorted(range(len(suffix)), key=suffix.__getitem__)
        dealt = right["part"].to_pylist()
        part = [bisect.bisect_right(bounds, suffix[i][:CORE]) if dealt[i] is None else dealt[i] for i in order]
        order = [order[k] for k in sorted(range(len(order)), key=part.__getitem__)]
        part.sort()
        out = {k: [] for k in ("part", "block", "head", "shared", "rest", "left")}
        at = 0
        while at < len(order):
            end = bisect.bisect_right(part, part[at])
            own = order[at:end]
            shared, rests = front_code([suffix[i] for i in own])
            head = np.stack([doc[own], place[own], first[own], last[own], ask[own].astype(np.int64)]).astype(np.int32)
            for k, v in zip(out, (part[at], left["block"][0].as_py(), head.tobytes(), np.array(shared, np.int16).tobytes(),
                                  b"".join(rests), b"".join(before[i] for i in own)), strict=True):
                out[k].append(v)
            at = end
        return pa.table({"part": pa.array(out["part"], pa.int32()), "block": pa.array(out["block"], pa.int64()), **{
            k: pa.array(out[k], pa.binary()) for k in ("head", "shared", "rest", "left")}})

    return blocks.select("block", "lengths", "payload").groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(run, RUNS)


MARKS = "block long, doc int, first int, last int"


def _split(data: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [data[e - n: e] for e, n in zip(ends, lengths.tolist(), strict=True)]


def _merge(group: pa.Table) -> pa.Table:
    """Starts (first..last) of repeated strings among the contexts of one range."""
    heads = [np.frombuffer(h, np.int32).reshape(5, -1).astype(np.int64) for h in group["head"].to_pylist()]
    shared = [np.frombuffer(s, np.int16).tolist() for s in group["shared"].to_pylist()]
    rests = [_split(r, h[3] + LENGTH - h[1] - np.array(s)) for r, h, s in zip(
        group["rest"].to_pylist(), heads, shared, strict=True)]
    begin = np.concatenate([[0], np.cumsum([h.shape[1] for h in heads])])
    merged = [(begin[r] + i, n) for r, i, _, n in LoserTree(list(zip(shared, rests, strict=True)))]
    order = np.array([i for i, _ in merged], np.int64)
    right = np.array([n for _, n in merged], np.int64)
    doc, place, first, last, ask = np.concatenate(heads, axis=1)
    block = np.repeat(group["block"].to_numpy(), [h.shape[1] for h in heads])

    # bytes to the left, nearest first, zeros where there are none
    reach, least = place - first, place - last
    behind = np.frombuffer(b"".join(group["left"].to_pylist()), np.uint8)
    near = np.zeros((len(place), SPAN), np.uint8)
    column = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
    near[np.repeat(np.arange(len(place)), reach), np.repeat(reach, reach) - 1 - column] = behind
    by_left = np.argsort(near.view(f"V{SPAN}").ravel(), kind="stable")
    differ = near[by_left[1:]] != near[by_left[:-1]]
    left = np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), SPAN)])

    hits = []
    classes = np.zeros(len(place), np.int64)
    for d in range(SPAN):
        held = np.flatnonzero((least <= d) & (reach >= d))
        if len(held) < 2:
            continue
        classes[order] = np.cumsum(right < LENGTH - d) * (len(place) + 1)
        classes[by_left] += np.cumsum(left < d)
        ranked = held[np.argsort(classes[held], kind="stable")]
        same = classes[ranked[1:]] == classes[ranked[:-1]]
        again = np.zeros(len(ranked), bool)
        again[1:] |= same
        again[:-1] |= same
        hit = ranked[again & (ask[ranked] == 1)]
        hits.append(np.stack([hit, place[hit] - d]))
    item, start = np.concatenate(hits, axis=1) if hits else np.zeros((2, 0), np.int64)
    ordered = np.lexsort((start, item))
    item, start = item[ordered], start[ordered]
    breaks = np.flatnonzero((np.diff(item) != 0) | (np.diff(start) != 1)) + 1
    opens, closes = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(item)]]) - 1
    if not len(item):
        opens = closes = np.zeros(0, np.int64)
    return pa.table({"block": pa.array(block[item[opens]], pa.int64()), "doc": pa.array(doc[item[opens]], pa.int32()),
                     "first": pa.array(start[opens], pa.int32()), "last": pa.array(start[closes], pa.int32())})


def _sectors(blocks: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The contexts cut by sectors of `width` distances, each with a hash of the bytes that all its strings share."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        data, offsets = unpack(left["lengths"][0].as_py(), left["payload"][0].as_py())
        raw = data.tobytes()
        out: list[tuple] = []
        for doc, place, first, last, ask in zip(*(right[c].to_pylist() for c in ("doc", "place", "first", "last", "ask")), strict=True):
            base = int(offsets[doc])
            for near in range((place - last) // width * width, place - first + 1, width):
                far = near + width - 1
                shared = raw[base + place - near: base + place + LENGTH - far]
                out.append((xxhash.xxh3_128_digest(shared, near), doc, place, max(first, place - far), min(last, place - near), ask))
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        return pa.table({"block": pa.array([left["block"][0].as_py()] * len(out), pa.int64()), **{
            k: pa.array(v, t) for k, v, t in zip(("shared", "doc", "place", "first", "last", "ask"), columns, kinds, strict=True)}})

    return blocks.select("block", "lengths", "payload").groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(
        run, "block long, shared binary, doc int, place int, first int, last int, ask boolean")


def _deal(blocks: DataFrame, heavy: DataFrame, ranges: int) -> tuple[list[DataFrame], DataFrame | None]:
    """(contexts of heavy cores with the part that sorts them, marks of strings that whole groups share)."""
    dealt = []
    for width in SECTORS:
        if heavy.isEmpty():
            return dealt, None
        cut = stored(_sectors(blocks, heavy, width), "sectors")
        sizes = stored(cut.groupBy("shared").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        # stored, so that adaptive execution can split a hot group
        cut = stored(cut.join(sizes, "shared"), "groups")
        if width == 1:
            return dealt, cut.where("ask").select("block", "doc", "first", "last")
        few = cut.where(F.col("n") <= MANY)
        parts = max(1, math.ceil(few.count() / RANGE_SUFFIXES))
        dealt.append(few.withColumn("part", (F.pmod(F.xxhash64("shared"), F.lit(parts)) + ranges).cast("int")))
        ranges += parts
        heavy = cut.where(F.col("n") > MANY)
    return dealt, None


RESULT = "id {}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, kept binary"


def _cut(blocks: DataFrame, marks: DataFrame, id_type: str, with_text: bool) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        data, offsets = unpack(left["lengths"][0].as_py(), left["payload"][0].as_py())
        rows = np.diff(offsets)
        depth = np.zeros(len(data) + 1, np.int64)
        base = offsets[right["doc"].to_numpy()]
        np.add.at(depth, base + right["first"].to_numpy(), 1)
        np.add.at(depth, base + right["last"].to_numpy() + LENGTH, -1)
        gone = np.cumsum(depth[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads = offsets[:-1][rows > 0]
        begins[heads] = gone[heads]
        removed = np.concatenate([[0], np.cumsum(gone)])
        spans = np.concatenate([[0], np.cumsum(begins)])
        kept = data[~gone].tobytes()
        at = offsets - removed[offsets]
        parts = [kept[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.table({
            "id": left["ids"].combine_chunks().flatten(), "n_bytes": pa.array(rows, pa.int64()),
            "n_removed": pa.array(removed[offsets[1:]] - removed[offsets[:-1]], pa.int64()),
            "n_spans": pa.array(spans[offsets[1:]] - spans[offsets[:-1]], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()),
            "n_kept": pa.array([len(p) for p in parts], pa.int64()),
            "kept": pa.array(parts if with_text else [None] * len(parts), pa.binary())})

    return blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(run, RESULT.format(id_type))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_text: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, kept) of every row; `kept` holds the bytes left, which need
    not be whole characters, and is null where `with_text` is false.

    All copies of a repeated string go, the first one too. Null and empty texts keep nothing and lose nothing; texts
    under LENGTH bytes stay; rows alike are copies of each other; null and repeated ids are passed on; an empty
    table stays empty; other columns are not read.
    """
    id_type = docs.schema[id_column].dataType.simpleString()
    blocks = text_blocks(docs, id_column, text_column)
    found = stored(_find_anchors(blocks), "anchors")
    # stored, so that the join takes both sides from plain exchanges and a hot core's rows can be split over tasks
    repeated = stored(found.groupBy("core").count().where("count > 1").select("core"), "repeated")
    hits = stored(found.join(repeated, "core"), "hits")
    contexts = hits.groupBy("core", "full").agg(F.count("*").alias("copies"), F.min(F.struct(
        "block", "doc", "place")).alias("one"))
    contexts = stored(contexts, "contexts")
    cores = stored(contexts.groupBy("core").agg(F.count("*").alias("contexts")), "cores")
    state = stored(hits.join(contexts, ["core", "full"]).join(cores, "core"), "states")

    whole = state.where("copies > 1").select("block", "doc", "first", "last")
    once = state.where("contexts > 1").where((F.col("copies") == 1) | (F.struct("block", "doc", "place") == F.col("one"))).withColumn(
        "ask", F.col("copies") == 1)
    few = once.where(F.col("contexts") <= MANY)
    columns = ("block", "doc", "place", "first", "last", "ask", "part")
    wanted = few.withColumn("part", F.lit(None).cast("int")).select(*columns)
    ranges = max(1, math.ceil(few.count() / RANGE_SUFFIXES))
    # candidates weigh as much as their contexts; a core is not cut, so a bound is one of them
    sample = sorted(r.sample for r in few.where("sample is not null").select("sample", F.xxhash64("block", "doc", "place").alias("h")).orderBy(
        "h").limit(64 * ranges).collect()) if ranges > 1 else []
    bounds = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []
    dealt, same = _deal(blocks, once.where(F.col("contexts") > MANY), ranges)
    for more in dealt:
        wanted = wanted.unionAll(more.select(*columns))
    every = whole.unionAll(_send_runs(blocks, wanted, bounds).groupBy("part").applyInArrow(_merge, MARKS))
    if same is not None:
        every = every.unionAll(same)
    return _cut(blocks, every, id_type, with_text).withColumnRenamed("id", id_column)
