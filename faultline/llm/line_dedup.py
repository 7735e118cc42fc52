"""Line dedup: repeated runs of lines found by prefix doubling over sequences of line ids; later copies go.

A text is the sequence of its lines with a word in them; a line's id is half of a 128-bit hash of the line without outer
white space. The other half goes into a second name that found runs carry, so runs count as equal by 128 bits or more.
A run counts where its lines hold `min_words` words or more. Any such run is covered by smallest runs of that kind,
one that begins at each line and one that ends at each, so these are enough (see `_runs`).

Round k names the runs of 2^k lines by the names of their halves, as prefix doubling names suffixes by rank, and keeps
only places whose run occurs elsewhere too; a smallest run of n lines is named by the two runs of 2^k <= n lines that
overlap in it. All suffixes with one name are an interval of the suffix array whose common prefix has that length;
its first member in order of (id, text, line) stays, all others lose these lines. Smallest runs have at most
`min_words` lines, which bounds the rounds, and each round only touches lines that have been seen to repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import flat_ids, row_blocks, unpack
from faultline.sources.scratch import stored

MIN_WORDS = 50
_BLANK = b" \t\n\x0b\x0c\r"
_MUL = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)

def line_spans(text: bytes) -> list[tuple[int, int]]:
    """(start, end) of each line with a word; the end includes the line break."""
    out, at = [], 0
    for part in text.split(b"\n"):
        if part.strip(_BLANK):
            out.append((at, min(at + len(part) + 1, len(text))))
        at += len(part) + 1
    return out


def _join_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (a >> np.uint64(31))) * _MUL + b
    h = (h ^ (h >> np.uint64(32))) * _STEP
    return h ^ (h >> np.uint64(29))


def names(ids: np.ndarray, depth: int) -> np.ndarray:
    """Names of the runs of 2^depth lines at each place, by doubling."""
    for k in range(depth):
        half = 1 << k
        if len(ids) <= half:
            return ids[:0]
        ids = _join_names(ids[:-half], ids[half:])
    return ids


def _runs(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first line, number of lines) of the smallest qualifying runs from each line on and up to each line."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    end = np.searchsorted(total, total[:-1] + min_words, "left")
    begin = np.searchsorted(total, total[1:] - min_words, "right") - 1
    ahead, back = np.flatnonzero(end <= n), np.flatnonzero(begin >= 0)
    first = np.concatenate([ahead, begin[back]])
    size = np.concatenate([end[ahead], back + 1]) - first
    both = np.unique(np.stack([first, size], axis=1), axis=0) if len(first) else np.zeros((0, 2), np.int64)
    return both[:, 0], both[:, 1]


LINES = "block long, doc int, id {}, mark long, seal long, ids binary, checks binary, words binary, longest int"


def _read_lines(blocks: DataFrame, id_column: str, id_type: str, min_words: int, short: bool) -> DataFrame:
    """A row for each text with lines: their ids and words, and the size of its longest smallest run; texts without a
    run (size 0) only if `short`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, wide = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        for batch in batches:
            for i in range(batch.num_rows):
                data, offsets = unpack(batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                raw = data.tobytes()
                docs, ids, checks, words, longest = [], [], [], [], []
                for doc in range(len(offsets) - 1):
                    lines = [x for x in raw[offsets[doc]: offsets[doc + 1]].split(b"\n") if x.strip(_BLANK)]
                    held = np.array([len(x.split()) for x in lines], np.int32)
                    if held.sum() >= min_words or short and lines:
                        docs.append(doc)
                        halves = np.frombuffer(b"".join([wide(x.strip(_BLANK)) for x in lines]), np.uint64).reshape(-1, 2)
                        ids.append(halves[:, 0].tobytes())
                        checks.append(halves[:, 1].tobytes())
                        words.append(held.tobytes())
                        longest.append(int(_runs(held, min_words)[1].max(initial=0)))
                marks, seals = (np.array([digest(x) for x in half], np.uint64).view(np.int64) for half in (ids, checks))
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column(0)[i].as_py()] * len(docs), pa.int64()), pa.array(docs, pa.int32()),
                    batch.column(3)[i].values.take(pa.array(docs, pa.int64())), pa.array(marks), pa.array(seals),
                    pa.array(ids, pa.binary()), pa.array(checks, pa.binary()), pa.array(words, pa.binary()), pa.array(longest, pa.int32())],
                    ["block", "doc", "id", "mark", "seal", "ids", "checks", "words", "longest"])

    narrow = blocks.select("block", "lengths", "payload", F.col(f"ids.`{id_column}`").alias("own"))
    return narrow.mapInArrow(run, LINES.format(id_type))


def _alive(column: pa.Array, i: int, n: int) -> np.ndarray:
    """Mask of the places that a round kept."""
    mask = np.zeros(n, bool)
    if column[i].is_valid:
        mask[column[i].values.to_numpy()] = True
    return mask


def _round(lines: DataFrame, depth: int) -> DataFrame:
    """`lines` with `alive`: places whose run of 2^depth lines occurs elsewhere; only texts with such places and
    with runs of that size to name stay among the candidates."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = 1 << (depth - 1) if depth else 0
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(2)[i].as_py(), np.uint64)
                own = names(ids, depth)
                places = np.arange(len(own))
                if depth:
                    before = _alive(batch.column(3), i, len(ids))
                    places = places[before[places] & before[places + half]]
                out.append((own[places].view(np.int64), places))
            counts = [len(p) for _, p in out]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([n for n, _ in out]) if out else np.zeros(0, np.int64)),
                pa.array(np.repeat(batch.column(0).to_numpy(), counts)), pa.array(np.repeat(batch.column(1).to_numpy(), counts)),
                pa.array(np.concatenate([p for _, p in out]).astype(np.int32) if out else np.zeros(0, np.int32))],
                ["name", "block", "doc", "place"])

    before = "alive" if depth else "cast(null as array<int>) AS alive"
    named = lines.where(F.col("longest") >= 1 << depth).selectExpr("block", "doc", "ids", before).mapInArrow(
        emit, "name long, block long, doc int, place int")
    # stored, so that the join takes both sides from plain exchanges and a hot line's rows can be split over tasks
    again = stored(named.groupBy("name").count().where("count > 1").select("name"), "again")
    kept = named.join(again, "name").groupBy("block", "doc").agg(F.sort_array(F.collect_list("place")).alias("alive"))
    return stored(lines.drop("alive").join(kept, ["block", "doc"]), "lines")


def _smallest_runs(lines: DataFrame, depth: int, min_words: int) -> DataFrame:
    """Named smallest runs of 2^depth to 2^(depth + 1) - 1 lines whose overlapping halves both occur elsewhere."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, parts = [], []
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(4)[i].as_py(), np.uint64)
                first, size = _runs(np.frombuffer(batch.column(5)[i].as_py(), np.int32), min_words)
                own, alive = names(ids, depth), _alive(batch.column(6), i, len(ids))
                other = names(np.frombuffer(batch.column(7)[i].as_py(), np.uint64), depth)
                fit = (size >= 1 << depth) & (size < 2 << depth)
                first, size = first[fit], size[fit]
                second = first + size - (1 << depth)
                both = alive[first] & alive[second]
                first, size, second = first[both], size[both], second[both]
                parts.append(np.stack([*(x.view(np.int64) for x in (own[first], own[second], _join_names(other[first], other[second]))), first, size]))
                owner += [i] * len(first)
            a, b, check, first, size = np.concatenate(parts, axis=1) if parts else np.zeros((5, 0), np.int64)
            place = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([
                *[batch.column(k).take(place) for k in range(4)], pa.array(a), pa.array(b), pa.array(check),
                pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32))],
                ["block", "doc", "id", "mark", "a", "b", "check", "first", "size"])

    id_type = lines.schema["id"].dataType.simpleString()
    return lines.select("block", "doc", "id", "mark", "ids", "words", "alive", "checks").mapInArrow(
        emit, f"block long, doc int, id {id_type}, mark long, a long, b long, check long, first int, size int")


def _cut(blocks: DataFrame, runs: DataFrame, docs: DataFrame, text_column: str) -> DataFrame:
    row_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        data, offsets = unpack(left["lengths"][0].as_py(), left["payload"][0].as_py())
        raw, by_doc = data.tobytes(), {}
        for doc, first, size in zip(*(right[c].to_pylist() for c in ("doc", "first", "size")), strict=True):
            by_doc.setdefault(doc, set()).update(range(first, first + size))
        texts, counts, gone = [], [], []
        for doc in range(len(offsets) - 1):
            text = raw[offsets[doc]: offsets[doc + 1]]
            spans, drop = line_spans(text), by_doc.get(doc, ())
            counts.append(len(spans))
            gone.append(len(drop))
            if drop:
                keep, at = [], 0
                for i, (a, b) in enumerate(spans):
                    if i in drop:
                        keep.append(text[at:a])
                        at = b
                text = b"".join(keep) + text[at:]
            texts.append(text)
        return pa.table({"row": flat_ids(left), "text": pa.array(texts, pa.binary()).cast(pa.string()),
                         "lines": pa.array(counts, pa.int64()), "removed": pa.array(gone, pa.int64())})

    rows = blocks.groupBy("block").cogroup(runs.groupBy("block")).applyInArrow(
        run, f"row {row_type}, text string, lines long, removed long")
    columns = [F.col("text").alias(c) if c == text_column else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return rows.select(F.struct(*columns).alias("row"), F.col("lines").alias("n_lines"), F.col("removed").alias("n_removed"))


def remove_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                          min_words: int = MIN_WORDS, whole_texts: bool = False) -> DataFrame:
    """(row, n_lines, n_removed): rows of `docs` with shortened texts, lines with a word, and those of them that went.

    With `whole_texts` all lines of a shorter text are a run too, so later copies of it lose them.
    Kept is the copy of the smallest id (null first), then of the smallest hash of the text, then the first line;
    rows alike are copies of each other and all but one lose what qualifies. Copies within a text count too. Null
    texts become empty, empty and short texts stay, other columns come along, an empty table stays empty. Lines
    differ if anything but outer white space does; lines without a word are no part of runs and stay.
    """
    blocks = row_blocks(docs, text_column)
    id_type = docs.schema[id_column].dataType.simpleString()
    lines = stored(_read_lines(blocks, id_column, id_type, min_words, whole_texts), "lines")
    depth, found = 0, None
    if whole_texts:
        # named by the hash of all lines; no other run has names like that, and no lines of these texts are named
        found = lines.where("longest = 0").selectExpr(
            "block", "doc", "id", "mark", "mark AS a", "0L AS b", "seal AS check", "0 AS first", "cast(octet_length(ids) / 8 AS int) AS size")
        lines = lines.where("longest > 0")
    while True:
        lines = _round(lines, depth)
        runs = _smallest_runs(lines, depth, min_words)
        found = runs if found is None else found.unionAll(runs)
        depth += 1
        if lines.where(F.col("longest") >= 1 << depth).isEmpty():
            break
    found = stored(found, "runs")
    order = F.struct("id", "mark", "block", "doc", "first")
    first = stored(found.groupBy("size", "a", "b", "check").agg(
        F.min(order).alias("one"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    later = found.join(first, ["size", "a", "b", "check"]).where(order != F.col("one")).select("block", "doc", "first", "size")
    return _cut(blocks, later, docs, text_column)
