"""N-gram Jaccard join by T-occurrence search over inverted lists (DivideSkip).

The way of a document:
1. Its distinct 5-word shingles are hashed. How many documents hold a shingle is counted by hash ranges of 4-byte
   fingerprints; the answer comes back as one class (0: this text alone, else log2 of the count) per shingle.
2. A set that links needs three quarters of its shingles in some other set, so sets with fewer shared ones are done.
   Fingerprints that clash only let a set through that is then searched in vain; no link is lost.
3. The others meet over their rarest shared shingles: two sets that link have one in common there (prefix filter).
   Sets so connected are a cluster; a cluster is searched in one task, a large one in many (see `_search_clusters`).
4. The search sets a query's longest lists aside, merges the short ones and probes the long ones by bisection.
   For components alone, sets known to be connected are not compared again; to count links every pair is verified.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import flat_ids, row_blocks, take_rows, text_blocks, unpack
from faultline.llm.graph import components
from faultline.llm.shingles import shingle_sets
from faultline.sources.scratch import stored

#: A pair links at PERCENT or more of its union in common.
PERCENT = 75
DENOMINATOR = 100 + PERCENT
#: Shingles of one hash range, about.
RANGE_TOKENS = 1_000_000
#: Sets and bytes searched together in one task; larger clusters are split.
TASK_SETS, TASK_BYTES = 3000, 8 << 20


def least_overlap(n: int, m: int) -> int:
    """Smallest intersection of sets of n and m shingles that links them."""
    return -(-PERCENT * (n + m) // DENOMINATOR)


def least_part(n: int) -> int:
    """Shingles that a set of n must share with any one set it links to."""
    return -(-PERCENT * n // 100)


def _fingerprints(tokens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(range bounds, 4-byte fingerprint) of sorted tokens; a range is the top `bits` bits."""
    bounds = np.searchsorted(tokens >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return bounds, ((tokens >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")


def _block_tokens(lengths: bytes, payload: bytes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(sets of the texts, distinct tokens, number of texts with each)."""
    sets = shingle_sets(*unpack(lengths, payload))
    tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
    return sets, tokens, counts


def _token_classes(blocks: DataFrame, bits: int) -> DataFrame:
    """(block, part, classes): how common the distinct tokens of each block are, by hash range."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, lengths, payload = (batch.column(k)[i].as_py() for k in range(3))
                _, tokens, counts = _block_tokens(lengths, payload)
                bounds, prints = _fingerprints(tokens, bits)
                parts = np.flatnonzero(np.diff(bounds))
                prints = [prints[bounds[p]: bounds[p + 1]].tobytes() for p in parts]
                more = []
                for p in parts:
                    own = counts[bounds[p]: bounds[p + 1]]
                    many = np.flatnonzero(own > 1)
                    more.append(np.stack([many, own[many]]).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(parts), block)), pa.array(parts.astype(np.int32)),
                    pa.array(prints, pa.binary()), pa.array(more, pa.binary())], ["block", "part", "prints", "more"])

    def count(group: pa.Table) -> pa.Table:
        prints = [np.frombuffer(x, "<u4") for x in group["prints"].to_pylist()]
        counts = [np.ones(len(x), np.int64) for x in prints]
        for c, more in zip(counts, group["more"].to_pylist(), strict=True):
            place, many = np.frombuffer(more, "<u4").reshape(2, -1)
            c[place] = many
        _, back = np.unique(np.concatenate(prints), return_inverse=True)
        held = np.bincount(back, weights=np.concatenate(counts))
        kind = np.minimum(np.log2(held).astype(np.uint8) + (held > 1), 60).astype(np.uint8)[back]
        ends = np.cumsum([0] + [len(x) for x in prints])
        return pa.table({"block": group["block"], "part": group["part"], "classes": pa.array(
            [zlib.compress(kind[a:b].tobytes(), 1) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})

    ranged = blocks.select("block", "lengths", "payload").mapInArrow(
        emit, "block long, part int, prints binary, more binary")
    return ranged.groupBy("part").applyInArrow(count, "block long, part int, classes binary")


def _sets(blocks: DataFrame, classes: DataFrame, bits: int, id_type: str) -> DataFrame:
    """(block, doc, id, set_id, n, tokens, copies) of each text; `tokens` holds the shared ones, rarest first, of the first text
    of a block with that set, where there are enough of them to link at all, and `copies` how many texts of the block have it."""
    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        sets, tokens, _ = _block_tokens(left["lengths"][0].as_py(), left["payload"][0].as_py())
        parts = sorted(zip(right["part"].to_pylist(), right["classes"].to_pylist(), strict=True))
        kind = np.frombuffer(b"".join(zlib.decompress(c) for _, c in parts), np.uint8)
        set_ids, shared, seen = [], [], set()
        for own in sets:
            set_id = xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None
            set_ids.append(set_id)
            part = None
            if len(own) and set_id not in seen:
                seen.add(set_id)
                k = kind[np.searchsorted(tokens, own)]
                if np.count_nonzero(k) >= least_part(len(own)):
                    keep = np.flatnonzero(k)
                    part = own[keep][np.argsort(k[keep], kind="stable")].tobytes()
            shared.append(part)
        held = Counter(set_ids)
        copies = [held[s] if part is not None else None for s, part in zip(set_ids, shared, strict=True)]
        own_block = left["block"][0].as_py()
        return pa.table({"block": pa.array([own_block] * len(sets), pa.int64()), "doc": pa.array(range(len(sets)), pa.int32()),
                         "id": flat_ids(left), "set_id": pa.array(set_ids, pa.binary()),
                         "n": pa.array([len(s) for s in sets], pa.int64()), "tokens": pa.array(shared, pa.binary()),
                         "copies": pa.array(copies, pa.int64())})

    return blocks.groupBy("block").cogroup(classes.groupBy("block")).applyInArrow(
        join, f"block long, doc int, id {id_type}, set_id binary, n long, tokens binary, copies long")


class Lists:
    """Inverted lists of some sets, and groups of sets already known to be connected."""

    def __init__(self, sizes: np.ndarray, tokens: list[np.ndarray], group: np.ndarray):
        """Sets come in order of size; a set is searched among the earlier ones."""
        self.sizes, self.group = sizes, group
        counts = np.array([len(t) for t in tokens])
        every = np.concatenate(tokens)
        self.distinct, lists = np.unique(every, return_inverse=True)
        order = np.argsort(lists, kind="stable")
        self.members = np.repeat(np.arange(len(tokens)), counts)[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(lists, minlength=len(self.distinct)))])
        ends = np.cumsum(counts)
        self.lists = [lists[e - c: e] for e, c in zip(ends, counts, strict=True)]

    def _merge(self, lists: np.ndarray, below: int) -> np.ndarray:
        """How many of these lists hold each member under `below`, by one pass over them."""
        span = self.starts[lists + 1] - self.starts[lists]
        at = np.repeat(self.starts[lists] - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(int(span.sum()))
        return np.bincount(self.members[at], minlength=below + 1)[:below]

    def _probe(self, lists: np.ndarray, member: int) -> int:
        """How many of these lists hold the member, all bisected at once."""
        low, high = self.starts[lists].copy(), self.starts[lists + 1].copy()
        end = high.copy()
        while np.any(open_ := low < high):
            middle = (low + high) >> 1
            less = self.members[np.minimum(middle, len(self.members) - 1)] < member
            low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
        found = low < end
        return int(np.count_nonzero(self.members[low[found]] == member))

    def _candidates(self, query: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        """(members, counts, long lists, merged): earlier sets of the mask that may link to the query.

        A member that occurs often enough in all lists occurs `need - len(long)` times in the short ones, which `counts`
        holds. Where so many do that probing the long lists for each would read more than the lists hold, those are
        merged as well: then the counts are whole and the members are the links.
        """
        n, lists = int(self.sizes[query]), self.lists[query]
        need = least_part(n)
        if len(lists) < need:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), lists[:0], True
        size = self.starts[lists + 1] - self.starts[lists]
        lists = lists[np.argsort(size, kind="stable")]
        aside = min(need - 1, int(need / (0.01 * math.log2(int(size.max()) + 1) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside:]
        counts = self._merge(short, query)
        found = np.flatnonzero((counts >= need - aside) & others & (100 * self.sizes[:query] >= PERCENT * n))
        steps = len(long) * max(1, int(size.max()).bit_length())
        merged = len(found) * steps > int((self.starts[long + 1] - self.starts[long]).sum())
        if merged:
            counts = counts + self._merge(long, query)
            found = found[DENOMINATOR * counts[found] >= PERCENT * (n + self.sizes[found])]
        return found, counts[found], long, merged

    def _verified(self, query: int, member: int, count: int, long: np.ndarray) -> bool:
        """Whether a member with so many of the short lists links to the query."""
        wanted = least_overlap(int(self.sizes[query]), int(self.sizes[member]))
        return count + len(long) >= wanted and count + self._probe(long, member) >= wanted

    def _join(self, query: int, members: np.ndarray) -> None:
        """Makes one group of those of the query and the members."""
        old = np.unique(self.group[members])
        old = old[old != self.group[query]]
        if len(old):
            self.group[np.isin(self.group, old)] = self.group[query]

    def search(self, query: int, only: np.ndarray | None = None) -> Iterator[int]:
        """Earlier sets of other groups that link to the query, as few as connect them; joins their groups as it goes."""
        others = self.group[:query] != self.group[query]
        if only is not None:
            others &= only[:query] | only[query]
        found, counts, long, merged = self._candidates(query, others)
        order = np.argsort(-counts, kind="stable")
        for member, count in zip(found[order].tolist(), counts[order].tolist(), strict=True):
            if self.group[member] != self.group[query] and (merged or self._verified(query, member, count, long)):
                yield member
                self._join(query, np.array([member]))

    def search_all(self, query: int, others: np.ndarray) -> np.ndarray:
        """All earlier sets of the mask that link to the query, whatever their groups; joins these."""
        found, counts, long, merged = self._candidates(query, others)
        if not merged:
            good = [self._verified(query, m, c, long) for m, c in zip(found.tolist(), counts.tolist(), strict=True)]
            found = found[np.array(good, bool)]
        self._join(query, found)
        return found


def _links(group: pa.Table) -> pa.Table:
    """Links (a, b) between sets of one task that were in different groups; enough of them to connect what connects."""
    group = group.sort_by([("n", "ascending"), ("sid", "ascending")])
    sid, asked = group["sid"].to_numpy(), group["asked"].to_numpy(zero_copy_only=False)
    known = np.unique(group["label"].to_numpy(), return_inverse=True)[1]
    lists = Lists(group["n"].to_numpy(), [np.frombuffer(t, np.uint64) for t in group["tokens"].to_pylist()], known)
    only = None if asked.all() else asked
    pairs = [(sid[q], sid[m]) for q in range(len(sid)) for m in lists.search(q, only)]
    return pa.table({"a": pa.array([int(a) for a, _ in pairs], pa.int64()), "b": pa.array([int(b) for _, b in pairs], pa.int64())})


def _count_links(group: pa.Table) -> pa.Table:
    """(a, b, links) of the sets of one task that link to any: a set that `a` is connected with, and the texts it links to.

    The task has one part of a cluster, or two parts whose pairs across are looked at.
    """
    group = group.sort_by([("n", "ascending"), ("sid", "ascending")])
    sid, part, copies = (group[c].to_numpy() for c in ("sid", "part", "copies"))
    lists = Lists(group["n"].to_numpy(), [np.frombuffer(t, np.uint64) for t in group["tokens"].to_pylist()], np.arange(len(sid)))
    whole = group["low"][0].as_py() == group["high"][0].as_py()
    links = np.zeros(len(sid), np.int64)
    for q in range(len(sid)):
        found = lists.search_all(q, np.ones(q, bool) if whole else part[:q] != part[q])
        links[q] += copies[found].sum()
        links[found] += copies[q]
    linked = np.flatnonzero(links)
    return pa.table({"a": pa.array(sid[linked]), "b": pa.array(sid[lists.group[linked]]), "links": pa.array(links[linked])})


def _dealt(clusters: DataFrame, shares: int) -> DataFrame:
    """`clusters` of two sets or more with the number of parts each is dealt to: one, or as many as make `shares` fit a task."""
    shaped = clusters.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum(F.octet_length("tokens")).alias("bytes"))
    tasks = F.greatest(F.col("sets") / TASK_SETS, F.col("bytes") / TASK_BYTES)
    shaped = shaped.where("sets > 1").select("cluster", "sets", F.when(tasks > 1, F.ceil(tasks * shares)).otherwise(1).cast("int").alias("parts"))
    return stored(clusters.join(shaped, "cluster"), "clusters")


def _own_part() -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), "sid"), F.col("parts").cast("long")).cast("int")


def _search_all(clusters: DataFrame) -> DataFrame:
    """(node, label, links) of linked sets: each pair of a cluster meets in one task and is verified there.

    A cluster that fits a task is searched whole. A larger one is dealt to parts, and each part meets itself and every
    other, so work and copies of its sets grow with its square, as its pairs do; only sums per set leave a task.
    """
    met = _dealt(clusters, 2).withColumn("part", _own_part()).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("cluster", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"),
                     "part", "sid", "n", "tokens", "copies")
    links = stored(met.groupBy("cluster", "low", "high").applyInArrow(_count_links, "a long, b long, links long"), "set-links")
    sums = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    return components(links.select("a", "b")).join(sums, "node")


def _search_clusters(clusters: DataFrame) -> DataFrame:
    """Labels (node, label) of linked sets.

    A cluster that fits a task is searched whole. A larger one is dealt to parts, each searched with one common
    sample of the cluster, which joins nearly all that belongs together. For the rest two sets of different groups
    are never both in the cluster's largest group, so only the sets outside it are sent to every part, in chunks:
    all pairs that may still join groups meet in one task, and none within the largest group is looked at.
    """
    dealt = _dealt(clusters, 1)
    mix = F.pmod(F.xxhash64("sid"), F.lit(1 << 30))
    own = _own_part()
    in_sample = (F.col("parts") > 1) & (mix * F.col("parts") * 8 < F.lit(1 << 30))
    first = dealt.withColumn("part", F.explode(F.when(
        in_sample, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))))
    columns = ["cluster", "part", "chunk", "sid", "n", "tokens", "label", "asked"]
    first = first.withColumns({"chunk": F.lit(0), "label": F.col("sid"), "asked": F.lit(True)}).select(*columns)
    schema = "a long, b long"
    links = stored(first.groupBy("cluster", "part", "chunk").applyInArrow(_links, schema), "set-links")
    labels = components(links)
    large = dealt.where("parts > 1")
    if large.isEmpty():
        return labels
    named = stored(large.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn(
        "label", F.coalesce("label", "sid")), "named")
    main = named.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    named = stored(named.join(main, "cluster"), "named")
    outside = named.where("label <> main")
    share = outside.groupBy("cluster").agg(F.greatest(
        F.ceil(F.count("*") / TASK_SETS), F.ceil(F.sum(F.octet_length("tokens")) / TASK_BYTES)).cast("int").alias("chunks"))
    asked = outside.join(share, "cluster").withColumn(
        "chunk", F.pmod(F.xxhash64(F.lit("chunk"), "sid"), F.col("chunks").cast("long")).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("asked", F.lit(True))
    there = named.join(share, "cluster").withColumn("part", own).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("asked", F.lit(False))
    met = asked.select(*columns).unionAll(there.select(*columns))
    return components(links.unionAll(stored(met.groupBy("cluster", "part", "chunk").applyInArrow(_links, schema), "set-links")))


def _members(blocks: DataFrame, counted: bool = False) -> DataFrame:
    """(block, doc, id, set_id, n, key) of each text; texts of one component have one key, empty sets none.

    If `counted`, also `links`: the number of other texts that each links to.
    """
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    size = blocks.agg(F.sum("size").alias("s")).first().s or 0
    bits = max(4, math.ceil(math.log2(max(1, size / 7 / RANGE_TOKENS))))
    rows = stored(_sets(blocks, _token_classes(blocks, bits), bits, id_type), "sets")
    sets = rows.where("tokens is not null").groupBy("set_id").agg(
        F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.sum("copies").alias("copies"))
    sets = stored(stored(sets, "candidates").withColumn("sid", F.monotonically_increasing_id()), "candidates")

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for n, tokens in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                shared = np.frombuffer(tokens, np.int64)
                heads.append(shared[: len(shared) - least_part(n) + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.list_(pa.int64()))], ["sid", "heads"])

    heads = sets.select("sid", "n", "tokens").mapInArrow(rarest, "sid long, heads array<long>")
    heads = stored(heads.select("sid", F.explode("heads").alias("token")), "heads")
    # stored, so that the join takes both sides from plain exchanges and a hot token's rows can be split over tasks
    roots = stored(heads.groupBy("token").agg(
        F.min("sid").alias("a"), F.max("sid").alias("top")).where("a < top").drop("top"), "roots")
    meet = heads.join(roots, "token").where("a < sid").select("a", F.col("sid").alias("b")).distinct()
    clusters = sets.join(components(meet).select(F.col("node").alias("sid"), F.col("label").alias("cluster")), "sid")
    labels = (_search_all(clusters) if counted else _search_clusters(clusters)).withColumnRenamed("node", "sid")
    own, more = sets.select("sid", "set_id", "copies"), []
    if counted:
        links = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")
        joined = own.join(labels, "sid", "left").select("set_id", "label", links).where("links > 0")
        more = [F.coalesce("links", F.lit(0)).cast("long").alias("links")]
    else:
        joined = own.join(labels, "sid").select("set_id", "label")
    return stored(rows.drop("tokens", "copies").join(joined, "set_id", "left").select(
        "block", "doc", "id", "set_id", "n",
        F.coalesce(F.col("label").cast("string"), F.concat(F.lit("s"), F.hex("set_id"))).alias("key"), *more), "members")


def _named(members: DataFrame, id_column: str, *more: Column) -> DataFrame:
    """(id, n_shingles, component_id) of the members, and other columns of them."""
    smallest = stored(members.where("key is not null").groupBy("key").agg(F.min("id").alias("component_id")), "smallest")
    own = F.col("id").alias(id_column), F.col("n").alias("n_shingles")
    full = members.where("key is not null").join(smallest, "key").select(*own, "component_id", *more)
    return full.unionAll(members.where("key is null").select(*own, F.col("id").alias("component_id"), *more))


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row of `docs`.

    Rows with equal sets are one set until the end, so copies cost nothing and are in one component. Null, empty and
    blank texts have no shingles and are their own component; a null id is passed on and names a component only
    where all its ids are null; rows alike are kept each; an empty table stays empty; other columns are not read.
    Texts are read whole, and a task holds one block of them at a time.
    """
    return _named(_members(text_blocks(docs, id_column, text_column)), id_column)


def jaccard_links(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`jaccard_components` with `n_links`, the number of other rows that each row links to.

    Every pair of sets that may link is verified, also within a component; rows with equal sets link to each other, rows
    alike too. Texts without shingles have no links.
    """
    return _named(_members(text_blocks(docs, id_column, text_column), counted=True), id_column, F.col("links").alias("n_links"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` with one of each component: that of the smallest id (null last), then the smallest set.

    Of rows alike one stays; texts without words are linked with nothing and all stay; columns are as they were.
    """
    blocks = row_blocks(docs, text_column)
    named = _members(blocks)
    own = F.col(f"id.`{id_column}`")
    first = named.where("key is not null").groupBy("key").agg(
        F.min(F.struct(own.isNull().alias("none"), own.alias("id"), "set_id", "block", "doc")).alias("one"))
    kept = first.select("one.block", "one.doc").unionAll(named.where("key is null").select("block", "doc"))
    return take_rows(blocks, kept, docs, text_column)
