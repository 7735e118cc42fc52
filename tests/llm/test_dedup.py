"""Suffix-array dedup, line dedup and the Jaccard join against plain versions."""

import collections
import hashlib
import random
import re

import pytest

from faultline.llm import jaccard_join, line_dedup, suffix_dedup
from tests.llm.fixtures import documents, prose, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_suffixes(rows):
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[i: i + 400] for b in data for i in range(len(b) - 399))
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k: k + 400]] > 1:
                gone[k: k + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("many", [suffix_dedup.MANY, 4, 1])
def test_suffix_dedup(spark, monkeypatch, many):
    """Also where anchors have too many contexts to gather, and are dealt out by sectors."""
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "RANGE_SUFFIXES", 20)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 3)
    rows = texts()
    got = suffix_dedup.remove_repeats(documents(spark, rows)).collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == plain_suffixes(rows)
    assert all(len(r.kept) == r.n_kept == r.n_bytes - r.n_removed for r in got)


def test_suffix_dedup_of_a_core_with_many_surroundings(spark, monkeypatch):
    """One passage of 300 bytes in 60 texts, whose surroundings are shared by none, two or many."""
    monkeypatch.setattr(suffix_dedup, "MANY", 5)
    rng = random.Random(4)
    passage = prose(rng, 80)[:300]
    tails = [prose(rng, 40) for _ in range(9)]
    rows = [(i, prose(rng, 40) + tails[i % 7][:70] + passage + tails[i * i % 9][:90] + prose(rng, 40)) for i in range(60)]
    got = suffix_dedup.remove_repeats(documents(spark, rows)).collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == plain_suffixes(rows)
    assert sum(r.n_removed > 0 for r in got) > 20


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.remove_repeats(documents(spark, [])).isEmpty()


def test_loser_tree_merges_and_measures():
    rng = random.Random(3)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 40))) for _ in range(7)]
    tree = suffix_dedup.LoserTree([suffix_dedup.front_code(r) for r in runs])
    out = list(tree)
    assert [s for _, _, s, _ in out] == sorted(s for r in runs for s in r)
    for (_, _, a, _), (run, index, b, shared) in zip(out, out[1:], strict=False):
        assert shared == suffix_dedup.common_prefix(a, b) and runs[run][index] == b
    assert list(suffix_dedup.LoserTree([([], [])])) == []


def plain_lines(rows):
    """Every run of lines of 50 words or more, kept at its first place in order of (id, text, line)."""
    strip = " \t\n\x0b\x0c\r"
    # rows alike are interchangeable, rows of one id are ordered by a hash: the fixture's have no runs in common
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is not None, rows[n][0] or 0, n))
    lines = {n: [(x.strip(strip), len(WORD.findall(x)), k) for k, x in enumerate((rows[n][1] or "").split("\n")) if WORD.search(x)]
             for n in order}

    def runs(n):
        for i in range(len(lines[n])):
            total = 0
            for j in range(i, len(lines[n])):
                total += lines[n][j][1]
                if total >= 50:
                    yield i, j + 1, tuple(x[0] for x in lines[n][i: j + 1])

    first, gone = {}, collections.defaultdict(set)
    for n in order:
        for i, _, k in runs(n):
            first.setdefault(k, (n, i))
    for n in order:
        for i, j, k in runs(n):
            if first[k] != (n, i):
                gone[n].update(range(i, j))
    out = []
    for n in order:
        drop = {lines[n][i][2] for i in gone[n]}
        parts = (rows[n][1] or "").split("\n")
        kept = "".join(p + "\n" * (k < len(parts) - 1) for k, p in enumerate(parts) if k not in drop)
        out.append((rows[n][0], kept, len(lines[n]), len(drop)))
    return sorted(map(str, out))


def test_line_dedup(spark):
    rows = [r for r in texts() if len(r[1] or "") < 20_000]
    got = line_dedup.remove_repeated_lines(documents(spark, rows))
    assert sorted(str((r.row.doc_id, r.row.text, r.n_lines, r.n_removed)) for r in got.collect()) == plain_lines(rows)
    assert got.select("row.*").columns == documents(spark, rows).columns
    assert {r.block for r in got.select("row.block").collect()} == {"clash"}
    assert line_dedup.remove_repeated_lines(documents(spark, [])).isEmpty()


def test_later_copies_of_short_texts_go(spark):
    rows = [(1, "a short\ntext"), (2, " a short \n\ntext"), (3, "a short"), (4, "text\na short"), (5, None), (6, " \n"), (7, " \n"),
            (0, "w " * 60), (8, "w " * 60), (9, "a short\ntext\n" + "v " * 60), (None, "one"), (10, "one")]
    got = line_dedup.remove_repeated_lines(documents(spark, rows), whole_texts=True)
    assert {r.row.doc_id: r.n_removed for r in got.collect() if r.n_removed} == {2: 2, 8: 1, 10: 1}
    assert line_dedup.remove_repeated_lines(documents(spark, rows)).where("n_removed > 0").select("row.doc_id").first()[0] == 8


def test_names_of_equal_runs_are_equal():
    import numpy as np

    ids = np.array([1, 2, 3, 4, 1, 2, 3, 5], np.uint64)
    two = line_dedup.names(ids, 1)
    assert two[0] == two[4] and two[1] == two[5] and two[2] != two[6] and len(line_dedup.names(ids, 3)) == 1


def test_runs_of_equal_names_differ_by_the_second_half(spark):
    """Lines whose first 64 bits meet by chance are told apart by the other 64."""
    import numpy as np

    ids, words = np.arange(3, dtype=np.uint64).tobytes(), np.full(3, 20, np.int32).tobytes()
    other = [np.array(x, np.uint64).tobytes() for x in ([1, 2, 3], [1, 2, 4], [1, 2, 3])]
    lines = spark.createDataFrame(
        [(0, i, i, 0, 0, bytearray(ids), bytearray(x), bytearray(words), 3, [0, 1]) for i, x in enumerate(other)],
        "block long, doc int, id long, mark long, seal long, ids binary, checks binary, words binary, longest int, alive array<int>")
    runs = {r.doc: r for r in line_dedup._smallest_runs(lines, 1, 50).collect()}
    assert len({(r.a, r.b, r["size"]) for r in runs.values()}) == 1
    assert runs[0].check == runs[2].check != runs[1].check


def sets_of(rows):
    out = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out.append({tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def plain_components(rows):
    sets = sets_of(rows)
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    ids = collections.defaultdict(list)
    for g, (i, _) in zip(group, rows, strict=True):
        ids[g] += [i] if i is not None else []
    return sorted(str((i, len(s), min(ids[g], default=None))) for g, s, (i, _) in zip(group, sets, rows, strict=True)), group


@pytest.mark.parametrize("task_sets", [jaccard_join.TASK_SETS, 3])
def test_jaccard_components(spark, monkeypatch, task_sets):
    """Also where clusters are split over several tasks."""
    monkeypatch.setattr(jaccard_join, "TASK_SETS", task_sets)
    rng = random.Random(5)
    rows = texts()
    chain = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    for k in range(14):                                # a chain: each links to the next, few to those further on
        rows.append((600 + k, " ".join(chain)))
        chain = chain[6:] + [f"w{rng.randint(0, 10**6)}" for _ in range(6)]
    want, group = plain_components(rows)
    got = jaccard_join.jaccard_components(documents(spark, rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == want
    kept = jaccard_join.keep_one(documents(spark, rows))
    empty = sum(not s for s in sets_of(rows))
    assert kept.count() == len({g for g, s in zip(group, sets_of(rows), strict=True) if s}) + empty
    assert kept.columns == documents(spark, rows).columns


@pytest.mark.parametrize("task_sets", [jaccard_join.TASK_SETS, 3])
def test_jaccard_links_are_all_counted(spark, monkeypatch, task_sets):
    """Also within groups of near copies, and where their clusters are split over several tasks."""
    monkeypatch.setattr(jaccard_join, "TASK_SETS", task_sets)
    rng = random.Random(6)
    rows = texts()
    base = [f"v{rng.randint(0, 10**6)}" for _ in range(200)]
    for k in range(12):                                # near copies that nearly all link to each other, two of them twice
        words = list(base)
        for _ in range(k % 5):
            words[rng.randrange(200)] = f"u{rng.randint(0, 10**6)}"
        rows += [(700 + k, " ".join(words))] * (1 + (k in (3, 8)))
    sets = sets_of(rows)
    links = [sum(a != b and bool(x & y) and 175 * len(x & y) >= 75 * (len(x) + len(y)) for b, y in enumerate(sets)) for a, x in enumerate(sets)]
    want = sorted(str((i, len(s), n)) for (i, _), s, n in zip(rows, sets, links, strict=True))
    got = jaccard_join.jaccard_links(documents(spark, rows)).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.n_links)) for r in got) == want and max(links) > 10
    assert sorted(str(tuple(r)[:3]) for r in got) == plain_components(rows)[0]
    assert jaccard_join.jaccard_links(documents(spark, [])).isEmpty()


def test_jaccard_of_nothing(spark):
    assert jaccard_join.jaccard_components(documents(spark, [])).isEmpty()
    assert jaccard_join.keep_one(documents(spark, [(None, None)])).count() == 1


def test_divide_skip_counts_what_sets_share():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**60, 200).astype(np.uint64)
    sets = sorted((np.unique(np.concatenate([rng.choice(base, rng.integers(120, 200), replace=False), rng.integers(
        0, 2**60, rng.integers(1, 40)).astype(np.uint64)])) for _ in range(30)), key=len)
    sizes = np.array([len(s) for s in sets])
    for q in range(30):
        index = jaccard_join.Lists(sizes, sets, np.arange(30))
        got = set(index.search(q))
        want = {m for m in range(q) if len(b := np.intersect1d(sets[m], sets[q])) and 100 * len(b) >= 75 * (sizes[m] + sizes[q] - len(b))}
        # members of a group already joined need not be found again
        assert got <= want and (not want or got)
