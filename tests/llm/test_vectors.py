"""Whitening, vector codes and language-model scores against plain versions."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from faultline.llm import backoff_lm, vector_codes, whitening
from faultline.llm.queries import QUERIES
from tests.llm.fixtures import documents, texts

SF = "/root/testdata/sf0.01"
CLASHES = "id string, x string, row string, component int, part int, code string, error string, _label string, n long"
BAD = [None, [1.0, None, 2.0], [float("nan")] * 3, [1.0, float("inf"), 2.0]]


def vectors(spark, rows, dim_type="array<float>"):
    return spark.createDataFrame([(i, v, lab, "c", "c", "c", 1, 1, "c", "c", "c", 1) for i, v, lab in rows],
                                 f"vec_id long, embedding {dim_type}, label int, {CLASHES}")


def rows_of(rng, n, dim, spread=1.0):
    return [[float(v) for v in rng.standard_normal(dim) * spread] for _ in range(n)]


# --- whitening ------------------------------------------------------------------------------------------------------
def check_whitening(got, kept, components=4):
    """`kept` are the rows (id, vector) that take part."""
    x = np.array([[math.floor(256 * np.float32(c).astype(float)) for c in v] for _, v in kept], object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), float)
    n, sums = len(fit), [sum(int(v) for v in col) for col in zip(*set(map(tuple, x.tolist())))]
    centred = fit - np.array(sums) / n
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    values, vectors_ = values[::-1][:components], vectors_[:, ::-1][:, :components]
    count = min(components, fit.shape[1])
    assert len(got) == len(kept) * count
    by = collections.defaultdict(dict)
    for r in got:
        by[r.component].setdefault(r.vec_id, []).append(r)
    for k in range(1, count + 1):
        flat = sorted((i, v) for (i, _), v in zip(kept, (np.array([[float(c) for c in row] for row in x]) - np.array(sums) / n) @ vectors_[:, k - 1]))
        own = sorted((i, r.whitened) for i, rows in by[k].items() for r in rows)
        if values[k - 1] > 1e-9 * max(values.sum(), 1e-300):
            want = np.array([v for _, v in flat]) / math.sqrt(values[k - 1])
            mine = np.array([v for _, v in own])
            sign = np.sign((want * mine).sum())
            if min([abs(values[k - 1] - v) for j, v in enumerate(values) if j != k - 1] + [values[k - 1]]) > 1e-3 * values[0]:
                assert np.abs(want * sign - mine).max() < 1e-8
            assert all(abs(r.explained / (values[k - 1] / np.trace(centred.T @ centred / n)) - 1) < 1e-9 for rows in by[k].values() for r in rows)
        else:
            assert all(v is None for _, v in own)
    deviations = sorted((i, sum((n * int(c) - s) ** 2 for c, s in zip(row, sums))) for (i, _), row in zip(kept, x.tolist()))
    assert sorted((i, int(r.deviation)) for i, rows in by[1].items() for r in rows) == deviations
    assert all(r.n == n and (r.identity_error is None or r.identity_error < 1e-9) for r in got)


def test_whitening(spark):
    rng = np.random.default_rng(1)
    data = [[a * 3, b, a + b * 0.2 + c * 0.1, c, 0.5] for a, b, c in rows_of(rng, 60, 3)]
    rows = [(i, v, 0) for i, v in enumerate(data)]
    rows += [(100 + i, data[0], 1) for i in range(30)] + [(1, data[1], 0), (None, data[2], 0)]        # copies, repeated and null ids
    rows += [(900 + i, v, 0) for i, v in enumerate(BAD)] + [(950, [1.0, 2.0], 0), (951, [], 0)]
    got = whitening.whiten(vectors(spark, rows)).where("vec_id is not null").collect()
    kept = [(i, v) for i, v, _ in rows if v and len(v) == 5 and None not in v and i is not None]
    check_whitening(got, kept)
    assert whitening.whiten(vectors(spark, rows)).where("vec_id is null").count() == 4
    assert whitening.whiten(vectors(spark, [])).isEmpty() and whitening.whiten(vectors(spark, [(1, None, 0)])).isEmpty()


def test_whitening_of_equal_variances_and_few_rows(spark):
    """Directions that one start cannot tell apart, fewer entries than components, and a single vector."""
    axes = [[float(s * (i == j)) for j in range(6)] for i in range(6) for s in (4, -4)] + [[0.0] * 6]
    check_whitening(whitening.whiten(vectors(spark, [(i, v, 0) for i, v in enumerate(axes)])).collect(), list(enumerate(axes)))
    pairs = [[1.0, 2.0], [3.0, -1.0], [0.25, 0.5]]
    check_whitening(whitening.whiten(vectors(spark, [(i, v, 0) for i, v in enumerate(pairs)])).collect(), list(enumerate(pairs)))
    one = whitening.whiten(vectors(spark, [(5, [1.0, 2.0, 3.0], 0), (6, [1.0, 2.0, 3.0], 0)])).collect()
    assert len(one) == 6 and all(r.whitened is None and r.deviation == 0 and r.n == 1 and r.identity_error is None for r in one)


def test_bidiagonalisation_finds_equal_values_it_was_not_started_for():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((40, 12)))
    a = q * np.array([9, 9, 9, 5, 1e-3, 1e-3, 1e-4, 1e-4, 1e-5, 1e-5, 0, 0])

    def scan(v, held):
        w = a @ v
        return a.T @ w, (a @ held).T @ w, float(w @ w)

    values, rows = whitening.leading(scan, 12, 4)
    assert np.allclose(values, [9, 9, 9, 5], rtol=1e-12) and np.allclose(rows @ rows.T, np.eye(4), atol=1e-12)
    assert np.allclose(np.linalg.norm(rows @ a.T, axis=1), values, rtol=1e-12)


def test_whitening_of_the_given_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    check_whitening(QUERIES["op11_lanczos_whitening"](spark, SF).collect(), [(r.vec_id, r.embedding) for r in table])


# --- vector codes ---------------------------------------------------------------------------------------------------
def plain_codes(rows, entries, rounds, parts=4, scale=1024):
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v], lab) for i, v, lab in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-len(kept[0][1]) // parts)
    cut = [[(v + [0] * (parts * width - len(v)))[p * width: (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, v: min((square(v, e), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            members = collections.defaultdict(list)
            for c in cut:
                members[near(p, c[p])[1]].append(c[p])
            for j, m in members.items():
                books[p][j] = [sum(col) // len(m) for col in zip(*m)]
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    return sorted(str((i, [j for _, j in f], sum(d for d, _ in f), lab)) for (i, _, lab), f in zip(kept, found)), books


@pytest.mark.parametrize("dim, entries, spread", [(8, 16, 1.0), (10, 300, 0.01), (8, 16, 1e6)])
def test_vector_codes(spark, monkeypatch, dim, entries, spread):
    """Also sizes that parts do not divide, ties in small whole numbers, more entries than rows, and numbers beyond doubles."""
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(int(spread) + dim)
    centres = rng.standard_normal((12, dim)) * spread
    data = [[float(v) for v in centres[i % 12] + rng.standard_normal(dim) * spread * 0.3] for i in range(150)]
    rows = [(i, v, i % 3) for i, v in enumerate(data)] + [(300 + i, data[0], None) for i in range(40)] + [(7, data[9], 1), (None, data[3], 1)]
    bad = [(900 + i, v, 0) for i, v in enumerate(BAD)]
    codes = vector_codes.compress(vectors(spark, rows + bad), entries=entries)
    want, books = plain_codes(rows, entries, 4)
    assert sorted(str((r.row.vec_id, r.code, r.error, r.row.label)) for r in codes.rows.collect()) == want
    assert [[list(map(int, e)) for e in b] for b in codes.codebooks] == books
    if (dim, spread) == (8, 1.0):
        errors = collections.defaultdict(int)
        for r in codes.rows.collect():
            errors[r.row.label] += r.error
        assert {r.row.label: r.label_error for r in vector_codes.with_label_errors(codes.rows, "label").collect()} == errors
        assert codes.kept[0] == vector_codes.MOST_KEPT and codes.kept[-1] < codes.kept[0]


def test_vector_codes_of_nothing(spark):
    assert vector_codes.compress(vectors(spark, [])) is None
    assert vector_codes.compress(vectors(spark, [(1, None, 0)])) is None


def test_bounds_spare_distances_and_change_nothing():
    rng = np.random.default_rng(5)
    x = np.floor(rng.standard_normal((400, 6)) * 50 + rng.integers(0, 8, (400, 1)) * 300).astype(np.int64)
    entries = x[:60].copy()
    bounds, spared = None, 0
    for _ in range(5):
        bounds, best, need = vector_codes.assign(x, entries, bounds, 12)
        square = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (bounds.near[:, 0] == square.argmin(axis=1)).all() and (best == square.min(axis=1)).all()
        real = np.sqrt(np.take_along_axis(square, bounds.near.astype(np.int64), 1))
        assert (bounds.low <= real + 1e-9).all() and (np.diff(bounds.low, axis=1) >= 0).all()
        others = np.sqrt(square.astype(float))
        np.put_along_axis(others, bounds.near.astype(np.int64), np.inf, 1)
        assert (bounds.outer <= others.min(axis=1) + 1e-9).all()
        spared += int((need == 1).sum())
        new = np.array([x[bounds.near[:, 0] == j].sum(0) // max(1, (bounds.near[:, 0] == j).sum()) if (bounds.near[:, 0] == j).any() else e
                        for j, e in enumerate(entries)])
        bounds, entries = bounds.moved(np.sqrt(((new - entries) ** 2).sum(1))), new
    assert spared > 400


# --- language-model scores ------------------------------------------------------------------------------------------
def plain_scores(rows, order, strength):
    grams, sequences = collections.Counter(), []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + [0]
        sequences.append(words)
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            s = [1, *words]
            for k in range(order):
                grams.update(tuple(s[j: j + k + 1]) for j in range(len(s) - k))
    count = {g[0]: c for g, c in grams.items() if len(g) == 1 and g[0] != 1}
    n, v = sum(count.values()), len(count)
    base = lambda w: (count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))
    p = lambda h, w: (grams[(*h, w)] + strength * p(h[1:], w)) / (grams[h] + strength) if h else base(w)
    out = []
    for (i, _), words in zip(rows, sequences):
        s = [1, *words]
        out.append((i, i is None or zlib.crc32(str(i).encode()) % 10 == 0, len(words), sum(w in count for w in words), n,
                    sum(math.log10(base(w)) for w in words),
                    sum(math.log10(p(tuple(s[max(0, j - order + 1): j]), s[j])) for j in range(1, len(s)))))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_scores(spark, monkeypatch, order):
    monkeypatch.setattr(backoff_lm, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(backoff_lm, "PART_BYTES", 5000)
    rows = texts() + [(700, "THE the The É é"), (701, "\x85 \u00a0 x\x1fy")]
    got = sorted((tuple(r) for r in backoff_lm.score(documents(spark, rows), order=order).collect()), key=str)
    want = sorted(plain_scores(rows, order, backoff_lm.STRENGTH), key=str)
    key = lambda r: (str(r[:5]), round(r[5], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-9 * max(1, abs(b[5])) and abs(a[6] - b[6]) < 1e-9 * max(1, abs(b[6]))


def test_backoff_scores_with_nothing_to_learn_from(spark):
    assert backoff_lm.score(documents(spark, [])).isEmpty()
    rows = backoff_lm.score(documents(spark, [(None, "a b"), (None, None)])).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score == r.base_score == 0 for r in rows)


def test_probabilities_of_a_context_add_up():
    import zstandard
    raw = "a b a c a b b a c".encode()
    own = backoff_lm.grams(np.array([len(raw)]).tobytes(), zstandard.compress(raw), 3)
    counts = own.counts(np.array([True]))
    counts[0] = counts[0].copy()
    tokens, distinct = int(counts[0].sum() - counts[0][backoff_lm.BEGIN]), 4
    machine = backoff_lm.automaton(own, counts, tokens, distinct, 5.0, 0.1)
    unseen = math.log10(0.1 / (tokens + 0.1 * (distinct + 1)))
    for state in range(len(machine.fail)):
        total = 0.0
        for w in range(1, machine.words):
            s, weight = state, 0.0
            while (a := machine.arcs.get(s * machine.words + w)) is None:
                weight, s = weight + machine.fail_weight[s], machine.fail[s]
            total += 10 ** (weight + machine.weight[a])
        s, weight = state, unseen
        while s:
            weight, s = weight + machine.fail_weight[s], machine.fail[s]
        assert abs(total + 10 ** weight - 1) < 1e-12


def test_backoff_beats_single_words_on_held_out_texts(spark):
    rows = [r for r in QUERIES["op13_backoff_automaton"](spark, SF).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
