"""Whitening, spelling variants and graph search against brute force, on small tables with odd rows."""

import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest

from metricloom.llm import graph_search, spelling, whitening
from metricloom.llm.whitening import whiten

VECTORS = "vec_id long, embedding array<float>, label int, key string, v string, n string"
TEXTS = "doc_id long, text string, word string, n string, key string"
NAN, INF = float("nan"), float("inf")


def vector_rows(vectors):
    return [(i, None if v is None else [None if x is None else float(x) for x in v], 0, "c", "c", "c") for i, v in vectors]


@pytest.fixture(scope="module")
def odd_vectors():
    """Random vectors with copies, ties and a repeated row; then rows that take no part."""
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=6).astype(np.float32)) for i in range(150)]
    good += [(1000 + i, good[i % 3][1]) for i in range(60)]
    good.append(good[7])
    bad = [(2000, None), (2001, []), (2002, [1, None, 0, 0, 0, 0]), (2003, [NAN, 0, 0, 0, 0, 0]),
           (2004, [0, 0, INF, 0, 0, 0]), (2020, [1.0, 2.0])]
    return good, bad


def test_whitening(spark, odd_vectors, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    good, bad = odd_vectors
    table = spark.createDataFrame(vector_rows(good + bad), VECTORS).repartition(3)
    got = whiten(table, components=4).collect()
    assert len(got) == 4 * len(good)
    x = np.floor(64 * np.array([v for _, v in good], float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    z = x - sums / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    white = (z @ vectors[:, ::-1] / np.sqrt(values[::-1]))[:, :4]
    expected = {i: (w, ((n * r - sums) ** 2).sum()) for (i, _), w, r in zip(good, white, x)}
    sign = np.zeros(4)
    for row in got:
        w, deviation = expected[row.vec_id]
        c = row.component - 1
        sign[c] = sign[c] or np.sign(row.whitened * w[c])
        assert row.n == n and row.deviation == deviation
        assert row.whitened == pytest.approx(sign[c] * w[c], abs=1e-8)
        assert row.explained == pytest.approx(values[::-1][c] / values.sum(), rel=1e-9)
        assert row.identity_error < 1e-9


def test_whitening_without_variance(spark):
    assert whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whiten(spark.createDataFrame(vector_rows([(1, None), (2, [NAN])]), VECTORS)).count() == 0
    rows = vector_rows([(1, [1, 2]), (2, [1, 2]), (None, [1, 2])])
    got = whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == 6
    assert all((r.whitened, r.deviation, r.explained, r.identity_error) == (None, 0, 0.0, 0.0) for r in got)
    # All on one line: one component has variance.
    rows = vector_rows([(i, [i, 2 * i]) for i in range(5)])
    got = {(r.vec_id, r.component): r.whitened for r in whiten(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got[0, 2] is None and abs(got[4, 1]) == pytest.approx(2 / 2**0.5)


def test_deviation_beyond_64_bits():
    assert whitening._squares(np.array([[1 << 31, 1 << 31], [1 << 32, 0]])) == [None, None]
    assert whitening._squares(np.array([[3, -4]])) == [25]


def true_nearest(rows, query, k):
    own_id, own = query
    scores = sorted((-float(np.dot(np.asarray(v, float), np.asarray(own, float))), i) for i, v in rows if i != own_id)
    return [(i, -s) for s, i in scores[:k]]


def test_nearest_on_a_small_table(spark, odd_vectors):
    good, bad = odd_vectors
    zero = [(2040, [0.0] * 6), (None, [1.0] * 6)]
    table = spark.createDataFrame(vector_rows(good + bad + zero), VECTORS)
    queries = table.where("vec_id % 20 = 0")
    got = {}
    for r in graph_search.nearest(table, queries, k=5, beam=64, shard=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = {i: v for i, v in good}
    asked = [i for i in rows if i % 20 == 0]
    assert sorted(got) == sorted(asked)
    for i in asked:
        expected = true_nearest(rows.items(), (i, rows[i]), 5)
        # Such small shards are searched in full, so the answer is exact, ties included.
        assert [(rank, j) for rank, j, _ in sorted(got[i])] == [(n, j) for n, (j, _) in enumerate(expected, 1)]
        assert [s for *_, s in sorted(got[i])] == pytest.approx([s for _, s in expected])


def test_nearest_with_few_candidates_or_none(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert graph_search.nearest(empty, empty).count() == 0
    table = spark.createDataFrame(vector_rows([(0, [1, 0]), (1, [1, 0]), (2, [-1, 0])]), VECTORS)
    assert graph_search.nearest(table, empty).count() == 0
    got = graph_search.nearest(table, table.where("vec_id = 0")).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, -1.0)]


def test_recall_with_a_tight_cluster():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 32))
    v[:1000] = v[0] + 0.05 * v[:1000]
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    graph = graph_search.build_graph(v)
    assert (graph.edges >= 0).sum(axis=1).max() <= graph_search.DEGREE
    nodes, far, _ = graph.search(v[::20], graph_search.BEAM)
    near = np.take_along_axis(nodes, np.argsort(far, axis=1), 1)[:, :20]
    exact = np.argsort(-(v[::20] @ v.T), axis=1)[:, :20]
    recall = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(near.tolist(), exact.tolist())])
    assert recall >= 0.93


def brute_spellings(texts):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    counts = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, forms = {}, {}
    for w, n in counts.items():
        near = sorted((-counts[u], u) for u in counts if one_edit(w, u))
        form = near[0][1] if near and -near[0][0] >= 10 * n else None
        forms[w] = form
        out[w] = (form, n, len(near), counts[form] if form else None)
    for w in out:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (*out[w], root)
    return out


def test_spellings(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 16)
    pick = np.random.default_rng(2)
    letters = list("abcdeinorst") + ["é", "ÿ", "×"]
    base = ["".join(pick.choice(letters, pick.integers(7, 10))) for _ in range(30)]

    def variant(w):
        i = int(pick.integers(len(w)))
        c = str(pick.choice(letters))
        return [w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + c + w[i:]][int(pick.integers(3))]

    words = base * 60 + [v for w in base for v in (variant(w), variant(w), variant(variant(w))) for _ in range(int(pick.integers(1, 6)))]
    words += ["chained" + "s" * k for k in range(1, 4) for _ in range(2 * 14**k)] + ["ABCDEFG", "abcdefg", "ÉABCDEFG", "éABCDEFG"] * 3
    pick.shuffle(words)
    texts = [(i, " ".join(words[i * 50 : i * 50 + 50])) for i in range(len(words) // 50 + 1)]
    texts += [(900, None), (901, ""), (902, "12 !? a b"), (None, "unkeyed unkeyed"), (903, "x" * 100_000), texts[3]]
    table = spark.createDataFrame([(i, t, "c", "c", "c") for i, t in texts], TEXTS).repartition(3)
    got = {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in spelling.group_spellings(table).collect()}
    assert got == brute_spellings(texts)
    assert any(form and root != form for form, _, _, _, root in got.values())


def test_spellings_of_nothing(spark):
    assert spelling.group_spellings(spark.createDataFrame([], TEXTS)).count() == 0
