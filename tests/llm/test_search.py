"""Hard negatives, top-k search and source divergence against brute force, over nulls, ragged vectors, ties, repeated rows and empty tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import divergence, hard_negatives, maxscore
from scriptorium.llm.vectors import inner, scaled

R = random.Random(5)
INF, NAN = float("inf"), float("nan")


def rows(df):
    return [tuple(r) for r in df.collect()]


def cloud(n, dims=6, centres=5, spread=0.15):
    """Vectors around a few centres, with copies, ragged ends, nulls and values that are not finite."""
    middles = [[R.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    out = []
    for i in range(n):
        v = [x + R.gauss(0, spread) for x in R.choice(middles)]
        if i % 11 == 0 and out:
            v = list(R.choice(out)[1] or [])
        if i % 17 == 0:
            v = v[: R.randrange(dims)]
        if i % 29 == 3:
            v = [None, None][: i % 2] or None
        if i % 31 == 4 and v:
            v = [*v[:-1], R.choice([INF, -INF, NAN])]
        out.append((i if i % 37 else i // 2, v, None if i % 41 == 7 else R.randrange(3)))
    return out


def whole(v, by):
    if v is None or any(x is None or x != x or abs(x) == INF for x in v):
        return None
    return [int(np.floor(np.float64(by) * x)) for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))  # noqa: B905  the shorter is filled up with zeros


def negatives_brute(data, anchor, positives=5, negatives=3, low=50, high=95):
    kept = [(i, label, v) for i, label, v in data if i is not None and label is not None and v is not None]
    out = []
    for a, (anchor_id, label, v) in enumerate(kept):
        if not anchor(anchor_id):
            continue
        scored = [(-dot(v, w), i, other) for b, (i, other, w) in enumerate(kept) if b != a]
        for s, positive, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fit = sorted((n, i) for n, i, other in scored if other != label and low * -s <= 100 * -n <= high * -s)[:negatives]
            out += [(anchor_id, positive, rank + 1, i, -s, -n) for rank, (n, i) in enumerate(fit)]
    return Counter(out)


@pytest.mark.parametrize("tree_rows,anchor_rows", [(4096, 2000), (40, 7)])
def test_negatives_equal_brute_force(spark, tree_rows, anchor_rows):
    data = cloud(400)
    df = spark.createDataFrame([(*r, "x", "x") for r in data], "vec_id int, embedding array<float>, label int, score string, block string")
    mined = hard_negatives.mine(df.withColumn("v", scaled(F.col("embedding"), 256)), F.col("vec_id") % 5 == 0, tree_rows=tree_rows, anchor_rows=anchor_rows)
    exact = [(i, label, whole(None if v is None else [None if x is None else float(np.float32(x)) for x in v], 256)) for i, v, label in data]
    want = negatives_brute(exact, lambda i: i % 5 == 0)
    assert len(want) > 100 and Counter(rows(mined)) == want


def test_negatives_of_odd_tables(spark):
    schema = "vec_id long, label int, v array<double>"
    mine = lambda data: rows(hard_negatives.mine(spark.createDataFrame(data, schema), F.col("vec_id") % 2 == 0))
    assert mine([]) == []
    assert mine([(0, 1, [1.0]), (1, 1, [1.0])]) == []  # one label
    assert mine([(0, 1, [2.0]), (1, 0, [1.0])]) == []  # no positive
    assert mine([(0, 1, []), (1, 1, []), (3, 0, [4.0])]) == [(0, 1, 1, 3, 0, 0)]  # a score of 0 leaves a window of 0
    assert mine([(0, 1, [1.0]), (1, 1, [-4.0]), (3, 0, [-3.0])]) == []  # nor does a negative one leave any
    assert mine([(None, 1, [1.0]), (0, None, [1.0]), (2, 1, None)]) == []
    big = float(1 << 30)
    assert mine([(0, 1, [big, 1.0]), (1, 1, [big, 1.0]), (3, 0, [big / 2 + 1, 1.0])]) == [(0, 1, 1, 3, (1 << 60) + 1, (1 << 59) + (1 << 30) + 1)]


def test_cover_tree_invariants():
    data = np.array([v for _, v, _ in cloud(900) if v and None not in v and len(v) == 6 and all(abs(x) < INF for x in v)])
    tree = hard_negatives.build(data, np.zeros(len(data), np.int64))
    points = hard_negatives.augmented(data)[0][tree["order"]]
    assert sorted(tree["order"]) == list(range(len(data))) and len(tree["radius"]) > 20
    for (a, b), radius, first, children in zip(tree["spans"], tree["radius"], tree["first"], tree["children"], strict=True):
        assert np.linalg.norm(points[a:b] - points[a], axis=1).max() <= radius + 1e-6
        if children:
            spans = tree["spans"][first : first + children]
            assert spans[0][0] == a and spans[-1][1] == b and (spans[1:, 0] == spans[:-1, 1]).all()
            assert (tree["radius"][first : first + children] <= radius / 2 + 1e-6).all()
            centres = points[spans[:, 0]]
            apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)[~np.eye(children, dtype=bool)]
            assert apart.min() > radius / 2 - 1e-6


def test_descent_skips_nodes_and_loses_nothing():
    data = np.array([[x * 1000 + R.gauss(0, 3), y * 1000 + R.gauss(0, 3)] for x in range(1, 9) for y in range(1, 9) for _ in range(60)]).round()
    labels = np.arange(len(data)) % 2
    table = pa.table({"block": pa.array([0] * len(data), pa.int32()), "row_key": range(len(data)), "vec_id": range(len(data)), "label": labels, "v": data.tolist()})
    forest = hard_negatives.Forest(hard_negatives.packed(table)["tree"].to_pylist())
    asked = table.take([7, 1700, 3500])
    for i, anchor, low, high in hard_negatives.anchors_of(asked, forest):
        scores = data @ anchor["vector"]
        window = (float(np.quantile(scores, 0.4)), float(np.quantile(scores, 0.6)))
        got = forest.descend(anchor, low, high, *window, 3, False)
        fit = [(-int(s), j) for j, s in enumerate(scores) if labels[j] != anchor["label"] and window[0] <= s <= window[1]]
        assert got == sorted(fit)[:3]
        read = sum(len(s) for s in anchor["scores"].values())
        assert 0 < read < len(data) / 5, read  # most leaves are never scored


def topk_brute(data, asked, k):
    kept = [(i, v) for i, v in data if i is not None and v is not None]
    out = []
    for a, (query, v) in enumerate(kept):
        if asked(query):
            best = sorted((-dot(v, w), i) for b, (i, w) in enumerate(kept) if b != a)[:k]
            out += [(query, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    return Counter(out)


@pytest.mark.parametrize("block_rows,query_rows", [(16_384, 2000), (60, 9)])
def test_top_k_equals_brute_force(spark, block_rows, query_rows):
    data = [(i, v) for i, v, _ in cloud(500)]
    df = spark.createDataFrame([(*r, "x", "x") for r in data], "vec_id long, embedding array<float>, score string, rank string")
    got = maxscore.nearest(df, F.col("vec_id") % 10 == 0, 7, 1024, block_rows=block_rows, query_rows=query_rows)
    exact = [(i, whole(None if v is None else [None if x is None else float(np.float32(x)) for x in v], 1024)) for i, v in data]
    assert Counter(rows(got)) == topk_brute(exact, lambda i: i % 10 == 0, 7)


def test_top_k_over_sparse_terms(spark):
    """Few terms a row, some very common: what text retrieval has."""
    data = []
    for i in range(600):
        terms = {int(R.paretovariate(0.6)) % 5000: R.choice([-2, 1, 1, 3, 8]) for _ in range(R.randrange(12))}
        data.append((i, list(terms), [float(x) for x in terms.values()]))
    df = spark.createDataFrame(data, "vec_id long, terms array<long>, weights array<double>")
    got = Counter(rows(maxscore.top_k(df, F.col("vec_id") % 6 == 0, 10, block_rows=250)))
    want = Counter()
    for q, terms, weights in data[::6]:
        mine = dict(zip(terms, weights, strict=True))
        best = sorted((-sum(w * mine.get(t, 0) for t, w in zip(ts, ws, strict=True)), i) for i, ts, ws in data if i != q)[:10]
        want.update((q, n + 1, i, int(-s)) for n, (s, i) in enumerate(best))
    assert got == want


def test_maxscore_leaves_lists_untraversed():
    """Rows that are in weak lists alone are never met; the result stays whole."""
    n = 4000
    terms = [[0, 1] if i < 100 else [1, 2] for i in range(n)]
    weights = [[float(500 + i), 1.0] if i < 100 else [1.0, 2.0] for i in range(n)]
    held = maxscore.Postings(pa.chunked_array([pa.array(terms)]), pa.chunked_array([pa.array(weights)]))
    for i in range(3):
        held.looked_up(i, np.array([0]))  # columns are made once a block
    read = []
    held.row = type("Row", (), {"__getitem__": lambda _, s, row=held.row: (read.append(s), row[s])[1]})()
    found, scores = held.best(np.array([0, 1, 2]), np.array([1.0, 1.0, 1.0]), 5, np.array([99]))
    assert sorted(zip(-scores, found, strict=True))[:2] == [(-599.0, 98), (-598.0, 97)]
    assert all(s.stop - s.start <= 100 for s in read if isinstance(s, slice))


def test_top_k_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    ask = lambda data: rows(maxscore.nearest(spark.createDataFrame(data, schema), F.col("vec_id") % 2 == 0, 2, 1))
    assert ask([]) == [] and ask([(0, [1.0])]) == [] and ask([(None, [1.0]), (1, None)]) == []
    assert sorted(ask([(0, []), (1, [0.0]), (3, [5.0])])) == [(0, 1, 1, 0), (0, 2, 3, 0)]
    assert sorted(ask([(0, [1.0]), (1, [-2.0]), (3, [-5.0]), (5, [-1.0])])) == [(0, 1, 5, -1), (0, 2, 1, -2)]
    big = float(1 << 31)
    assert sorted(ask([(0, [big, 1.0]), (1, [big, 3.0]), (3, [big, 2.0])])) == [(0, 1, 1, (1 << 62) + 3), (0, 2, 3, (1 << 62) + 2)]
    assert sorted(ask([(0, [2.0]), (0, [2.0]), (1, [3.0])])) == [(0, 1, 1, 6), (0, 1, 1, 6), (0, 2, 0, 4), (0, 2, 0, 4)]


def test_inner_is_exact():
    a = np.array([[2.0**40, 1.0], [3.0, -(2.0**40)]])
    assert inner(a, np.array([2.0**20, 5.0]), 2.0**40).tolist() == [2**60 + 5, 3 * 2**20 - 5 * 2**40]


WORDS = ["the", "THE", "of", "Éa", "über", "x1y", "中文", "a-b", "don't", "\x00z", "i", "J@k"]


def corpus(n):
    texts = [None, "", " \n\t", "12 34 !?", "the" * 20_000, "the " * 30_000]
    out = [(t, lang, source) for t in texts for lang, source in (("en", "s1"), (None, None))]
    for i in range(n):
        lang, source = R.choice(["en", "de", "", None]), R.choice(["hot"] * 4 + ["s1", "s2", None, ""])
        out.append((" ".join(R.choice(WORDS[: 6 if source == "hot" else 12]) + R.choice(["", "s", "."]) for _ in range(R.randrange(40))), lang, source))
    return [*out, *out[-9:], ("rare words only", "fr", "alone"), ("rare", "xx", "a"), (None, "xx", "b")]


def audit_brute(data, min_docs, top):
    per_lang = defaultdict(list)
    for text, lang, source in data:
        small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        per_lang[lang or ""].append((source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", small)))
    out = []
    for lang, docs in per_lang.items():
        df = Counter(t for _, terms in docs for t in set(terms))
        kept = [t for t, n in df.items() if n >= min_docs]
        counts = {s: Counter() for s, _ in docs}
        for s, terms in docs:
            counts[s].update(t for t in terms if df[t] >= min_docs)
        total = {s: sum(c.values()) for s, c in counts.items()}
        p = lambda c, n: 1 + 10**9 * (c + 2) // (n + 2 * len(kept))  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // (a + b)
        whole = {t: p(sum(c[t] for c in counts.values()), sum(total.values())) for t in kept}
        for s, c in counts.items():
            pairs = [(-sum(f(p(c[t], total[s]), p(o[t], total[b])) for t in kept), b) for b, o in counts.items() if b != s]
            terms = [(-f(p(c[t], total[s]), whole[t]), t.encode(), t) for t in kept if c[t] and p(c[t], total[s]) > whole[t]]
            out += [(lang, s, "pair", b, -v, n + 1) for n, (v, b) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -v, n + 1) for n, (v, _, t) in enumerate(sorted(terms)[:top])]
    return Counter(out)


@pytest.mark.parametrize("held,groups_in_task", [(divergence.HELD, divergence.GROUPS), (30, divergence.GROUPS), (divergence.HELD, 0)])
def test_audit_equals_brute_force(spark, held, groups_in_task):
    data = corpus(300)
    df = spark.createDataFrame([(*r, 1, "x", "x") for r in data], "text string, lang string, source string, value int, term string, n string").repartition(7)
    got = divergence.audit(df, 10, 4, held, groups_in_task).select("lang", "source", "part", "item", "value", "rank")
    want = audit_brute(data, 10, 4)
    assert Counter(rows(got)) == want and len(want) > 60
    assert rows(divergence.audit(df.where("false"), groups_in_task=groups_in_task)) == []


def test_shares_at_any_size():
    counts = np.array([0, 5, 10**13])
    assert divergence.shares(counts, 10**14, 7).tolist() == [1 + 10**9 * (c + 2) // (10**14 + 14) for c in counts.tolist()]
