"""Quality classifier, hard negatives and whitening against plain versions, held-out labels and edges."""

import collections
import itertools
import math
import pathlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxframe.llm import hardneg, nbsvm, whitening
from voxframe.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
rng = random.Random(11)
WORDS = ["".join(rng.choices("abcdefghij é", k=rng.randint(1, 9))).replace(" ", "") or "x" for _ in range(300)]


def plain_grams(text):
    """The n-grams of a text as Python values, without hashes: what two texts' features must agree on."""
    digits = "".join("0" if c in "0123456789" else c for c in text)
    found = {(1, c) for c in digits} | {(2, digits[i : i + 2]) for i in range(len(digits) - 1)} | {(3, digits[i : i + 3]) for i in range(len(digits) - 2)}
    for c in " \t\n\v\f\r":
        digits = digits.replace(c, " ")
    words = [w for w in digits.split(" ") if w]
    again = [False, *(a == b for a, b in itertools.pairwise(words))]
    found |= {(4, w) for w in words} | {(5, a, "=" if s else b) for (a, b), s in zip(itertools.pairwise(words), again[1:], strict=True)}
    return found | {(6, *again[i : i + 3]) for i in range(len(words) - 2)}


def test_features_are_the_n_grams_of_the_text():
    places = nbsvm.Indicators()
    for text in ["", "a", "ab a ab ab ab 12 97", " \n", "\U0001f600 é é", *(" ".join(rng.choices(WORDS, k=40)) for _ in range(8))]:
        grams = plain_grams(text)
        found = set(places(text).tolist())
        assert len(grams) - 4 <= len(found) <= len(grams)  # a few may share a place
    assert places(None).tolist() == places("").tolist() == []


def test_pieces_do_not_change_features(monkeypatch):
    text = " ".join(rng.choices(WORDS, k=3000)) + "\n" + "y" * 50 + " again again again"
    whole = nbsvm.Indicators()(text)
    monkeypatch.setattr(nbsvm, "_PIECE", 400)
    assert (nbsvm.Indicators()(text) == whole).all()


def test_descent_reaches_the_least_loss():
    """The primal and dual values meet, which only the best weights allow; ratios by counting."""
    generator = np.random.default_rng(2)
    labels = generator.random(120) < 0.4
    rows = [np.flatnonzero(generator.random(60) < np.where(np.arange(60) % 2 == y, 0.25, 0.15)) for y in labels]
    ratio = nbsvm.log_ratios(rows, labels)
    n = collections.Counter((bool(y), int(f)) for r, y in zip(rows, labels, strict=True) for f in r)
    total = {y: nbsvm.DIM + sum(v for (k, _), v in n.items() if k == y) for y in (True, False)}
    assert np.allclose(ratio[:60], [math.log((1 + n[True, f]) / total[True]) - math.log((1 + n[False, f]) / total[False]) for f in range(60)])
    weights, bias = nbsvm.descend(rows, labels, ratio, cost=0.5, epochs=2000)
    sign = np.where(labels, 1, -1)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + 0.5 * sum(max(0.0, 1 - s * (ratio[r] @ w[r] / max(1, len(r)) ** 0.5 + b)) for s, r in zip(sign, rows, strict=True))

    best = loss(weights, bias)
    for _ in range(200):
        step = np.zeros(len(weights))
        step[:60] = generator.normal(size=60) * generator.choice([1e-3, 1e-2, 0.1])
        assert loss(weights + step, bias + generator.normal() * 1e-2) >= best - 1e-6


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op11_nb_svm_quality"](spark, sf).collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows.keys() == docs.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in rows.items())
    known = [(rows[r["doc_id"]]["predicted"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in known) >= 0.9 * len(known)


def test_quality_edges(spark):
    good, bad = [" ".join(rng.choices(WORDS, k=60)) for _ in range(30)], ["".join(f"{w}$$$ " for w in rng.choices(WORDS, k=60)) for _ in range(30)]
    texts = [*good, *bad, None, "", "word " * 400_000, good[0]]
    docs = spark.createDataFrame([(i, t, 1.0, "p") for i, t in enumerate(texts)] + [(None, good[1], 2.0, "p"), (3, good[3], 1.0, "p")], "doc_id long, text string, score double, places string")
    labels = spark.createDataFrame([(i, int(i < 30), "x") for i in range(60)] + [(0, 1, "x"), (None, 0, "x"), (5, 7, "x"), (7, None, "x"), (61, 0, "x"), (61, 1, "x")], "doc_id long, quality int, text string")
    found = nbsvm.held_out_quality(docs, labels).collect()
    assert len(found) == len(texts) + 2
    by = {r["doc_id"]: r for r in found}
    assert all(by[i]["predicted"] == 1 for i in range(30)) and all(by[i]["score"] < 0.5 for i in range(30, 60))
    assert by[60]["score"] == by[61]["score"] and by[63]["score"] == by[0]["score"] and not by[None]["held_out"]
    assert {r["score"] for r in nbsvm.held_out_quality(docs, labels.limit(0)).collect()} == {0.5}
    one = nbsvm.held_out_quality(docs, labels.filter("quality = 1")).select("score").distinct().collect()
    assert len(one) == 1 and one[0][0] > 0.9
    assert nbsvm.held_out_quality(docs.limit(0), labels).columns == ["doc_id", "held_out", "score", "predicted"]
    assert nbsvm.held_out_quality(docs.limit(0), labels).count() == 0


def brute_negatives(rows):
    used = []
    for n, (vec_id, vector, label) in enumerate(rows):
        if label is not None and vector is not None and all(c is not None and math.isfinite(c) for c in vector):
            used.append((n, vec_id, [math.floor(256 * c) for c in vector], (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label))
    out = []
    for n, anchor, a, label in used:
        if anchor is None or anchor % 100:
            continue
        scores = sorted(((-sum(x * y for x, y in zip(a, b, strict=False)), i is None, i or 0, m, k) for m, i, b, k in used if m != n))
        others = [(-s, None if none else i) for s, none, i, _, k in scores if k != label]
        for s, none, i, _, _ in [x for x in scores if x[4] == label][:5]:
            found = [(v, j) for v, j in others if 30 * -s <= 100 * v <= 90 * -s][:10]
            out += [(anchor, None if none else i, r, j, -s, v) for r, (v, j) in enumerate(found, 1)]
    return collections.Counter(out)


def mined(spark, rows):
    table = spark.createDataFrame([(i, v, k, 1, 2) for i, v, k in rows], "vec_id long, embedding array<float>, label int, qid int, x int")
    return collections.Counter(map(tuple, hardneg.mine(table).collect()))


def test_hard_negatives_against_brute_force(spark):
    """A vector shared by a third of the rows, ties, null ids, repeated ids, unequal lengths, null and non-finite entries; blocks of a few classes."""
    g = np.random.default_rng(4)
    point = lambda: [float(x) for x in np.float32(g.integers(-3, 4, 6) / 8)]
    common = point()
    rows = [(int(i), common if i % 3 == 0 else point(), int(g.integers(0, 4))) for i in range(420)]
    rows += [(None, point(), 1), (None, common, 2), (100, point(), 3), (100, point(), 3), (200, common, None), (300, None, 1), (7, [1.0, None], 1), (8, [float("nan")] * 6, 1), (9, [float("inf")] * 6, 1), (10, [0.5, 0.25], 2), (1000, [], 2), (1100, [1.0] * 8, 2), rows[0]]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(hardneg, "BLOCK", 16)
        m.setattr(hardneg, "STEP", 2)
        m.setattr(hardneg, "ASKS", 3)
        assert mined(spark, rows) == brute_negatives(rows)


def test_hard_negatives_edges(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(100, [1.0], 1)])
    huge = [(100, [1e30, 1.0], 1), (101, [2.0, 1.0], 1), (102, [1.0, 0.5], 2), (103, [1.0, 0.25], 2)]
    assert len(mined(spark, huge)) <= 2


def test_large_integers_are_multiplied_exactly():
    a, b = np.array([[3_000_000_001, 1]], np.int64), np.array([[2_900_000_003, -7], [1, 1]], np.int64)
    assert hardneg.inner(a, b).tolist() == [[3_000_000_001 * 2_900_000_003 - 7, 3_000_000_002]]


def test_lists_far_below_are_never_visited():
    centres = np.array([[10.0, 0], [9, 1], [0, 10], [-10, 0]])
    lists = hardneg.Lists(centres, np.array([0.5, 0.5, 0.5, 0.5]), np.array([1, 1, 1, 1]))
    a = np.array([10.0, 0])
    assert lists.visits(a, [], [-np.inf], 0, 2) == ([0, 1], 2)
    assert lists.visits(a, [], [90.0], 0, 9) == ([0, 1], 2)
    assert lists.visits(a, [], [90.0], 2, 9) == ([], 4)
    assert lists.visits(a, [100], [-np.inf], 0, 9)[0] == [1]  # the others lie outside 30 to 90
    high = lists.bounds(a)[1]
    assert lists.visits(a, [], [float(high[1])], 0, 9)[0] == [0, 1] and lists.visits(a, [], [float(np.nextafter(high[1], 1e9))], 0, 9)[0] == [0]


def test_visits_are_one_row_for_each_anchor_in_a_round(spark):
    """Staged visits follow the anchors, not anchors times lists, each of which once had a row with the anchor's vector."""
    g = np.random.default_rng(8)
    rows = [(int(i), [float(c) for c in v], int(k)) for i, v, k in zip(range(0, 60_000, 50), np.float32(g.normal(size=(1200, 16)) / 4), g.integers(0, 4, 1200), strict=True)]
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    old = set(shared.glob("visits-*"))
    assert mined(spark, rows)
    visits = [spark.read.parquet(str(p)) for p in set(shared.glob("visits-*")) - old]
    counts = [v.count() for v in visits]
    assert max(counts) == 600 and all(v.select("qid").distinct().count() == n for v, n in zip(visits, counts, strict=True))


@pytest.mark.parametrize("same", [True, False])
def test_a_shelf_gives_the_first_rows_of_each_window(monkeypatch, same):
    """Ties in plenty, classes of several members, null ids, windows of several scores, few queries at once, and candidates cut again and again."""
    monkeypatch.setattr(hardneg, "AT_ONCE", 3)
    monkeypatch.setattr(hardneg, "HELD", 40)
    g = np.random.default_rng(6)
    most = 4
    blocks, plain = [], []
    for block in range(3):
        classes = []
        for _ in range(40):
            members = sorted(((bool(g.random() < 0.1), int(g.integers(0, 50)), int(u)) for u in g.integers(0, 1 << 40, g.integers(1, 4))))
            classes.append((members, g.integers(-2, 3, 3).tolist(), int(g.integers(0, 3))))
        classes.sort()
        plain += [(block, v, k, m) for members, v, k in classes for m in members]
        flat = [m for members, *_ in classes for m in members]
        packed = [np.array([v for _, v, _ in classes], "<i2"), np.array([k for *_, k in classes], "<i8"), np.cumsum([len(m) for m, *_ in classes]).astype("<i8")]
        packed += [np.array([m[1] for m in flat], "<i8"), np.array([m[0] for m in flat]), np.array([m[2] for m in flat], "<i8")]
        blocks.append((block, 0, "<i2", *[c.tobytes() for c in packed]))
    blocks = pd.DataFrame(blocks, columns=["block", "shelf", "kind", "x", "labels", "stops", "ids", "nones", "uids"])
    asked, want = [], collections.Counter()
    for qid in range(11):
        v, label, asks = g.integers(-2, 3, 3), int(g.integers(0, 3)), g.permutation(3)[: g.integers(1, 4)]
        positives = [] if same else sorted({int(p) for p in g.integers(-2, 9, g.integers(1, 4))})
        kth = [-(1 << 63) if g.random() < 0.5 else int(g.integers(0, 4)) for _ in (positives or [None])]
        asked.append((qid, label, v, np.array(positives, np.int64), np.array(kth, np.int64), asks.astype(np.int32)))
        for j, (p, k) in enumerate(zip(positives or [None], kth, strict=True)):
            found = [(-int(v @ x), m) for b, x, own, m in plain if b in asks and (own == label) == same]
            found = sorted(f for f in found if -f[0] >= k and (p is None or 30 * p <= 100 * -f[0] <= 90 * p))
            want.update((qid, j, -s, m[1], m[0], m[2]) for s, m in found[:most])
    found = hardneg._score(pd.DataFrame(asked, columns=["qid", "label", "x", "positives", "kth", "asked"]), blocks, 3, most, same)
    assert want and collections.Counter(found.itertuples(index=False, name=None)) == want


def test_scores_that_are_cut_to_longs_are_not_passed_over(spark):
    """Both rows of the other label score beyond the least long; the window takes none of them, and the one row of the label is still found."""
    far = [(100, [1e17, 1e17], 1), (101, [-1e17, -1e17], 1), (102, [2e16, 2e16], 1), (103, [1e16, 1e16], 2)]
    lists = hardneg.Lists(np.array([[-1e19, -1e19]]), np.array([1.0]), np.array([1]))
    state = pd.DataFrame({"qid": [0], "label": 1, "x": [np.array([1 << 62, 1 << 62])], "positives": [np.zeros(0, np.int64)], "kth": [np.array([hardneg.LOWEST])], "start": 0})
    assert [f["asked"][0][0].tolist() for f in hardneg._plans(lists, iter([state]), 8)] == [[0]]
    assert {r[1] for r in hardneg.mine(spark.createDataFrame(far, "vec_id long, embedding array<double>, label int")).collect()} <= {101, 102}


def test_plans_are_made_a_few_queries_at_a_time():
    """Blocks are asked for by shelf, once each, in frames of AT_ONCE queries; a query without lists to visit has no row."""
    lists = hardneg.Lists(np.array([[10.0, 0], [9, 1], [0, 10], [-10, 0]]), np.array([0.5, 0.5, 0.5, 0.5]), np.array([1, 3, 0, 2]), np.array([0, 0, 1, 1, 2, 2]))
    assert [(int(s), b.tolist()) for s, b in zip(*lists.shelved([3, 0, 1]), strict=True)] == [(0, [0, 1]), (1, [2, 3]), (2, [4, 5])]
    assert [(int(s), b.tolist()) for s, b in zip(*lists.shelved([1]), strict=True)] == [(0, [1]), (1, [2, 3])]
    n = 2 * hardneg.AT_ONCE + 5
    state = pd.DataFrame({"qid": range(n), "label": 0, "x": [np.array([10, 0])] * n, "positives": [np.zeros(0, np.int64)] * n, "kth": [np.array([-(1 << 63) if i else 1 << 40]) for i in range(n)], "start": 0})
    frames = list(hardneg._plans(lists, iter([state]), 2))
    assert max(map(len, frames)) <= hardneg.AT_ONCE and [q for f in frames for q in f["qid"]] == list(range(1, n))
    assert all(np.concatenate(a).tolist() == [0, 1, 2, 3] for f in frames for a in f["asked"])


def test_hard_negatives_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, QUERIES["op12_hard_negatives"](spark, sf).collect())) == sorted(con.execute(ORACLE_SQL["op12_hard_negatives"]).fetchall())


def test_whitening_against_numpy(spark):
    g = np.random.default_rng(9)
    vectors = (g.normal(size=(300, 40)) * np.linspace(0.2, 3, 40)).astype(np.float32)
    rows = [(i if i else None, [float(c) for c in v]) for i, v in enumerate(vectors)] + [(5, [float(c) for c in vectors[5]])]
    bad = [(1000, None), (1001, [None] * 40), (1002, [float("nan")] * 40), (1003, [float("-inf")] * 40), (1004, [1.0, 2.0]), (1005, [])]
    table = spark.createDataFrame([(i, v, "n") for i, v in rows + bad], "vec_id long, embedding array<float>, centred string")
    found = whitening.whiten(table).collect()
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], object)
    n, d = len(x), len(x) * x - x.sum(axis=0)
    assert len(found) == n * 32 and {r["n"] for r in found} == {n}
    value, vector = np.linalg.eigh((d / n).astype(float).T @ (d / n).astype(float) / n)
    want = np.abs((d / n).astype(float) @ vector[:, ::-1][:, :32] / np.sqrt(value[::-1][:32]))
    deviation = (d**2).sum(axis=1)
    own = collections.Counter((i, int(s)) for (i, _), s in zip(rows, deviation, strict=True))
    assert collections.Counter((r["vec_id"], r["deviation"]) for r in found if r["component"] == 1) == own
    at = {i: k for k, (i, _) in enumerate(rows)}
    assert all(abs(abs(r["whitened"]) - want[at[r["vec_id"]], r["component"] - 1]) < 1e-8 for r in found)
    share = value[::-1] / value.sum()
    assert all(abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in found)


def test_whitening_edges(spark):
    def table(rows):
        return spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    assert whitening.whiten(table([])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, []), (2, [])], [(i, [1.0, 2.0]) for i in range(5)]):
        assert whitening.whiten(table(rows)).count() == 0
    flat = whitening.whiten(table([(i, [float(i), 2.0 * i, 1.0]) for i in range(6)])).collect()
    assert {r["component"] for r in flat} == {1} and all(abs(r["explained"] - 1) < 1e-9 for r in flat)
    far = whitening.whiten(table([(i, [1e300 * (-1) ** i, float(i)]) for i in range(9)])).collect()
    assert {r["deviation"] for r in far} == {None} and len({r["vec_id"] for r in far}) == 9
    assert whitening.deviations(np.array([[1 << 40, 3]])) == [(1 << 80) + 9]


@pytest.mark.parametrize("name", ["op11_nb_svm_quality", "op13_embedding_whitening"])
def test_queries_give_every_row(spark, name):
    found = QUERIES[name](spark, SF)
    key = found.columns[0]
    table = "documents" if key == "doc_id" else "embeddings"
    assert found.select(key).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").select(F.countDistinct(key)).first()[0]
