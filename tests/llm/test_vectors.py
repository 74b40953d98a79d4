import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorline.llm import ann, vector_dedup
from anchorline.llm.registry import QUERIES
from tests.llm.plain import FOLDER

BAD = [(901, None), (902, [0.0] * 8), (903, [None, *[1.0] * 7]), (904, [float("nan"), *[1.0] * 7]), (905, [float("inf")] * 8),
       (906, []), (907, [1.0] * 5)]
SCHEMA = "vec_id long, embedding array<float>"


def clusters(seed=4, n=150, size=8):
    """Random vectors, copies of some, near copies of one, one at twice the length."""
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, size)).astype(np.float32)
    x[40:60] = x[0] + rnd.normal(size=(20, size)).astype(np.float32) * 0.08
    x[60:70] = x[1]
    x[70] = 2 * x[1]
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def brute(rows, least=0.95):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= least
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    while True:
        before = root.copy()
        a, b = np.nonzero(linked)
        np.minimum.at(root, a, root[b])
        if (root == before).all():
            return {i: (int(linked[k].sum()), ids[root[k]]) for k, i in enumerate(ids)}


def test_links_equal_all_pairs(spark):
    rows = clusters()
    df = spark.createDataFrame(rows + BAD, SCHEMA).withColumn("n_links", F.lit("own"))
    want = brute(rows) | {i: (0, i) for i, _ in BAD}
    got = vector_dedup.link_vectors(df).collect()
    assert {r.id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_blocks_cover_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 3)
    rows = clusters(5)
    got = vector_dedup.link_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.id: (r.n_links, r.component_id) for r in got} == brute(rows)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (5, [0.0, 1.0])]
    got = vector_dedup.link_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.id or 0, r.n_links, r.component_id) for r in got) == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (5, 0, 5)]
    none = spark.createDataFrame([], SCHEMA)
    assert vector_dedup.link_vectors(none).count() == 0
    assert ann.nearest(none, F.col("vec_id") % 20 == 0).count() == 0
    only_bad = spark.createDataFrame(BAD, SCHEMA)
    assert vector_dedup.link_vectors(only_bad).count() == len(BAD)


def true_nearest(rows, query, k):
    here = next(i for i, (v, _) in enumerate(rows) if v == query)
    scores = [(-float(np.dot(np.float64(x), np.float64(rows[here][1]))), v) for i, (v, x) in enumerate(rows) if i != here]
    return sorted(scores)[:k]


def test_nearest_of_a_small_table_are_all_found(spark):
    rows = clusters()
    got = ann.nearest(spark.createDataFrame(rows + BAD, SCHEMA), F.col("vec_id") % 20 == 0, k=5).collect()
    for query in range(0, 150, 20):
        found = sorted((r.rank, r.id, r.score) for r in got if r.query_id == query)
        want = true_nearest(rows, query, 5)
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert np.allclose([-f[2] for f in found], [s for s, _ in want], atol=1e-9)
        if query != 60:  # there many products are equal but for rounding
            assert [f[1] for f in found] == [v for _, v in want]


def test_ties_rank_by_id_and_few_candidates_are_all_returned(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (9, [0.0, 1.0])], SCHEMA)
    got = ann.nearest(df, F.col("vec_id") == 20).orderBy("rank").collect()
    assert [(r.rank, r.id, r.score) for r in got] == [(1, 2, 1.0), (2, 3, 1.0), (3, 9, 0.0)]


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.1"])
def test_recall_of_the_query(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = {}
    for r in QUERIES["op6_ann"](spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    hit = total = 0
    for at in np.nonzero(ids % 20 == 0)[0]:
        scores = x @ x[at]
        scores[at] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]]
        hit, total = hit + len(got[ids[at]] & set(best.tolist())), total + len(best)
    assert hit / total >= 0.9


def test_the_dedup_query_equals_all_pairs(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()]
    got = QUERIES["op8_vector_dedup"](spark, FOLDER).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)


#: Vectors of a rarer length, and of very large and very small components.
ODD = [
    (800, [1.0, 0.01]), (801, [1.0, 0.0]), (802, [0.0, 3.0]), (803, [1e200, 0.0, 1e200]), (804, [2e200, 1e190, 2e200]),
    (805, [1e-200, 0.0, 3e-200]), (806, [1.01e-200, 0.0, 3e-200]), (807, [1.0, 2.0, 3.0]), (808, [2.0, 4.0, 6.0]),
    (809, [5.0]), (810, [-7.0]), (811, [9.0]),
]


def test_vectors_of_all_lengths_and_magnitudes_are_linked(spark):
    got = vector_dedup.link_vectors(spark.createDataFrame(ODD, "vec_id long, embedding array<double>")).collect()
    want = {800: (1, 800), 801: (1, 800), 802: (0, 802), 803: (1, 803), 804: (1, 803), 805: (1, 805), 806: (1, 805),
            807: (1, 807), 808: (1, 807), 809: (1, 809), 810: (0, 810), 811: (1, 809)}
    assert {r.id: (r.n_links, r.component_id) for r in got} == want


def test_vectors_of_all_lengths_ask_and_answer(spark):
    rows = [(i, v) for i, v in ODD if max(map(abs, v)) < 1e100]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 1 == 0, k=20).collect()
    want = {}
    for i, v in rows:
        same = [(-float(np.dot(v, w)), j) for j, w in rows if j != i and len(w) == len(v)]
        want |= {(i, rank, j): pytest.approx(-less, rel=1e-12) for rank, (less, j) in enumerate(sorted(same), 1)}
    assert {(r.query_id, r.rank, r.id): r.score for r in got} == want
    huge = spark.createDataFrame([(20, [1e200, 1.0]), (21, [1.0, 1e200]), (22, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert len(ann.nearest(huge, F.col("vec_id") == 20, k=20).collect()) == 2
