import numpy as np
from pyspark.sql import functions as F

from foliant.operators.cells import VectorCells
from foliant.operators.vectors import nearest

KIND = "vec_id long, embedding array<float>, label string"


def clustered(n, groups, width, spread, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    return (centres[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, width))).astype(np.float32)


def rows(found):
    return {(r.query_id, r.vec_id, r.score, r.rank) for r in found.collect()}


def test_exact_search_equals_a_search_through_all_rows(spark, tmp_path):
    x = clustered(1500, 12, 16, 0.4)
    x[100:600] = x[100]  # a third of all rows are copies: one hot cell, ties by vec_id
    x[7] = 0
    points = spark.createDataFrame([(i, v, "a") for i, v in enumerate(x.tolist())], KIND)
    index = VectorCells(spark, str(tmp_path / "i"), block_rows=128)
    index.build(points)
    queries = points.where("vec_id % 20 = 0 OR vec_id = 7")
    for k, probes, least in ((10, 2, None), (3, 1, 0.9), (5, 100, None)):
        assert rows(index.nearest(queries, k, probes=probes, least=least)) == rows(nearest(queries, points, k, least=least)), (k, probes)
    assert index.cells().agg(F.sum("rows")).first()[0] == 1500


def test_recall_and_work_of_the_approximate_search(spark, tmp_path):
    x = clustered(4000, 40, 32, 0.5)
    points = spark.createDataFrame([(i, v, None) for i, v in enumerate(x.tolist())], KIND)
    index = VectorCells(spark, str(tmp_path / "i"), sample_rows=2000)
    index.build(points)
    queries = points.where("vec_id % 20 = 0")
    want = {(q, v) for q, v, *_ in rows(nearest(queries, points, 10))}
    got = {(q, v) for q, v, *_ in rows(index.nearest(queries, 10, exact=False))}
    assert len(want & got) >= 0.9 * len(want)
    few = index.probes_for(queries, 10)
    got = {(q, v) for q, v, *_ in rows(index.nearest(queries, 10, probes=few, exact=False))}
    assert 1 <= few <= 8 and len(want & got) >= 0.9 * len(want)
    compared = index.routes(queries, 8).join(index.cells(), "cell").agg(F.sum("rows")).first()[0]
    assert compared <= 0.3 * 200 * 4000
    plan = index._vectors().where(F.col("cell").isin([1]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_bad_rows_empty_tables_and_other_widths(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], None), (3, None, "b"), (4, [], "b"), (5, [1.0, nan], "b"), (6, [inf, 1.0], "b"), (7, [1.0, None], "b"), (8, [1.0, 0.0, 0.0], "b"), (None, [1.0, 0.0], "b"), (9, [1.0, 1.0], "b")]
    points = spark.createDataFrame(data, KIND)
    index = VectorCells(spark, str(tmp_path / "i"))
    index.build(points)
    assert rows(index.nearest(points, 5)) == {(1, 9, 0.707107, 1), (1, 2, 0.0, 2), (2, 9, 0.707107, 1), (2, 1, 0.0, 2), (9, 1, 0.707107, 1), (9, 2, 0.707107, 2)}
    assert index.nearest(points.limit(0), 5).count() == 0
    empty = VectorCells(spark, str(tmp_path / "e"))
    empty.build(points.limit(0))
    assert empty.nearest(points, 5).count() == 0
    zeros = VectorCells(spark, str(tmp_path / "z"))
    zeros.build(spark.createDataFrame([(i, [0.0, 0.0], "z") for i in range(9)], KIND))
    assert {r[:3] for r in rows(zeros.nearest(points.where("vec_id = 1"), 2))} == {(1, 0, 0.0), (1, 2, 0.0)}
