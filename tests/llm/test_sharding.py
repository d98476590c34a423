import numpy as np
from pyspark.sql import functions as F

from foliant.llm.sharding import communication_matrix, hypergeometric, uniform_shards


def test_draws_follow_the_distribution(spark):
    draws = spark.range(4000).select(hypergeometric(F.lit(60.0), F.lit(25.0), F.lit(18.0), (F.col("id") + 0.5) / 4000).alias("k")).toPandas()["k"]
    expected = np.random.default_rng(1).hypergeometric(25, 35, 18, 200_000)
    for k in range(19):
        assert abs((draws == k).mean() - (expected == k).mean()) < 0.006
    edge = spark.range(1).select(hypergeometric(F.lit(5.0), F.lit(5.0), F.lit(3.0), F.lit(0.3)).alias("a"), hypergeometric(F.lit(5.0), F.lit(0.0), F.lit(3.0), F.lit(0.3)).alias("b")).first()
    assert (edge.a, edge.b) == (3, 0)


def test_exact_sizes_gapless_slots_and_every_row_once(spark):
    rows = [(i if i % 5 else None, None if i % 7 == 0 else "same", i, i) for i in range(1003)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block long, shard long")
    out = uniform_shards(docs, 16, least=16).toPandas()
    assert len(out) == 1003 and sorted(out["block"]) == list(range(1003))
    sizes = out.groupby("_shard").size()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1
    for _, part in out.groupby("_shard"):
        assert sorted(part["_slot"]) == list(range(len(part)))
    assert abs(np.corrcoef(out["block"], out["_shard"])[0, 1]) < 0.15


def test_empty_and_tiny(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert uniform_shards(docs, 16, least=4).count() == 0
    assert uniform_shards(spark.createDataFrame([(1, "a")], docs.schema), 16, least=4).count() == 1


def test_matrix_sums(spark):
    sizes = {0: 40, 1: 0, 2: 7, 3: 300, 5: 1, 6: 90, 7: 13}
    blocks = spark.createDataFrame([(b, n) for b, n in sizes.items()], "block int, n long")
    cells = communication_matrix(blocks, 5, 3, 9).toPandas()
    cells["n"] = cells["_last"] - cells["_first"]
    assert cells.groupby("_matrix_block")["n"].sum().to_dict() == {b: n for b, n in sizes.items() if n}
    by_shard = cells.groupby("_shard")["n"].sum()
    assert sorted(by_shard) == [90, 90, 90, 90, 91]
    for _, part in cells.sort_values("_first").groupby("_matrix_block"):
        assert part["_first"].iloc[0] == 0 and (part["_first"].iloc[1:].to_numpy() == part["_last"].iloc[:-1].to_numpy()).all()


def test_shards_are_uniform(spark):
    """Neighbouring rows meet in a shard as often as chance has it, and runs of rows spread evenly over the shards."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "'t' AS _row")
    for seed in (1, 2):
        out = uniform_shards(docs, 4, seed=seed, least=4).toPandas().sort_values("doc_id")
        assert out["_row"].eq("t").all()
        shard = out["_shard"].to_numpy()
        for gap in (1, 2, 750):
            share, chance = (shard[:-gap] == shard[gap:]).mean(), 749 / 2999
            assert abs(share - chance) < 4.5 * (chance * (1 - chance) / (3000 - gap)) ** 0.5
        seen = np.array([np.bincount(part, minlength=4) for part in np.split(shard, 30)])
        assert ((seen - 25) ** 2 / 25).sum() < 90 + 5 * (2 * 90) ** 0.5
        assert abs(np.corrcoef(out["doc_id"], out["_slot"])[0, 1]) < 0.09


def test_every_row_when_the_splits_change(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat(cast(id AS string), 20) AS text", "1 AS _shard")
    docs.repartition(6).write.parquet(f"{tmp_path}/docs")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        out = uniform_shards(spark.read.parquet(f"{tmp_path}/docs"), 16, least=8)
        spark.conf.set(key, "4096")
        got = out.toPandas()
    finally:
        spark.conf.set(key, before)
    assert sorted(got["doc_id"]) == list(range(4000)) and got.groupby("_shard").size().tolist() == [250] * 16
