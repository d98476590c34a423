"""Vector queries over more than one block of points, held against their SQL."""

import duckdb
import numpy as np
import pytest

import __spark_entry__

TABLES = "/root/testdata/sf0.001"
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def points(spark, tmp_path_factory):
    """The smallest tables with 5,000 vectors, and partitions that stay apart as they do on larger tables."""
    folder = tmp_path_factory.mktemp("blocks")
    for name in NAMES:
        (folder / f"{name}.parquet").symlink_to(f"{TABLES}/{name}.parquet")
    x = np.random.default_rng(4).normal(size=(5000, 8)).astype(np.float32)
    rows = [(i, v, i % 10) for i, v in enumerate(x.tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield str(folder)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("name", ["duplicate_candidates", "similar_docs", "similar_metadata", "similar_titles"])
def test_equal_to_sql(spark, points, name):
    with duckdb.connect() as db:
        for table in NAMES:
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{points}/{table}.parquet'")
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{points}/embeddings.parquet/*.parquet'")
        found = db.execute(__spark_entry__.oracle_sql()[name])
        columns = [c[0] for c in found.description]
        want = sorted(found.fetchall(), key=str)
    got = sorted((tuple(r) for r in __spark_entry__.queries()[name](spark, points).select(*columns).collect()), key=str)
    assert len(want) >= 250 and got == want
