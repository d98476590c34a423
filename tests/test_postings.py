import random

from pyspark.sql import functions as F

from foliant.operators import search
from foliant.operators.postings import Postings


def test_top_rows_equal_those_over_whole_texts(spark, tmp_path):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["Apple", "Über", "x1"]
    rows = [(d, p, rng.choice("ab"), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for d in range(60) for p in (1, 2)] + [(90, 1, "a", "... ---"), (91, 1, "a", None), (92, 1, "b", "w1 " * 5000)]
    chunks = spark.createDataFrame(rows, "doc_id long, page int, source string, text string")
    index = Postings(spark, str(tmp_path / "i"), width=16, parts=4)
    index.build(chunks)
    for query, k in (("w1 apple", 10), ("w7", 1), ("w3 w4 w5 w6", 500), ("...", 4), ("", 3), ("nothing here", 7)):
        want = search.lexical_scores(chunks, query, 16).orderBy(F.desc("score"), "doc_id", "page").limit(k)
        shape = lambda f: sorted((r.doc_id, r.page, r.source, r.text, r.score + 0.0) for r in f.collect())
        assert shape(index.top(query, k)) == shape(want), query


def test_a_query_reads_its_own_buckets(spark, tmp_path):
    chunks = spark.createDataFrame([(d, 1, " ".join(f"w{(d + i) % 50}" for i in range(40))) for d in range(200)], "doc_id long, page int, text string")
    index = Postings(spark, str(tmp_path / "i"))
    index.build(chunks)
    plan = index.scores("w1 w2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    empty = Postings(spark, str(tmp_path / "e"))
    empty.build(chunks.limit(0))
    assert empty.top("w1", 5).count() == 0
