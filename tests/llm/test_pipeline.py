import random
from pathlib import Path

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
from foliant.llm.scratch import read  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
def test_stages_keep_columns_and_take_effect(spark):
    docs = read(spark, SF, "documents")
    extra = docs.limit(3).unionByName(docs.limit(3).selectExpr("doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars"))
    docs = docs.unionByName(extra).selectExpr("*", "'x' AS _key", "1 AS kept", "2 AS row", "3 AS key", "4 AS _score", "5 AS n", "6 AS document", "7 AS _hash")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        n = out.count()
        assert 0 < n <= docs.count()
    near = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert near.where("text IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def slow_pipeline(docs, items):
    """Texts by doc_id after near-dedup, cutting and decontamination, by the definitions."""

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    kept = {}
    for i, t in sorted(docs.items()):
        if all(len(shingles(t) & shingles(o)) < 0.75 * len(shingles(t) | shingles(o)) for o in kept.values()):
            kept[i] = t
    out = {}
    for i, t in kept.items():
        earlier = {o[k : k + 50] for j, o in kept.items() if j < i for k in range(len(o) - 49)}
        gone = {k + d for k in range(len(t) - 49) if t[k : k + 50] in earlier for d in range(50)}
        out[i] = "".join(c for k, c in enumerate(t) if k not in gone)
    return {i: t for i, t in out.items() if not any(item in t for item in items)}


@pytest.mark.parametrize("label", [None, 0, 1])
def test_run_against_brute_force(spark, tmp_path, label):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    item, passage = words(30), words(15)
    docs = {i: words(60) for i in range(24)}
    docs[20] = docs[3]
    docs[21] = docs[4] + " tail"
    docs[7] += " " + passage + " " + words(10)
    docs[22] = docs[22] + " " + passage + " " + words(10)
    docs[11] = words(20) + " " + item + " " + words(20)
    spark.createDataFrame([(i, t, len(t)) for i, t in docs.items()], "doc_id long, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, label) for i in range(10) if label is not None], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = slow_pipeline(docs, [item])
    assert 20 not in want and 21 not in want and 11 not in want and want[22] != docs[22]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and all(r.decoded_exactly for r in got.values())
    frame = spark.createDataFrame(list(want.items()), "doc_id long, text string")
    assert {r.doc_id: r.ids_crc32 for r in corpus_pipeline.encode_pieces(spark, frame, "").collect()} == {i: r.ids_crc32 for i, r in got.items()}


def test_toxic_rows_go_and_clean_rows_stay(spark, tmp_path):
    rng = random.Random(12)
    plain = lambda: [f"word{rng.randrange(300)}" for _ in range(40)]
    toxic = {i for i in range(500) if i % 7 == 0}
    texts = {i: " ".join(plain() + ["scum", "grobian", "scum"] * (i in toxic)) for i in range(500)}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(900, None, "x"), (901, "", "x")], "doc_id long, text string, _score string")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == (set(range(500)) - toxic) | {900, 901}
