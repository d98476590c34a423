import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.llm.mixing import emit, mix_sources, word_count


def targets(sizes, weights=(3, 1, 2)):
    """Sharing by rounds: what lies above a cap is shared anew until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left = {}, 1.5 * sum(sizes.values())
    while weight:
        total = sum(weight.values())
        over = [s for s in weight if left * weight[s] / total >= 2 * sizes[s]]
        if not over:
            return out | {s: left * w / total for s, w in weight.items()}
        held = 0
        for s in over:
            out[s] = 2.0 * sizes[s]
            held += out[s]
            del weight[s]
        left -= held
    return out


def rows(seed):
    rng = random.Random(seed)
    names = ["a", "b", None, "", "é", "z", "hot", "\U0001f600", ""]
    out = []
    for i in range(2500):
        source = "hot" if i % 3 == 0 else rng.choice(names)
        out.append((i, source, int(rng.paretovariate(1.1) * 20) if rng.random() > 0.05 else 0))
    return out + [(7, "a", 30)] * 40 + [(None, "b", 5)] * 3 + [(9000, "only", 100_000), (9001, "none", 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_copies_and_reruns(spark, seed):
    given = rows(seed)
    docs = spark.createDataFrame(given, "doc_id long, source string, size long").withColumn("_copies", F.lit("clash"))
    found = mix_sources(docs.repartition(5), F.col("size"), F.col("source")).cache()
    out = found.collect()
    assert Counter((r.doc_id, r.source, r.size) for r in out) == Counter(given)
    sizes = defaultdict(int)
    longest = defaultdict(int)
    for _, s, n in given:
        sizes[s] += n
        longest[s] = max(longest[s], n)
    wanted = targets(dict(sizes))
    taken = defaultdict(int)
    for r in out:
        assert 0 <= r._copies <= 2 and r._source_size == sizes[r.source] and r._target == pytest.approx(wanted[r.source])
        taken[r.source] += r.size * r._copies
    for s, target in wanted.items():
        few = sum(1 for _, own, n in given if own == s and n) < 10
        assert abs(taken[s] - target) <= (longest[s] if few else max(0.02 * target, 3))
    again = mix_sources(docs.orderBy("size").coalesce(1), F.col("size"), F.col("source"))
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, out))
    mix = Counter((r.doc_id, r.source, r.size) for r in emit(found).collect())
    assert mix == Counter(k for r in out for k in [(r.doc_id, r.source, r.size)] * r._copies)


def test_every_document_is_as_likely(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).alias("size"))
    seen = Counter()
    for k in range(5):
        seen.update({r.doc_id: r._copies for r in mix_sources(docs, F.col("size"), F.col("source"), percent=130, seed=f"run {k}", long_share=1).collect()})
    assert abs(sum(seen.values()) - 5 * 520) <= 5 and {n for n in seen.values()} <= set(range(5, 11)) and len(set(seen.values())) > 1


def test_words_and_empty_tables(spark):
    texts = spark.createDataFrame([(None,), ("",), (" \t\x0b",), ("a b\nc\x0cé x",)], "t string")
    assert [r[0] for r in texts.select(word_count(F.col("t"))).collect()] == [0, 0, 0, 4]
    none = spark.createDataFrame([], "doc_id long, source string, size long")
    assert mix_sources(none, F.col("size"), F.col("source")).count() == 0
    empty = mix_sources(spark.createDataFrame([(1, "s", 0), (2, None, 0)], none.schema), F.col("size"), F.col("source")).collect()
    assert all(r._target == 0 for r in empty)
