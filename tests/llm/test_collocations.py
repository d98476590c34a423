import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliant.llm.collocations import collocations, parse, phrase_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    return counts, total


def brute(rows, least, first):
    f, total = brute_counts(rows)
    found = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        if len(p) == 2 and any(n >= least and 100 * n >= 50 * a and p in (q[:2], q[1:]) for (g, q), n in f.items() if g == lang and len(q) == 3):
            continue
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, own in found.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:first]))


def corpus(seed):
    rng = random.Random(seed)
    common = ["the", "THE", "of", "New", "york", "city", "a-b", "é", "日本", "x" * 40]
    join = [" ", "  ", "\t", ", ", ".", "\n", "\r\n", " ; "]
    texts = ["".join(rng.choice(common) + rng.choices(join, [30, 2, 2, 1, 1, 1, 1, 1])[0] for _ in range(rng.randrange(0, 120))) for _ in range(60)]
    return [(rng.choice(["en", "fr", None]), t) for t in texts] + [("en", texts[0])] * 40 + [("en", None), ("und", "the of the"), ("en", ""), ("fr", "\x0b\x0c"), ("en", "of the " * 4000), ("de", "no. stops. at. all." * 300)]


@pytest.mark.parametrize(("period", "slice_bytes"), [(1, 1 << 20), (3, 200), (32, 1 << 20), (1 << 40, 50)])
def test_counts_do_not_depend_on_the_parse(spark, period, slice_bytes):
    rows = corpus(period)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("lang", F.coalesce("lang", F.lit("und"))).repartition(3)
    dictionary = parse(docs, period=period, slice_bytes=slice_bytes).cache()
    found = phrase_counts(dictionary, 10, slice_bytes=slice_bytes, hold=500, hold_bytes=5000)
    counts, total = brute_counts(rows)
    wanted = {(lang, len(p), " ".join(p)): n for (lang, p), n in counts.items() if n >= 10} | {(lang, 0, ""): n for lang, n in total.items() if n}
    assert {(r.lang, r.k, r.phrase): r.f for r in found.collect()} == wanted


def test_small_filters_and_high_least_counts_change_nothing(spark):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("lang", F.coalesce("lang", F.lit("und")))
    counts, _ = brute_counts(rows)
    for least, bits in ((2, 9), (700, 30)):
        found = phrase_counts(parse(docs), least, max_slot_bits=bits).where("k > 0")
        assert {(r.lang, r.phrase): r.f for r in found.collect()} == {(lang, " ".join(p)): n for (lang, p), n in counts.items() if n >= least}


def test_collocations_against_brute_force(spark):
    rows = corpus(9)
    docs = spark.createDataFrame([(lang, text, "x", 1) for lang, text in rows], "lang string, text string, phrase string, rank int")
    for first in (7, 2000):
        found = collocations(docs, first=first)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, found.collect())) == brute(rows, 10, first)


def test_copies_share_chunks(spark):
    text = " ".join(f"w{i * i % 97}" for i in range(400))
    one = parse(spark.createDataFrame([("en", text)], "lang string, text string"))
    many = parse(spark.createDataFrame([("en", text)] * 50, "lang string, text string"))
    assert one.count() == many.count() and {r.n for r in many.collect()} == {50 * r.n for r in one.collect()}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations(docs).count() == 0
    assert collocations(spark.createDataFrame([(None, None)], docs.schema)).count() == 0


def test_products_beyond_64_bits(spark):
    from foliant.llm.collocations import scored

    big = 3_000_000_000
    counts = spark.createDataFrame([("en", 1, "a", big + 7), ("en", 1, "b", big + 9), ("en", 2, "a b", big)], "lang string, k int, phrase string, f long")
    row = scored(counts, 50).first()
    assert row.score == 10**6 * big * big // ((big + 7) * (big + 9)) and (row.l, row.r) == (big + 7, big + 9)
