"""Language model and toxicity on small corpora."""

import math
import random

import pytest

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foliant.llm import gru_lm, toxic_segments
from foliant.llm import words as W


def test_window_gradient_matches_differences():
    rng = np.random.default_rng(0)
    size = gru_lm.HEAD + gru_lm.TAIL_CLASSES
    lexicon = gru_lm.Lexicon(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, int), 0, 0, np.ones(gru_lm.TAIL_CLASSES), np.zeros(gru_lm.CLASSES), np.zeros((gru_lm.HEAD_CLASSES, gru_lm.CLASS_SIZE)))
    w = gru_lm.Weights.initial(lexicon, 1)
    ids = rng.integers(0, size, (6, 3))
    live = np.ones(ids.shape, bool)

    def loss(v):
        h, states = np.zeros((3, gru_lm.HIDDEN), np.float32), []
        for t in range(len(ids)):
            states.append(h)
            h, _ = gru_lm._step(v, h, ids[t])
        return -gru_lm.log_probabilities(v, np.array(states).reshape(-1, gru_lm.HIDDEN), ids.ravel()).mean()

    found = {}

    def keep(w, k, gradient, rate):
        found[k] = gradient

    original, gru_lm._descend = gru_lm._descend, keep
    try:
        gru_lm.train_window(w, np.zeros((3, gru_lm.HIDDEN), np.float32), ids, live, 0.1)
    finally:
        gru_lm._descend = original
    for k, at in ((1, (3, 7)), (1, (5, 14)), (1, (5, 30)), (2, (2, 1)), (0, (int(ids[0, 0]), 5)), (0, (int(ids[1, 0]), 20)), (0, (int(ids[2, 1]), 30))):
        a = w.arrays()[k]
        value = a[at]
        a[at] = value + 1e-2
        up = loss(w)
        a[at] = value - 1e-2
        down = loss(w)
        a[at] = value
        assert abs((up - down) / 2e-2 - found[k][at]) < 2e-3


def test_scores_and_base(spark):
    rng = random.Random(1)
    kinds = ["alpha beta gamma delta".split(), "eins zwei drei vier".split()]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(rng.randint(5, 80)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "Never seen WORDS alpha"), (None, "alpha beta")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n_tokens int")
    train = docs.where("doc_id < 250")
    out, lexicon = gru_lm.score_documents(docs, train)
    got = {r.doc_id: r for r in out.collect()}
    count = {}
    for i, t in rows[:250]:
        for x in (t or "").lower().split() + ["\n"]:
            count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    assert (lexicon.tokens, lexicon.distinct) == (n, v)
    for i, t in rows:
        words = (t or "").lower().split() + ["\n"]
        base = sum(math.log10((count.get(x, 0) + 1) / (n + v + 1)) for x in words)
        assert abs(got[i].base_score - base) < 1e-6 and got[i].n_tokens == len(words) and got[i].n_known == sum(x in count for x in words)
        assert math.isfinite(got[i].score) and got[i].score < 0
    held = [i for i in range(250, 300)]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)
    assert gru_lm.score_documents(docs.limit(0), train.limit(0))[0].count() == 0


def forward(w, lexicon, words):
    """log10 probability of a document by one unbroken pass in double precision, token by token."""
    h, total = np.zeros(gru_lm.HIDDEN), 0.0
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    places = {int(k): i for i, k in enumerate(lexicon.key)}
    for word in [*words, None]:
        part = next(W.slices(pa.array([word or ""])))
        key = int(gru_lm.tokens_of(part).key[0])
        at = places.get(key, -1)
        tail = gru_lm.ending(word.encode() if word else gru_lm.END)
        i = int(lexicon.ids[at]) if at >= 0 else gru_lm.HEAD + tail
        kind = i // gru_lm.CLASS_SIZE if i < gru_lm.HEAD else gru_lm.HEAD_CLASSES + i - gru_lm.HEAD
        scores = h @ w.to_class + w.class_bias
        p = np.exp(scores) / np.exp(scores).sum()
        assert abs(p.sum() - 1) < 1e-6
        total += math.log10(p[kind])
        if i < gru_lm.HEAD:
            inside = h @ w.to_word[kind].T + w.word_bias[kind]
            total += math.log10(np.exp(inside[i % gru_lm.CLASS_SIZE]) / np.exp(inside).sum())
        else:
            total += math.log10((lexicon.count[at] + 1 if at >= 0 else 1) / lexicon.tail_total[tail])
        x, u, m = w.inputs[i], h @ w.recurrent, gru_lm.HIDDEN
        z, r = sigmoid(x[:m] + u[:m]), sigmoid(x[m : 2 * m] + u[m : 2 * m])
        n = np.tanh(x[2 * m :] + r * u[2 * m :])
        h = (1 - z) * n + z * h
    return total


def test_score_is_that_of_one_pass_over_the_whole_document(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 4, 5]))) for _ in range(2500)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 31, 32, 33, 300]))] for _ in range(50)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept, fit = [], gru_lm.fit

    def keep(train, lexicon):
        kept.append((fit(train, lexicon), lexicon))
        return kept[0][0]

    monkeypatch.setattr(gru_lm, "fit", keep)
    out, _ = gru_lm.score_documents(docs, docs.where("doc_id < 30"))
    got = {r.doc_id: r.score for r in out.collect()}
    w, lexicon = kept[0]
    count = {}
    for t in texts[:30]:
        for x in [*t, None]:
            count[x] = count.get(x, 0) + 1
    assert len(count) > gru_lm.HEAD and len(lexicon.key) == len(count)
    for i, t in enumerate(texts):
        assert abs(got[i] - forward(w, lexicon, t)) < 1e-3 * (1 + len(t))
    # Shares of the words of a class of endings, and of unknown words, sum to 1.
    for k in range(gru_lm.TAIL_CLASSES):
        own = (lexicon.ids == gru_lm.HEAD + k)
        assert abs((lexicon.count[own] + 1).sum() + 1 - lexicon.tail_total[k]) < 1e-6


def test_score_beats_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    out, _ = gru_lm.score_documents(docs.where("held"), docs.where("NOT held"))
    rows = out.collect()
    assert sum(r.score > r.base_score for r in rows) >= 0.9 * len(rows)


def test_weights_see_every_learning_row(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha beta {i}") for i in range(200)], "doc_id long, text string")
    seen, fit = [], gru_lm.fit

    def keep(train, lexicon):
        seen.extend((r.text, r.turn) for r in train.collect())
        return fit(train, lexicon)

    monkeypatch.setattr(gru_lm, "fit", keep)
    gru_lm.score_documents(docs, docs)
    assert sorted(t for t, _ in seen) == sorted(f"alpha beta {i}" for i in range(200)) and {k for _, k in seen} == {0, 1}


def slow_segments(scores):
    """Maximal segments by the definition: the best one, then both sides of it."""

    def best(lo, hi):
        found = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > 1e-12 and (found is None or total > found[2] + 1e-9):
                    found = (i, j + 1, total)
        if found is None:
            return []
        return best(lo, found[0]) + [found] + best(found[1], hi)

    return best(0, len(scores))


def test_segments_against_the_definition():
    rng = np.random.default_rng(4)
    for _ in range(60):
        scores = np.where(rng.random(40) < 0.3, rng.integers(1, 9, 40) + rng.random(40), 0.0)
        at = np.flatnonzero(scores)
        got = toxic_segments.maximal_segments(at, scores[at], 0.93)
        want = slow_segments((scores - 0.93).tolist())
        assert [(s, e) for s, e, _ in got] == [(s, e) for s, e, _ in want]


def test_toxicity_learns_stems_and_handles_edges(spark):
    rng = random.Random(2)
    clean = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(800):
        words = [rng.choice(clean) for _ in range(rng.randint(20, 120))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["Scum!", "grobian" + rng.choice("abcdef"), "idiot,"]))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(9000, None, "x"), (9001, "", "x"), (None, "scum idiot", "x")], "doc_id long, text string, _h string")
    known = spark.createDataFrame(labels[:600] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxic_segments.train(docs.where("doc_id < 600"), known)
    got = {r.doc_id: r for r in toxic_segments.score(docs, model).collect()}
    hits = [got[i]._score >= 0.3 for i in range(600, 800)]
    truth = [i % 8 == 0 for i in range(600, 800)]
    assert sum(h == t for h, t in zip(hits, truth, strict=True)) >= 196
    assert got[9000]._score < 0.3 and got[9001]._segments == [] and 0 <= got[None]._score <= 1
    empty = toxic_segments.train(docs, known.limit(0))
    share = lambda m: toxic_segments.score(docs.limit(2), m).select(F.max("_score")).first()[0]
    assert not empty.learned and share(empty) == pytest.approx(0.1)
    assert share(toxic_segments.train(docs, known.where("toxic = 1"))) > 0.9


def test_one_label_in_the_calibration_fold(spark):
    rng = random.Random(6)
    rows = spark.range(700).withColumn("fold", F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(10))).collect()
    toxic = {r.id for r in rows if r.fold < 7 and r.id % 6 == 0}
    text = lambda i: " ".join([f"word{rng.randrange(200)}" for _ in range(40)] + ["scum", "grobian"] * 2 * (i in toxic))
    docs = spark.createDataFrame([(r.id, text(r.id)) for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r.id, int(r.id in toxic)) for r in rows], "doc_id long, toxic int")
    model = toxic_segments.train(docs, labels)
    assert model.learned
    assert {r.doc_id for r in toxic_segments.score(docs, model).where("_score >= 0.3").collect()} == toxic
    assert not toxic_segments.train(docs, labels.where("toxic = 0")).learned
