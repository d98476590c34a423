import random

from foliant.llm import decontaminate
from foliant.llm.decontaminate import contaminated


def brute_force(item, text):
    """Best Smith-Waterman score by the plain recurrence."""
    best, above = 0, [0] * (len(text) + 1)
    for a in item:
        row = [0]
        for j, b in enumerate(text, 1):
            row.append(max(0, above[j - 1] + (2 if a == b else -1), above[j] - 1, row[-1] - 1))
        best, above = max(best, *row), row
    return best


def test_exact_edited_and_clean(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5)))
    items = [[word() for _ in range(30)] for _ in range(6)] + [["too", "short"]]
    docs, expected = [], set()
    for i in range(40):
        text = [word() for _ in range(rng.randint(0, 150))]
        if i % 4 == 0:
            k = i // 4 % 6
            copy = list(items[k])
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [word()], [copy[at], word()]])
            text[10:10] = copy
            expected.add((i, k))
        docs.append((i, ", ".join(text).title(), None))
    docs += [(100, None, None), (101, "", None), (102, " ".join(items[0]), None), (102, " ".join(items[0]), None), (None, " ".join(items[1]), None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(9, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(d, b).collect()}
    assert set(got) == expected | {(102, 0), (None, 1)}
    assert got[102, 0].score == 1.0 and (got[102, 0].first_word, got[102, 0].last_word) == (0, 29)
    for i, k in expected:
        text = docs[i][1].lower().replace(",", "").split()
        assert abs(got[i, k].score - brute_force(items[k], text) / 60) < 1e-6
    assert contaminated(d.limit(0), b).count() == 0 and contaminated(d, b.limit(0)).count() == 0


def test_many_edits_once_and_a_thousand_times(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(40)]
    edited = list(item)
    for at in (5, 14, 23, 32):
        edited[at] = word()
    noise = [(i, " ".join(word() for _ in range(60))) for i in range(100)]
    b = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    one = spark.createDataFrame([*noise, (500, " ".join(edited))], "doc_id long, text string")
    got = contaminated(one, b).collect()
    assert [(r.doc_id, r.score) for r in got] == [(500, brute_force(item, edited) / 80)]
    copies = [(1000 + i, " ".join([*edited, *([word()] if i % 2 else [])])) for i in range(1000)]
    many = spark.createDataFrame(noise + copies, "doc_id long, text string")
    assert {r.doc_id for r in contaminated(many, b).collect()} == {i for i, _ in copies}


def test_spread_copy_is_aligned_whole(spark):
    item = [f"w{i}" for i in range(20)]
    spread = item[:3] + [x for i, w in enumerate(item[3:]) for x in (f"extra{i}", w)]
    docs = spark.createDataFrame([(1, " ".join(["before"] * 50 + spread + ["after"] * 50))], "doc_id long, text string")
    got = contaminated(docs, spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")).collect()
    assert [r.score for r in got] == [brute_force(item, spread) / 40]
    assert brute_force(item, spread) >= 20


def test_stock_phrases_join_few_passages_and_lose_no_copy(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    stock = ["all", "rights", "are", "reserved"]
    items = [[word() for _ in range(13)] + stock + [word() for _ in range(13)] for _ in range(3)]
    docs = [(i, " ".join([word() for _ in range(40)] + stock + [word() for _ in range(40)])) for i in range(600)]
    # Copies of which nothing but the stock phrase stands three words in a row, and half of the words are left.
    for n in range(40):
        item = items[n % 3]
        kept = [w for i, w in enumerate(item) if w in stock or i % 3 != 2]
        gaps = [x for i, w in enumerate(kept) for x in ([word(), w] if w not in stock and i % 2 == 0 and n % 2 else [w])]
        docs.append((1000 + n, " ".join([word() for _ in range(30)] + gaps + [word() for _ in range(30)])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    made, inner = [], decontaminate._candidates
    monkeypatch.setattr(decontaminate, "_candidates", lambda *given: made.append(inner(*given)) or made[-1])
    rows = lambda f: {(r.doc_id, r.item_id, r.score, r.first_word, r.last_word) for r in f.collect()}
    few = rows(contaminated(d, b))
    every = rows(contaminated(d, b, rare=1 << 40))
    assert few == every
    expected = {(i, k) for i, t in docs for k, item in enumerate(items) if brute_force(item, t.split()) >= 30}
    assert {r[:2] for r in few} == expected and len(expected) >= 20
    pairs, all_pairs = (m.count() for m in made)
    assert all_pairs >= 3 * 600 and pairs <= 100
