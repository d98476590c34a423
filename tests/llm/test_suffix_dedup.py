import hashlib
import random

import numpy as np

from foliant.llm import suffix_dedup
from foliant.llm.suffix_dedup import prefix_ranks, remove_repeats, repeated_windows


def brute_force(rows, length):
    """Removed bytes by looking every string up in all documents with a smaller id."""
    last = (1 << 63) - 1
    texts = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            first[s] = min(first.get(s, last + 1), i)
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_ranks_sort_prefixes():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 5, 50, 400):
        for symbols in (1, 2, 4, 200):
            s = rng.integers(1, symbols + 1, n)
            order = np.argsort(prefix_ranks(s, 50))
            prefixes = [tuple(s[i : i + 50]) for i in order]
            assert prefixes == sorted(prefixes)


def test_windows_of_pieces():
    own, lo, hi = repeated_windows([b"abcdefgh", b"xbcdefgx", b"abcdefgh"], np.array([1, 2, 0]), 4)
    assert list(zip(own.tolist(), lo.tolist(), hi.tolist(), strict=True)) == [(0, 0, 5), (1, 1, 4)]


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(4)]
    rows = []
    for i in range(60):
        text = " ".join(word() for _ in range(rng.randint(0, 60)))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(text))
            cut = rng.choice(passages)
            text = text[:at] + cut[rng.randint(0, 30) : rng.randint(60, 200)] + text[at:]
        rows.append((rng.randint(0, 50), text))
    rows += [(None, passages[0]), (None, passages[0]), (70, None), (71, ""), (72, "ab" * 400), (73, "x" + "ab" * 300), (74, passages[1]), (74, passages[1]), (75, "z" * 49), (76, "z" * 49)]
    rows.append((77, "start " + "long words without end " * 60_000 + passages[2]))
    docs = spark.createDataFrame([(*r, "k", i) for i, r in enumerate(rows)], "doc_id long, text string, document string, row int")
    for hot in (suffix_dedup.HOT_PIECES, 1):
        monkeypatch.setattr(suffix_dedup, "HOT_PIECES", hot)
        got = remove_repeats(docs, with_rows=True).collect()
        assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_force(rows, 50)
        assert sorted((r.document.row, r.document.doc_id) for r in got) == [(i, r[0]) for i, r in enumerate(rows)]
        for r in got:
            assert list(r.document.asDict()) == docs.columns and r.document.document == "k"
            if r.n_removed == 0:
                assert r.document.text == rows[r.document.row][1]
                assert r.kept_sha256 == hashlib.sha256((r.document.text or "").encode()).hexdigest()
    assert remove_repeats(docs.limit(0), with_rows=True).count() == 0
    assert remove_repeats(docs.select("doc_id", "text"), with_rows=True).select("document.*").columns == ["doc_id", "text"]


def test_least_places_of_any_length():
    rng = np.random.default_rng(1)
    gram = rng.integers(0, 1 << 63, 200_000, dtype=np.uint64) << np.uint64(1)
    view = np.lib.stride_tricks.sliding_window_view(gram, 31)
    assert (suffix_dedup.least_places(gram, 31) == np.arange(len(view)) + view.argmin(1)).mean() > 0.9999
    assert len(suffix_dedup.least_places(gram[:30], 31)) == 0
