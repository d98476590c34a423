import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from foliant.llm.line_rules import assess, repeat_words, without_lines


def slow_repeat_words(words):
    times = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({i + k for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for k in range(3)})


def test_repeat_words():
    for text in ("", "a b", "a b c", "a b c a b c", "x x x x x", "a b c d a b c e b c d", "a a b a a b a a"):
        assert repeat_words(text.encode().split()) == slow_repeat_words(text.encode().split()), text


def test_frequent_lines_deplete_documents(spark):
    body = lambda i: " ".join(chr(97 + i % 26) * (1 + i // 26) + chr(97 + k % 26) + "x" * (k // 26) for k in range(60))
    rows = []
    for i in range(30):
        rows.append((i, f"Cookie Banner {i}\n" + body(i) + "\n" + body(i), "h"))
    common = "Cookie  banner 7\n" * 3 + " ".join(["shared"] + ["c" + "y" * k for k in range(70)])
    for i in range(100, 112):
        rows.append((i, common + f"\nunique {i}", "h"))
    rows += [(200, None, "h"), (201, "", None), (202, "one two", None), (203, common, None), (204, "é" * 3 + " #$|", "h"), (None, body(5), "h"), (0, rows[0][1], "h"), (300, "Cookie Banner 3\n" + body(9), "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS n_words", "'x' AS lines", "'y' AS removed", "2 AS _row")
    got = assess(docs, max_documents=10).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    # Digits are one class, so all banners, and all the last lines, are one line; the long common line is frequent too.
    assert by_id[1][0].n_removed_words == 3 and by_id[1][0].n_dup_lines == 1
    assert by_id[105][0].n_removed_words == 9 + 71 + 2 and not by_id[105][0].kept and not by_id[105][0].base_failed
    assert by_id[203][0].n_removed_words == 0
    assert by_id[200][0].n_words == 0 and by_id[201][0].base_failed and by_id[202][0].base_failed
    assert (by_id[204][0].word_chars, by_id[204][0].n_symbols) == (6, 3)
    assert by_id[None][0].kept and len(by_id[0]) == 2
    cut = {r.doc_id: r.text for r in without_lines(docs, assess(docs, max_documents=10)).collect()}
    assert 105 not in cut and None in cut and cut[300] == body(9)
    assert assess(docs.limit(0)).count() == 0


def slow_verdicts(rows):
    """kept by row number: lines in more than three rows of the host go, rows left with under 30 % of their words are rejected."""
    norm = lambda line: " ".join("".join("0" if c in "0123456789" else c.lower() if c.isascii() else c for c in line).split())
    lines = [[(norm(x), len(x.split())) for x in re.split("\n", text or "") if x.split()] for _, text, _ in rows]
    held = Counter((host, k) for (_, _, host), own in zip(rows, lines, strict=True) for k in {k for k, _ in own})
    out = []
    for (_, text, host), own in zip(rows, lines, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        failed = len(words) < 50 or 100 * slow_repeat_words(words) > 50 * len(words)
        gone = sum(n for k, n in own if held[host, k] > 3)
        out.append((failed, gone, not failed and len(words) - gone >= 0.3 * len(words)))
    return out


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="needs the test tables")
def test_rejected_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in docs.collect()]
    want = {d: v for (d, _, _), v in zip(rows, slow_verdicts(rows), strict=True)}
    got = {r.doc_id: (r.base_failed, r.n_removed_words, r.kept) for r in assess(docs).collect()}
    assert got == want
    assert any(not failed and not kept for failed, _, kept in got.values())
