import random

import numpy as np
import public_tokenizers
import sentencepiece

from foliant.llm.piece_lattice import encode, load, merge_run, units_of, with_decoded

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def brute_force(text):
    """Merge the best-ranked neighbours of the whole text, without units, lattice or queue."""
    known, byte = load(MODEL).known, load(MODEL).byte_ids
    parts = list(text)
    while True:
        able = [(known[a + b][0], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in known]
        if not able:
            return [i for p in parts for i in ([known[p][1]] if p in known else [byte[x] for x in p.encode()])]
        _, k = min(able)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_against_brute_force_library_and_round_trip(spark):
    rng = random.Random(4)
    texts = ["Hello  world\n a\tb", None, "", " ", "naïve café ▁x 日本語 😀 don't ².", "x" * 600 + "    " * 40 + "\n\n\ny", "日本語の文字" * 40, "=" * 90 + "ab" * 70, "\x00😀" * 50, " " * 31]
    texts += ["The quick brown fox, jumping!" * 3] * 3 + ["".join(rng.choice(" ab=e-日tione \n😀é") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    docs = spark.createDataFrame([(i if i else None, t, i, "p") for i, t in enumerate(texts)], "doc_id long, text string, ids long, part string")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for head in (1 << 17, 2, 0):
        out = {r.doc_id or 0: r for r in with_decoded(encode(docs, MODEL, head=head), MODEL).collect()}
        assert len(out) == len(texts)
        at_once = {r.doc_id or 0: r for r in encode(docs, MODEL, head=head, decoded=True).collect()}
        assert {i: (r.ids, r.decoded, r.n_pieces, r.ids_crc32) for i, r in at_once.items()} == {i: (r.ids, r.decoded, r.n_pieces, r.ids_crc32) for i, r in out.items()}
        for i, text in enumerate(texts):
            ids = np.frombuffer(out[i].ids, "<u2").tolist()
            assert out[i].decoded == (text or "") and out[i].n_pieces == len(ids)
            assert ids == brute_force(" " + (text or "")), text
            if text and "▁" not in text and text.strip(" "):
                assert ids == library.encode(text)
    assert with_decoded(encode(docs.limit(0), MODEL), MODEL).count() == 0


def test_units_as_long_as_a_path_has_bits(spark):
    rng = random.Random(5)
    # The space in front belongs to the unit: 61 characters behind it make one of 62, whose path takes all 63 bits.
    texts = [s for n in range(59, 65) for s in ("x" * n, "=" * n, " " * n, "ation" * 12 + "s" * (n - 60), "".join(rng.choice("estain") for _ in range(n)))]
    model, library = load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    lengths = {len(units[k]) for units in (units_of([t], model) for t in texts) for k in range(len(units.start))}
    assert {61, 62, 63} <= lengths
    out = {r.doc_id: r for r in encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), MODEL, decoded=True).collect()}
    assert len(out) == len(texts)
    for i, text in enumerate(texts):
        ids = np.frombuffer(out[i].ids, "<u2").tolist()
        assert out[i].decoded == text and ids == brute_force(" " + text), text
        if text.strip(" "):
            assert ids == library.encode(text)


def test_units_cover_the_text_and_long_runs_merge_as_the_library_does():
    model, library = load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ("a" * 100_000, "abc" * 9_000 + " " + "日本" * 9_000, "x" * 63 + " " * 200 + "end"):
        units = units_of([text], model)
        own = [units[k] for k in range(len(units.start))]
        assert "".join(own) == " " + text
        assert [i for u in own for i in merge_run(u, model)] == library.encode(text)


def test_ids_are_the_models_own(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in encode(docs, MODEL).collect()}
    assert got == {i: library.encode(t) if t else [28705] for i, t in texts.items()}
