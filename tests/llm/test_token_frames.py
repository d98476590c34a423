import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from tokenizers import Tokenizer

from foliant.llm.token_frames import FrameReader, FrameWriter, WordCache, file_starts, read_documents, write

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_files_hold_the_library_ids(spark, tmp_path):
    texts = ["Hello  world, it's 2024!", None, "", "naïve é  x\u0085y \x1cz", "a<|endoftext|>b <|startoftext|> c", "ΑΣ ΑΣΑ İ", "word " * 3000, "x\0y", "same", "same"]
    docs = spark.createDataFrame([(40 - i, t, "k") for i, t in enumerate(texts)] + [(31, "same", "k"), (None, "nobody", "k")], "doc_id long, text string, file string")
    folder = f"file://{tmp_path}/frames"
    files = write(docs, folder, PATH, partitions=3).cache()
    out = read_documents(file_starts(files), folder).orderBy("start").collect()
    library = Tokenizer.from_file(PATH)
    assert [r.doc_id for r in out] == [None, 31, 31, *range(32, 41)]
    at = 0
    by_id = dict(docs.select("doc_id", "text").collect())
    for r in out:
        ids = library.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert write(docs.limit(0), folder + "0", PATH, partitions=2).count() == 0


def test_reader_takes_one_frame_and_checks_it(tmp_path):
    writer = FrameWriter(2)
    rng = np.random.default_rng(0)
    ids = {d: rng.integers(0, 49408, 60_000).astype(np.uint32) for d in (5, 9, 12, None)}
    for d, own in ids.items():
        writer.add(d, own)
    content = bytearray(writer.finish())
    (tmp_path / "a").write_bytes(content)
    source = pafs.LocalFileSystem().open_input_file(str(tmp_path / "a"))
    reader = FrameReader(source, source.size())
    assert len(reader.table) == 2 and (reader.document(12) == ids[12]).all()
    content[int(reader.offsets[1]) - 30] ^= 1
    (tmp_path / "b").write_bytes(content)
    damaged = FrameReader(pafs.LocalFileSystem().open_input_file(str(tmp_path / "b")), len(content))
    assert (damaged.frame(1) == ids[None]).all()
    with pytest.raises(Exception):
        damaged.document(5)


def test_word_cache_equals_the_library():
    texts = ["Wörter, groß. Straße! ×. ÷, x÷. …. a.b. 3.5, 1,000. don't. it's, O'Neil: we'll? |a| b|", "é́. ﬁn, ǅ. ½. ²; Ⅻ! ªº. ʰ. ก็. 한. 한.", "... .,;: !? a.. b!? c?.", "<|endoftext|>. <|ENDOFTEXT|>, x<|startoftext|>!", "ΣΑΣ. İI, ẞ!"]
    library = Tokenizer.from_file(PATH)
    for limit in (400_000, 6):
        cache = WordCache(PATH, limit)
        for text in texts * 2:
            ids, sizes = cache.encode([text.encode(), None])
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids + [1, 1] and sizes.tolist() == [len(ids) - 1, 1]
