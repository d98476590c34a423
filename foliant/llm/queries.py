"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import token_frames
from foliant.llm.collocations import collocations
from foliant.llm.decontaminate import contaminated
from foliant.llm.gru_lm import score_documents
from foliant.llm.hard_negatives import mine_hard_negatives, valid_points
from foliant.llm.hyperminhash import near_duplicates
from foliant.llm.line_rules import assess as assess_lines
from foliant.llm.mixing import mix_sources, word_count
from foliant.llm.piece_lattice import encode as encode_pieces
from foliant.llm.preference import format_preferences, mismatched_reply_pairs
from foliant.llm.scratch import Scratch, read
from foliant.llm.sharding import uniform_shards
from foliant.llm.suffix_dedup import remove_repeats
from foliant.llm.toxic_segments import score as score_toxicity
from foliant.llm.toxic_segments import train as train_toxicity


def op1_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = format_preferences(mismatched_reply_pairs(read(spark, sf_dir, "conversations")))
    trained = lambda c: F.aggregate(F.col(f"{c}.spans"), F.lit(0), lambda n, s: n + F.when(s["train"], s["end"] - s["start"]).otherwise(0)).cast("long")
    return pairs.select(
        "pair_id", "n_prompt_turns", "prompt",
        F.col("chosen.text").alias("chosen_text"), trained("chosen").alias("chosen_trained"),
        F.col("rejected.text").alias("rejected_text"), trained("rejected").alias("rejected_trained"), "differs",
    )


def op2_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = uniform_shards(docs, 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _held_out(spark: SparkSession, docs: DataFrame, modulus: int) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 2, F.lit(False)))


def op8_gated_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _held_out(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), 7)
    scored, lexicon = score_documents(docs.select("doc_id", "text"), docs.where("NOT held_out"))
    return _held_out(spark, scored, 7).withColumn("train_tokens", F.lit(lexicon.tokens).cast("long"))


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _held_out(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), 4)
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where("crc32(cast(cast(doc_id AS string) AS binary)) % 4 != 2")
    model = train_toxicity(docs.where("NOT held_out"), labels)
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", "held_out", F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"), F.size("_segments").alias("n_segments"))


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess_lines(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text_hash", "removed_lines")


def op7_seekable_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    folder = f"{scratch.path}/frames"
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    files = scratch.save(token_frames.write(docs, folder, public_tokenizers.path("word_bpe_49k.json")), "files")
    found = token_frames.read_documents(token_frames.file_starts(files), folder)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_rare_seed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("key")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


def piece_digest(docs: DataFrame) -> DataFrame:
    """doc_id, the pieces of its text, their checksum and whether decoding gives the text back."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = encode_pieces(docs.select("doc_id", "text"), model, decoded=True)
    exact = F.crc32(F.col("decoded").cast("binary")) == F.col("text_crc32")
    return found.select("doc_id", "n_pieces", "ids_crc32", exact.alias("decoded_exactly"))


def op10_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(read(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def op12_packed_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = valid_points(read(spark, sf_dir, "embeddings"), "embedding", "label", "vec_id")
    points = points.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_hard_negatives(points, F.col("id") % 50 == 0)


def op13_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    out = mix_sources(docs, F.col("size"), F.col("source"))
    return out.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"))


QUERIES = {
    "op1_preference_formatting": op1_preference_formatting,
    "op2_hypergeometric_shards": op2_hypergeometric_shards,
    "op3_line_frequency": op3_line_frequency,
    "op4_rare_seed_alignment": op4_rare_seed_alignment,
    "op5_hyperminhash": op5_hyperminhash,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_seekable_frames": op7_seekable_frames,
    "op8_gated_recurrent_lm": op8_gated_recurrent_lm,
    "op9_toxic_segments": op9_toxic_segments,
    "op10_piece_lattice": op10_piece_lattice,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_packed_tree_negatives": op12_packed_tree_negatives,
    "op13_systematic_mix": op13_systematic_mix,
}

ORACLE = {
    "op5_hyperminhash": r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT r, g FROM (
  SELECT r, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
                        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.r != b.r GROUP BY a.r, b.r),
links AS (SELECT x, y FROM common JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
reach AS (SELECT r, r AS root FROM w UNION SELECT links.y, reach.root FROM reach JOIN links ON links.x = reach.r),
comp AS (SELECT reach.r, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.root GROUP BY reach.r)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN comp USING (r) LEFT JOIN n USING (r)""",
    "op6_suffix_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS o, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
wn AS (SELECT r, o, i, substr(h, 2 * i + 1, 100) AS k FROM (SELECT r, o, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)),
hit AS (SELECT r, i FROM (SELECT r, o, i, min(o) OVER (PARTITION BY k) AS least FROM wn) WHERE o > least),
gap AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS step FROM hit),
run AS (SELECT r, i, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS g FROM gap),
span AS (SELECT r, g, min(i) AS lo, max(i) + 50 AS hi FROM run GROUP BY r, g),
edge AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS before FROM span),
kept AS (SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS k
         FROM edge JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
    "op3_line_frequency": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, chr(1)) AS host FROM documents),
w AS (SELECT r, doc_id, text, host, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1),
repn AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
ln AS (SELECT r, host, i, line FROM (SELECT r, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM w)
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY r),
nl AS (SELECT r, host, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
       array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'), '[^\x20\x09-\x0D]+'), ' ') AS k FROM ln),
freq AS (SELECT host, k FROM nl GROUP BY host, k HAVING count(DISTINCT r) > 3),
gone AS (SELECT r, sum(n) AS n FROM nl JOIN freq USING (host, k) GROUP BY r),
o AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repn.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN repn USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.3 * n_words AS kept FROM o""",
    "op1_preference_formatting": """
WITH conv AS (
  SELECT conv_id, list({'turn': turn, 'role': coalesce(role, 'user'), 'text': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
cut AS (
  SELECT conv_id, t, list_max(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i].role = 'assistant' THEN i END)) AS k FROM conv),
ended AS (SELECT conv_id, t[1:k] AS chosen, t[k] AS reply, t[1:k-1] AS head FROM cut WHERE k IS NOT NULL),
pairs AS (
  SELECT a.conv_id, a.chosen, CASE WHEN b.conv_id IS NULL THEN a.head ELSE list_append(a.head, b.reply) END AS rejected,
         CASE WHEN b.conv_id IS NOT NULL AND a.reply.role = b.reply.role AND a.reply.text = b.reply.text THEN len(a.chosen) ELSE len(a.head) END AS n
  FROM ended a LEFT JOIN ended b ON b.conv_id = xor(a.conv_id, 1))
SELECT conv_id AS pair_id, CAST(n AS INTEGER) AS n_prompt_turns,
  coalesce(array_to_string(list_transform(chosen[1:n], lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(chosen[n+1:], lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), ''), '') AS chosen_text,
  CAST(coalesce(list_sum(list_transform(chosen[n+1:], lambda x: CASE WHEN x.role = 'assistant' THEN length(x.text) + 8 ELSE 0 END)), 0) AS BIGINT) AS chosen_trained,
  coalesce(array_to_string(list_transform(rejected[n+1:], lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), ''), '') AS rejected_text,
  CAST(coalesce(list_sum(list_transform(rejected[n+1:], lambda x: CASE WHEN x.role = 'assistant' THEN length(x.text) + 8 ELSE 0 END)), 0) AS BIGINT) AS rejected_trained,
  (len(chosen) > n OR len(rejected) > n) AS differs
FROM pairs""",
    "op11_phrase_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
g AS (SELECT lang, k, array_to_string(w[i:i+k-1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k))),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang),
s AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM c WHERE k > 1 AND f >= 10),
u AS (SELECT lang, phrase, a, x AS cut, array_to_string(w[1:x], ' ') AS head, array_to_string(w[x+1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS x FROM s)),
v AS (SELECT u.*, l.f AS l, r.f AS r, (1000000::HUGEINT * u.a * u.a) // (l.f::HUGEINT * r.f) AS score
      FROM u JOIN c l ON l.lang = u.lang AND l.phrase = u.head JOIN c r ON r.lang = u.lang AND r.phrase = u.tail),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM v) WHERE o = 1),
i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, array_to_string(w[j:j+1], ' ') AS phrase, a FROM (SELECT *, unnest([1, 2]) AS j FROM s WHERE k = 3)) GROUP BY ALL),
m AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM m JOIN t USING (lang) WHERE rank <= 2000""",
    "op12_packed_tree_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, a.label AS al, b.vec_id AS id, b.label, b.r AS br, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r != b.r),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) AS j FROM s WHERE label = al) WHERE j <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.ar, p.j ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON s.ar = p.ar AND s.label != s.al AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op13_systematic_mix": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS tie FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY source),
w AS (SELECT source, ss, 2 * ss AS cap, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS wt FROM s),
o AS (SELECT *, (sum(ss) OVER () * 150 / 100.0 - coalesce(sum(cap) OVER (ORDER BY cap / wt, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(wt) OVER (ORDER BY cap / wt, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
l AS (SELECT CAST(coalesce(min_by(lv, cap / wt) FILTER (WHERE cap > lv * wt), 0) AS DOUBLE) AS lv FROM o),
t AS (SELECT source, ss, least(CAST(cap AS DOUBLE), l.lv * wt) AS target FROM w, l),
r AS (SELECT *, CAST(CASE WHEN ss > 0 THEN least(floor(target / ss * 268435456), 536870912) ELSE 0 END AS BIGINT) AS rate,
        CAST('0x' || substr(md5('mix:' || coalesce('s' || source, 'n')), 1, 7) AS BIGINT) AS off FROM t),
p AS (SELECT d.*, r.ss, r.target, r.rate, r.off, size > 0 AND size * 256 >= ss AS is_long, row_number() OVER (PARTITION BY d.source ORDER BY size DESC, tie) - 1 AS nth
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
h AS (SELECT source, count(*) AS heads, sum(size) AS lng, sum(size * (((nth + 1) * rate + off) // 268435456 - (nth * rate + off) // 268435456)) AS taken FROM p WHERE is_long GROUP BY source),
q AS (SELECT p.*, coalesce(heads, 0) AS heads,
        CAST(CASE WHEN ss > coalesce(lng, 0) THEN least(greatest(floor((target - coalesce(taken, 0)) / (ss - coalesce(lng, 0)) * 268435456), 0), 536870912) ELSE rate END AS BIGINT) AS rest
      FROM p LEFT JOIN h ON p.source IS NOT DISTINCT FROM h.source),
c AS (SELECT *, least(nth, heads) * rate + greatest(nth - heads, 0) * rest AS a, CASE WHEN nth < heads THEN rate ELSE rest END AS e FROM q),
n AS (SELECT *, CAST((a + e + off) // 268435456 - (a + off) // 268435456 AS BIGINT) AS copies FROM c)
SELECT doc_id, size, ss AS source_size, target, size * copies AS taken, copies FROM n""",
}
