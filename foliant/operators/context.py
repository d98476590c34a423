"""What a model is given to read: texts joined under a budget, notes, summaries and the order of preference among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.model_text import DATE, NUMBER, summary_list, summary_value
from foliant.operators.textops import _strip, truncate_chars

NOTE_LISTS = ("facts", "entities", "references", "key_numbers", "uncertainties")
#: Lists of a document summary with their labels, in the order in which they are told.
LABELS = (("key_facts", "Key facts"), ("key_dates", "Key dates"), ("key_entities", "Key entities"), ("key_numbers", "Key numbers"), ("open_questions", "Open questions"), ("confidence_notes", "Confidence notes"))
#: Marks of a summary that was never made.
FAILED = ("global_summary_error", "fallback_due_to_json_parse_error")
DEFAULT_CHARS = 12_000


def truncate_tokens(text: Column, max_tokens: int) -> Column:
    """A text cut at 3.5 characters a token; no budget leaves it whole."""
    return truncate_chars(text, int(max_tokens * 3.5)) if max_tokens > 0 else text


def join_limited(parts: Column, max_chars: int) -> Column:
    """Texts joined by blank lines up to max_chars; the last one may be cut.  No budget joins them all."""
    if max_chars <= 0:
        return _strip(F.array_join(parts, "\n\n"))
    texts = F.filter(F.transform(parts, _strip), lambda t: t != "")
    zero = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

    def add(s: Column, text: Column) -> Column:
        gap = F.when(s["out"] == "", "").otherwise("\n\n")
        room = max_chars - F.length(s["out"]) - F.length(gap)
        grown = F.struct(F.concat(s["out"], gap, F.left(text, room)).alias("out"), (F.length(text) > room).alias("full"))
        return F.when(s["full"] | (room <= 0), F.struct(s["out"].alias("out"), F.lit(True).alias("full"))).otherwise(grown)

    return _strip(F.aggregate(texts, zero, add)["out"])


def _items(values: Column, limit: int) -> Column:
    """The first items that are not blank, joined by semicolons; null for none."""
    kept = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), _strip), lambda v: v != "")
    return F.when(F.size(kept) > 0, F.array_join(F.slice(kept, 1, limit), "; "))


def note_text(raw: Column) -> Column:
    """The text of a page note: its own text, else its lists, else the note as it is."""
    raw = _strip(F.coalesce(raw, F.lit("")))
    note = F.when(raw.startswith("{"), F.from_json(raw, "text string, " + ", ".join(f"{k} array<string>" for k in NOTE_LISTS)))
    lists = F.filter(F.array(*[F.concat(F.lit(f"{k}: "), _items(note[k], 12)) for k in NOTE_LISTS]), lambda x: x.isNotNull())
    return F.coalesce(F.nullif(_strip(F.coalesce(note["text"], F.lit(""))), F.lit("")), F.nullif(F.array_join(lists, "\n"), F.lit("")), raw)


def notes_context(notes: DataFrame, source: str, max_chars: int = DEFAULT_CHARS) -> DataFrame:
    """(doc_id, context): the good page notes of a source in page order, each behind its page number."""
    rows = notes.where((F.col("source") == source) & (F.col("status") == "ok")).select("doc_id", "page", note_text(F.col("notes_text")).alias("t")).where("t != ''")
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: F.concat(F.lit("Page "), x["page"].cast("string"), F.lit(": "), x["t"]))
    return rows.groupBy("doc_id").agg(blocks.alias("b")).select("doc_id", join_limited(F.col("b"), max_chars if max_chars > 0 else DEFAULT_CHARS).alias("context"))


def summary_context(payload: Column, source: str, max_chars: int = DEFAULT_CHARS) -> Column:
    """A document summary as text, '' if it is for another source or was never made."""
    s = F.from_json(payload, "summary string, executive_summary string, source string, " + ", ".join(f"{k} array<string>" for k, _ in LABELS))
    plain = lambda c: _strip(F.coalesce(c, F.lit("")))
    one = lambda label, c: F.when(plain(c) != "", F.concat(F.lit(f"{label}: "), plain(c)))
    some = lambda k: F.size(F.coalesce(s[k], F.array().cast("array<string>"))) > 0
    signal = (plain(s["summary"]) != "") | (plain(s["executive_summary"]) != "") | some("key_facts") | some("key_entities") | some("key_numbers") | some("key_dates")
    told = F.lower(F.coalesce(_items(s["confidence_notes"], 1 << 20), F.lit("")))
    failed = ~signal & (told.contains(FAILED[0]) | told.contains(FAILED[1]))
    foreign = (plain(s["source"]) != "") & (plain(s["source"]) != source)
    blocks = F.array(one("Executive summary", s["executive_summary"]), one("Summary", s["summary"]), *[F.concat(F.lit(f"{label}: "), _items(s[k], 20)) for k, label in LABELS])
    return F.when(s.isNull() | failed | foreign, "").otherwise(join_limited(F.filter(blocks, lambda b: b.isNotNull()), max_chars if max_chars > 0 else DEFAULT_CHARS))


def choose(*texts: Column) -> Column:
    """The first text that is not blank: summary, then page notes, then the text itself."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def _distinct(values: Column, limit: int) -> Column:
    return F.slice(F.array_distinct(F.filter(values, lambda v: v != "")), 1, limit)


def _tokens(values: Column, pattern: str) -> Column:
    return F.flatten(F.transform(values, lambda v: F.regexp_extract_all(v, F.lit(pattern), F.lit(0))))


def section_summary(key: Column, facts: Column, entities: Column, numbers: Column, reason: str) -> Column:
    """A section summary made of its page notes alone, for when a model gave none."""
    facts, entities, given = (summary_list(v, 1 << 20, n) for v, n in ((facts, 320), (entities, 180), (numbers, 120)))
    top = _distinct(facts, 8)
    text = F.nullif(F.array_join(F.slice(top, 1, 4), " "), F.lit(""))
    plain = F.coalesce(text, F.concat(F.lit("Section "), key, F.lit(" was put together from its notes, as the model's answer could not be read.")))
    return F.struct(
        key.alias("section"), summary_value(plain, 700).alias("summary"), top.alias("key_facts"), _distinct(_tokens(facts, DATE), 8).alias("key_dates"), _distinct(entities, 8).alias("key_entities"),
        _distinct(F.concat(_tokens(facts, NUMBER), given), 10).alias("key_numbers"), F.array(F.lit(reason)).alias("confidence_notes"),
    )


def document_summary(sections: DataFrame, reason: str) -> DataFrame:
    """(doc_id, summary struct) from section summaries (doc_id, at, s), in the order of `at`."""
    all_ = F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"])
    rows = sections.groupBy("doc_id").agg(all_.alias("all"))
    texts = F.filter(F.transform("all", lambda s: _strip(F.coalesce(s["summary"], F.lit("")))), lambda t: t != "")
    merged = lambda k: F.filter(F.flatten(F.transform("all", lambda s: F.coalesce(s[k], F.array().cast("array<string>")))), lambda v: v != "")
    executive = F.coalesce(F.get(F.col("texts"), F.lit(0)), F.lit(""))
    short = F.when(F.length(executive) > 320, F.concat(F.rtrim(F.left(executive, F.lit(317))), F.lit("..."))).otherwise(executive)
    doubts = F.array_distinct(F.concat(F.array(F.lit(reason)), F.slice(_distinct(merged("confidence_notes"), 8), 1, 3)))
    rows = rows.withColumn("texts", texts)
    return rows.select(
        "doc_id",
        F.struct(
            F.array_join(F.slice("texts", 1, 3), " ").alias("summary"), short.alias("executive_summary"), _distinct(merged("key_facts"), 20).alias("key_facts"), _distinct(F.concat(_tokens(F.col("texts"), DATE), merged("key_dates")), 20).alias("key_dates"),
            _distinct(merged("key_entities"), 20).alias("key_entities"), _distinct(F.concat(_tokens(F.col("texts"), NUMBER), merged("key_numbers")), 24).alias("key_numbers"), doubts.alias("confidence_notes"),
        ).alias("summary"),
    )
