"""Values as people read them, and guards of values that people type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_int(c: Column) -> Column:
    """A whole number, or null."""
    return F.trim(c.cast("string")).try_cast("bigint")


def as_float(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def as_doc_id(c: Column) -> Column:
    """A positive whole number, or null."""
    n = as_int(c)
    return F.when(n > 0, n)


def note_id_of(path: Column) -> Column:
    """The note id in the query of a call's path, or null."""
    return as_int(F.regexp_extract(path, r"[?&]id=([^&#]*)", 1))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def missing_badges(embeddings: Column, vision: Column, baseline: Column, suggestions: Column, cached: Column) -> Column:
    """What a document still lacks, in the order in which it is made; vision suggestions need vision pages."""
    rules = (("Embeddings", ~embeddings), ("Vision OCR", ~vision), ("Suggestions (text)", ~baseline), ("Suggestions (vision)", vision & ~suggestions), ("Local cache", ~cached))
    return F.filter(F.array(*[F.when(hit, F.lit(label)) for label, hit in rules]), lambda b: b.isNotNull())


def relative_age(seconds: Column) -> Column:
    s = F.floor(F.greatest(F.lit(0), seconds)).cast("long")
    ago = lambda unit, n: F.concat(F.floor(s / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 10, "just now").when(s < 60, ago("s", 1)).when(s < 3600, ago("m", 60)).when(s < 86_400, ago("h", 3600)).otherwise(ago("d", 86_400))


def _two(a: Column, x: str, b: Column, y: str) -> Column:
    return F.concat(a.cast("string"), F.lit(f"{x} "), b.cast("string"), F.lit(y))


def runtime(seconds: Column) -> Column:
    """Seconds below a minute, minutes and seconds below an hour, else hours and minutes."""
    s = F.floor(F.greatest(F.lit(0), seconds)).cast("long")
    minutes = F.floor(s / 60).cast("long")
    return F.when(minutes <= 0, F.concat(s.cast("string"), F.lit("s"))).when(minutes < 60, _two(minutes, "m", s % 60, "s")).otherwise(_two(F.floor(minutes / 60).cast("long"), "h", minutes % 60, "m"))


def due_in(seconds: Column) -> Column:
    s = F.floor(F.greatest(F.lit(0), seconds)).cast("long")
    return F.when(seconds.isNull(), "-").when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(_two(F.floor(s / 60).cast("long"), "m", s % 60, "s"))


def compact(message: Column, size: int = 100) -> Column:
    """One line of at most `size` characters; nothing is '-'."""
    text = F.trim(F.regexp_replace(message, r"\s+", " "))
    return F.when(F.coalesce(message, F.lit("")) == "", "-").when(F.length(text) > size, F.concat(F.left(text, F.lit(size - 3)), F.lit("..."))).otherwise(text)


def short_id(c: Column) -> Column:
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.length(text) <= 14, text).otherwise(F.concat(F.left(text, F.lit(8)), F.lit("..."), F.right(text, F.lit(4))))


def score_text(c: Column) -> Column:
    return F.when(c.isNull(), "n/a").otherwise(F.format_string("%.3f", c))


def link_citations(text: Column, links: Column) -> Column:
    """`text` with [n] turned into a link for every n of `links`, a map from number to address."""
    mark = lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))
    return F.aggregate(F.map_entries(links), text, lambda t, e: F.replace(t, mark(e["key"]), F.concat(F.lit('<sup><a href="'), e["value"], F.lit('">'), mark(e["key"]), F.lit("</a></sup>"))))


def next_order(current: str, descending: bool, clicked: str) -> tuple[str, bool]:
    """The order after a click on a column: the same column turns it, another one starts ascending."""
    return (clicked, not descending) if clicked == current else (clicked, False)


def page_bounds(total: int, page: int, size: int) -> tuple[int, int, int]:
    """(page, first row, last row) of a list, with the page brought into range; rows count from 1, 0 for none."""
    size = max(1, size)
    page = max(1, min(page, max(1, -(-total // size))))
    return page, (page - 1) * size + 1 if total else 0, min(total, page * size)
