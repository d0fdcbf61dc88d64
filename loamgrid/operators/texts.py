"""Search and tidying of question-and-answer texts and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalise(c: Column) -> Column:
    """Lower case, anything but letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def count_of(c: Column, word: str) -> Column:
    """How often a word occurs (not overlapping)."""
    return F.coalesce(((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("int"), F.lit(0))


def search(df: DataFrame, query: str, head: str, body: str, key: str, limit: int = 200) -> DataFrame:
    """Rows with all words; score 3 for each occurrence in the head, 1 in the body; best first, then input order (key)."""
    words = [w for w in "".join(ch if ch.isalnum() else " " for ch in query.lower()).split() if w]
    h, b = normalise(F.col(head)), normalise(F.col(body))
    rows = df.withColumns({"__h": F.coalesce(h, F.lit("")), "__b": F.coalesce(b, F.lit(""))})
    if words:
        rows = rows.where(reduce(lambda p, q: p & q, (F.contains(F.col("__h"), F.lit(w)) | F.contains(F.col("__b"), F.lit(w)) for w in words)))
    score = sum((3 * count_of(F.col("__h"), w) + count_of(F.col("__b"), w) for w in words), F.lit(0))
    return rows.withColumn("score", score.cast("int")).drop("__h", "__b").orderBy(F.desc("score"), key).limit(limit)


def shared_words(df: DataFrame, text: str, query: str, key: str, limit: int = 2) -> DataFrame:
    """Rows by the number of words they share with a request."""
    words = F.array_distinct(F.split(normalise(F.col(text)), " "))
    asked = F.split(normalise(F.lit(query)), " ")
    return df.withColumn("shared", F.size(F.array_intersect(words, asked))).where("shared > 0").orderBy(F.desc("shared"), key).limit(limit)


def first_of_each(df: DataFrame, by: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """The first row (in order) of each normalised key: duplicate questions, repeated deliveries."""
    keys = {f"__k{i}": c for i, c in enumerate(by)}
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns(keys).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", *keys)


def section_of(category: Column, sections: Mapping[str, Sequence[str]], default: str) -> Column:
    """The first section one of whose keywords occurs in the category."""
    low, out = F.lower(category), None
    for name, words in sections.items():
        hit = reduce(lambda p, q: p | q, (F.contains(low, F.lit(w)) for w in words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default) if out is not None else F.lit(default)


def label_text(label: Column, prefix: str = "") -> Column:
    """A label for people: prefix off, underscores as spaces, first letter a capital."""
    c = F.trim(F.regexp_replace(F.regexp_replace(label, "^" + prefix, "") if prefix else label, r"[_\s]+", " "))
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def match_name(c: Column, names: Sequence[str], aliases: Mapping[str, str]) -> Column:
    """The known name that a text means: by alias, equal, or contained one way or the other; null if none."""
    key = normalise(c)
    table = {**{k.lower(): v for k, v in aliases.items()}, **{n.lower(): n for n in names}}
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when((F.contains(key, F.lit(n.lower())) | (F.contains(F.lit(n.lower()), key) & (key != ""))), n).otherwise(out)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def safe_stem(c: Column) -> Column:
    """A file name: other characters as _, trimmed, at most 60."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", ""), 1, 60)


def log_search(df: DataFrame, query: str, status: str = "", limit: int = 200) -> DataFrame:
    """Runs whose JSON text holds every word; latest first."""
    text = F.lower(F.to_json(F.struct(*df.columns)))
    rows = df.where(F.col("status") == status) if status else df
    for w in query.lower().split():
        rows = rows.where(F.contains(text, F.lit(w)))
    return rows.orderBy(F.desc("finished"), "id").limit(limit)


def dms_degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds with N/S/E/W as decimal degrees (7 places)."""
    v = d + m / 60 + s / 3600
    return F.round(F.when(F.upper(ref).isin("S", "W"), -v).otherwise(v), 7)
