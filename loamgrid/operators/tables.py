"""Browsing, filtering, profiling and editing tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.expressions import cast_column, finite, kind_of, number_text
from loamgrid.operators.quantiles import exact_quantiles

_FILTER = re.compile(r"^\s*(.+?)\s*(==|!=|>=|<=|=|>|<)\s*(.*?)\s*$")


def _kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def _q(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def cell_text(df: DataFrame, name: str) -> Column:
    """A cell as a user sees it: whole doubles without a fraction."""
    c = _q(name)
    return number_text(c.cast("double")) if _kinds(df)[name] == "number" else c.cast("string")


def filter_condition(df: DataFrame, query: str) -> Column | None:
    """The condition of a ``column op value`` text; None where it names no column."""
    m, kinds = _FILTER.match(query), _kinds(df)
    name = m and next((c for c in df.columns if c == m[1].strip("[]\"'`")), None)
    if not name:
        return None
    op, value = m[2], m[3]
    if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
        value = value[1:-1]
    if kinds[name] in ("integer", "number"):
        left, right = _q(name), F.lit(float(value))
    else:
        left, right = (_q(name) if kinds[name] == "text" else _q(name).cast("string")), F.lit(value)
    return {"=": left == right, "==": left == right, "!=": left != right, ">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[op]


def filter_rows(df: DataFrame, query: str) -> DataFrame:
    """``column op value`` picks rows; any other text is looked for in all columns.

    Numbers are compared as numbers (a value that isn't one is an error), everything else as text, in character order. Quotes around
    the value come off. Null never matches. Simple comparisons reach the Parquet scan as pushed filters.
    """
    if not query or not query.strip():
        return df
    condition = filter_condition(df, query)
    return search_rows(df, query) if condition is None else df.where(condition)


def search_rows(df: DataFrame, text: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with the text in any column, without case."""
    needle = text.strip().lower()
    hits = [F.coalesce(F.contains(F.lower(cell_text(df, c)), F.lit(needle)), F.lit(False)) for c in columns or df.columns]
    return df.where(reduce(lambda a, b: a | b, hits))


def sort_rows(df: DataFrame, column: str, descending: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """Sorted by one column, null and NaN last in both directions; ``ties`` settles equal values."""
    c = finite(_q(column).cast("double")) if _kinds(df)[column] == "number" else _q(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *ties)


def page(df: DataFrame, offset: int = 0, limit: int = 100, query: str = "", sort: str | None = None, descending: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """A page of the filtered and sorted table (at most 1000 rows): Spark keeps only offset + limit rows a task."""
    rows = filter_rows(df, query)
    rows = sort_rows(rows, sort, descending, ties) if sort else rows.orderBy(*ties) if ties else rows
    return rows.offset(offset).limit(min(limit, 1000))


def profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """One row a column: kind, rows, missing, distinct, and for numbers min, max, mean, population std and quartiles.

    Missing is null or not finite. Plain aggregates come from one pass, quartiles from ``exact_quantiles`` (run before the result is built), distinct counts
    from value counts combined map-side; ``approximate`` takes sketches in the first pass instead of both.
    """
    kinds = _kinds(df)
    columns = list(columns or df.columns)
    thirds = (0.25, 0.5, 0.75)
    numbers = [c for c in columns if kinds[c] in ("integer", "number")]
    exact = {} if approximate or not numbers else exact_quantiles(df, {c: _q(c) for c in numbers}, thirds)
    parts = []
    for c in columns:
        number = c in numbers
        x = finite(_q(c).cast("double")) if number else _q(c)
        none = F.lit(None).cast("double")
        stats = [f(x).cast("double") if number else none for f in (F.min, F.max, F.avg, F.stddev_pop)]
        distinct = F.approx_count_distinct(_q(c)) if approximate else F.lit(None).cast("long")
        q = F.percentile_approx(x, list(thirds)) if number and approximate else F.array(*(F.lit(v).cast("double") for v in exact.get(c, (None,) * 3)))
        parts.append(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("kind"), F.count("*").alias("n"), (F.count("*") - F.count(x)).alias("missing"), *(v.alias(n) for n, v in zip(("min", "max", "mean", "std"), stats, strict=True)), distinct.alias("d"), q.alias("q")))
    out = df.agg(F.array(*parts).alias("all")).select(F.explode("all").alias("r")).select("r.*")
    if not approximate:
        by = None
        for kind, names in (("double", numbers), ("string", [c for c in columns if c not in numbers])):
            if not names:
                continue
            each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), _q(c).cast(kind).alias("value")) for c in names)))
            values = df.select(each.alias("e")).where("e.value is not null").groupBy("e.column", "e.value").agg(F.lit(1).alias("one"))
            part = values.groupBy(F.col("column").alias("__c")).agg(F.count("*").alias("__d"))
            by = part if by is None else by.unionByName(part)
        out = out.join(F.broadcast(by), F.col("column") == F.col("__c"), "left").withColumn("d", F.coalesce("__d", F.lit(0)))  # one row a column
    return out.select("column", "kind", "n", "missing", F.col("d").alias("distinct_values"), "min", "max", "mean", "std", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """``bin, lo, hi, n`` over [min, max], the last bin closed; a constant column spans half a unit to both sides; empty bins have 0."""
    x = df.select(finite(_q(column).cast("double")).alias("x")).where("x is not null")
    ends = x.agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a is not null")
    ends = ends.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    # One row of bounds: a broadcast of proven size.
    put = x.join(F.broadcast(ends)).select(F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("a")) / (F.col("b") - F.col("a")) * bins)).cast("int").alias("bin"))
    counts = put.groupBy("bin").agg(F.count("*").alias("n"))
    grid = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("b") - F.col("a")) / bins
    return grid.join(counts, "bin", "left").select("bin", (F.col("a") + width * F.col("bin")).alias("lo"), (F.col("a") + width * (F.col("bin") + 1)).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def top_values(df: DataFrame, column: str, k: int = 8) -> DataFrame:
    """The k most frequent values (null counts as one) as ``value, n``; ties by value."""
    return df.groupBy(_q(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(k)


def categories(df: DataFrame, column: str, k: int = 19) -> DataFrame:
    """Value counts for a legend: the top k, the rest as ``other``; null and empty as ``(empty)``."""
    value = F.coalesce(F.nullif(_q(column).cast("string"), F.lit("")), F.lit("(empty)"))
    counts = df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    top = F.broadcast(counts.orderBy(F.desc("n"), "value").limit(k).select("value", F.lit(True).alias("top")))
    return counts.join(top, "value", "left").groupBy(F.when(F.col("top"), F.col("value")).otherwise("other").alias("value")).agg(F.sum("n").alias("n"))


def cast_report(df: DataFrame, column: str, kind: str) -> DataFrame:
    """How many values a cast would keep and how many would become empty."""
    new = cast_column(_q(column), kind)
    return df.agg(F.count(_q(column)).alias("had"), F.count(new).alias("kept"), F.count(F.when(_q(column).isNotNull() & new.isNull(), 1)).alias("emptied"))


def set_cells(df: DataFrame, key: str, edits: Mapping[object, Mapping[str, object]]) -> DataFrame:
    """Point updates by row key, as one projection."""
    by_column: dict[str, dict] = {}
    for k, cells in edits.items():
        for c, v in cells.items():
            by_column.setdefault(c, {})[k] = v
    kinds = dict(df.dtypes)
    out = {}
    for c, cells in by_column.items():
        col = _q(c)
        for k, v in cells.items():
            col = F.when(_q(key) == F.lit(k), F.lit(v).cast(kinds[c])).otherwise(col)
        out[c] = col
    return df.withColumns(out)


def append_row(df: DataFrame, row: Mapping[str, object]) -> DataFrame:
    """One row more; columns not given are null."""
    unknown = set(row) - set(df.columns)
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}")
    one = df.sparkSession.range(1).select(*(F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields))
    return df.unionByName(one)


def delete_rows(df: DataFrame, query: str) -> DataFrame:
    """All rows but those the column filter picks; rows where it is null stay."""
    condition = filter_condition(df, query)
    if condition is None:
        raise ValueError("a deletion needs a column filter")
    return df.where(~F.coalesce(condition, F.lit(False)))


def position_columns(df: DataFrame) -> tuple[str, str] | None:
    """The longitude and latitude columns: by name, then by values (at least 90 % in range, not constant)."""

    def score(name: str, exact: Sequence[str], part: Sequence[str]) -> int:
        low = re.sub(r"\(.*?\)|[^a-z]+", " ", name.lower()).strip()
        words = low.split()
        return 3 if low in exact else 2 if any(w in exact for w in words) else 1 if low in part else 0

    numeric = [c for c, k in _kinds(df).items() if k in ("integer", "number")]
    lons = sorted((c for c in numeric if score(c, ("lon", "long", "longitude", "lng"), ("x",))), key=lambda c: -score(c, ("lon", "long", "longitude", "lng"), ("x",)))
    lats = sorted((c for c in numeric if score(c, ("lat", "latitude"), ("y",))), key=lambda c: -score(c, ("lat", "latitude"), ("y",)))
    for lon, lat in zip(lons, lats, strict=False):
        ok = lambda c, most: F.avg((F.abs(_q(c)) <= most).cast("double"))
        r = df.agg(ok(lon, 180), ok(lat, 90), F.countDistinct(_q(lon)), F.countDistinct(_q(lat))).first()
        if r[0] is not None and r[0] >= 0.9 and r[1] >= 0.9 and min(r[2], r[3]) > 1:
            return lon, lat
    return None


def safe_names(names: Sequence[str]) -> list[str]:
    """Column names from band names: other characters become _, a leading digit gets b, repeats (without case) get _2, _3 ..."""
    out, seen = [], set()
    for n in names:
        base = re.sub(r"[^0-9A-Za-z]+", "_", n).strip("_") or "band"
        base = "b" + base if base[0].isdigit() else base
        name, i = base, 1
        while name.lower() in seen:
            i += 1
            name = f"{base}_{i}"
        seen.add(name.lower())
        out.append(name)
    return out


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Renames; unknown names and clashes are errors."""
    for a, b in names.items():
        if a not in df.columns:
            raise ValueError(f"no column {a!r}")
        if b in df.columns and b not in names:
            raise ValueError(f"a column {b!r} exists")
    return df.withColumnsRenamed(dict(names))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows, the same ones at every run: those with the smallest hash of key and seed."""
    h = F.xxhash64(_q(key), F.lit(seed))
    return df.orderBy(h, _q(key)).limit(n)


def bernoulli(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Each row with probability n / rows, by a hash of its key."""
    total = F.broadcast(df.agg(F.count("*").alias("__total")))  # one row
    u = F.shiftrightunsigned(F.xxhash64(_q(key), F.lit(seed)), 11).cast("double") / float(1 << 53)
    return df.join(total).where(u * F.col("__total") < n).drop("__total")


def stratified(df: DataFrame, column: str, per_class: int, key: str, seed: int = 0) -> DataFrame:
    """Each row with probability min(1, per_class / rows of its class)."""
    counts = df.groupBy(_q(column).alias("__class")).agg(F.count("*").alias("__n"))
    u = F.shiftrightunsigned(F.xxhash64(_q(key), F.lit(seed)), 11).cast("double") / float(1 << 53)
    return df.join(counts, _q(column).eqNullSafe(F.col("__class"))).where(u * F.col("__n") < per_class).drop("__class", "__n")


def page_view(df: DataFrame, offset: int = 0, limit: int = 100, query: str = "", sort: str | None = None, descending: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """A page with the number of all rows (``total``) and of those that the filter leaves (``filtered``) in each of its rows."""
    counts = df.agg(F.count("*").alias("total")).join(F.broadcast(filter_rows(df, query).agg(F.count("*").alias("filtered"))))  # one row
    return page(df, offset, limit, query, sort, descending, ties).join(F.broadcast(counts))


def preview(df: DataFrame, expression: str, name: str = "value", n: int = 8, ties: Sequence[str] = ()) -> DataFrame:
    """The first rows with what an expression would give: only n rows are calculated."""
    from loamgrid.functions.expressions import FieldDialect

    rows = df.orderBy(*ties).limit(n) if ties else df.limit(n)
    return rows.withColumn(name, FieldDialect(df.schema).compile(expression).col)


def natural_key(c: Column) -> Column:
    """A sort key under which digits in a text order as numbers, without case: item 9 before item 10."""
    parts = F.regexp_extract_all(F.lower(c.cast("string")), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def natural_sort(df: DataFrame, column: str, descending: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """Numbers as numbers, other columns by ``natural_key``; null and empty last in both directions."""
    number = _kinds(df)[column] in ("integer", "number")
    key = finite(_q(column).cast("double")) if number else natural_key(F.nullif(_q(column).cast("string"), F.lit("")))
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), *ties)


def attribute_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, n, missing, min, max, mean, median`` of number columns of an attribute table; the median is the value at rank n // 2 (from 0), never between two."""
    medians = exact_quantiles(df, {c: _q(c) for c in columns}, (lambda n: n // 2,))
    x = lambda c: finite(_q(c).cast("double"))
    parts = [F.struct(F.lit(c).alias("column"), F.count(x(c)).alias("n"), (F.count("*") - F.count(x(c))).alias("missing"), F.min(x(c)).alias("min"), F.max(x(c)).alias("max"), F.avg(x(c)).alias("mean"), F.lit(medians[c][0]).cast("double").alias("median")) for c in columns]
    return df.agg(F.array(*parts).alias("all")).select(F.explode("all").alias("r")).select("r.*")


def loose_filter(df: DataFrame, query: str) -> DataFrame:
    """``column op value`` on attributes: numbers and number-like texts compare as numbers whatever the column's type, others as text; null never matches."""
    m = _FILTER.match(query)
    name = m and next((c for c in df.columns if c == m[1].strip("[]\"'`")), None)
    if not name:
        return search_rows(df, query)
    op, value = m[2], m[3].strip("'\"")
    left, right = _q(name).cast("string"), F.lit(value)
    both = left.try_cast("double"), right.try_cast("double")
    compare = lambda a, b: {"=": a == b, "==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
    return df.where(F.when(both[0].isNotNull() & both[1].isNotNull(), compare(*both)).otherwise(compare(left, right)))


def describe_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, kind, rows, missing, distinct_values, integral, role`` for choosing features: one pass, distinct values from a sketch.

    Role: ``target`` for text or whole numbers of 2 to 100 values, ``id`` for columns of (nearly) as many values as rows, ``constant`` below two values, else ``feature``.
    """
    kinds, parts = _kinds(df), []
    for c in columns or df.columns:
        number = kinds[c] in ("integer", "number")
        x = finite(_q(c).cast("double")) if number else _q(c).cast("string")
        whole = F.bool_and(x == F.floor(x)) if number else F.lit(None).cast("boolean")
        parts.append(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("kind"), F.count("*").alias("rows"), (F.count("*") - F.count(x)).alias("missing"), F.approx_count_distinct(x).alias("distinct_values"), whole.alias("integral")))
    out = df.agg(F.array(*parts).alias("all")).select(F.explode("all").alias("r")).select("r.*")
    known, d = F.col("rows") - F.col("missing"), F.col("distinct_values")
    few = (d <= 100) & ((F.col("kind") == "text") | F.coalesce("integral", F.lit(False)))
    return out.withColumn("role", F.when(d < 2, "constant").when(few, "target").when((d >= 0.95 * known) & (F.coalesce("integral", F.lit(True))), "id").otherwise("feature"))


def count_by(df: DataFrame, by: Sequence[str], least: Column | None = None) -> DataFrame:
    """Rows of each combination of values, the most frequent first: detections by class, diagnoses by crop and status, entries by section."""
    rows = df if least is None else df.where(least)
    return rows.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)


def describe_bands(df: DataFrame, bands: Sequence[str], missing: Sequence[float] = (-9999.0,)) -> DataFrame:
    """``band, min, max, mean, empty_pct, warning`` of a pixel table's bands in one pass; the warning is ``empty``, ``constant`` or null."""
    parts = []
    for b in bands:
        x = finite(_q(b).cast("double"))
        x = F.when(~x.isin(*missing), x) if missing else x
        parts.append(F.struct(F.lit(b).alias("band"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), (100 * F.try_divide(F.count("*") - F.count(x), F.count("*"))).alias("empty_pct")))
    out = df.agg(F.array(*parts).alias("all")).select(F.explode("all").alias("r")).select("r.*")
    return out.withColumn("warning", F.when(F.col("min").isNull(), "empty").when(F.col("min") == F.col("max"), "constant"))
