"""Reading and writing tables: sniffed text files, versioned Parquet, feeds."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = (",", "\t", ";", "|")


def sniff_delimiter(header: str) -> str:
    """The most frequent of comma, tab, semicolon and bar in the header line."""
    return max(DELIMITERS, key=header.count)


def header_names(cells: Sequence[str | None]) -> list[str]:
    """Blank headers become column_<n>; repeats get _2 appended until they are new."""
    out: list[str] = []
    for i, c in enumerate(cells, 1):
        name = (c or "").strip() or f"column_{i}"
        while name in out:
            name += "_2"
        out.append(name)
    return out


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: str | None = None) -> DataFrame:
    """Parquet, ORC, JSON lines or text with a sniffed delimiter; only ``columns`` are read (unknown ones are named in the error)."""
    low = path.lower()
    if low.endswith((".parquet", ".pq")):
        df = spark.read.parquet(path)
    elif low.endswith(".orc"):
        df = spark.read.orc(path)
    elif low.endswith((".json", ".jsonl", ".ndjson")):
        df = spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    else:
        first = spark.read.text(path).limit(1).collect()
        sep = "\t" if low.endswith(".tsv") else sniff_delimiter(first[0][0] if first else "")
        reader = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
        names = header_names([c.lstrip("﻿") for c in df.columns])
        df = df.toDF(*names)
    if columns:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"no column {', '.join(missing)}")
        df = df.select(*columns)
    return df


def import_table(spark: SparkSession, source: str, target: str) -> DataFrame:
    """A text file as Parquet under ``target``; an empty table is refused and nothing is overwritten."""
    df = read_table(spark, source)
    if df.isEmpty():
        raise ValueError("the table is empty")
    df.write.mode("error").option("compression", "zstd").parquet(target)
    return spark.read.parquet(target)


class VersionedTable:
    """Versions of a table as folders v=<n>: every write adds one, undo drops the last, at most ``keep`` stay.

    Readers see a version only after it is complete (Spark's commit writes _SUCCESS last).
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 15):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._hpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._hpath(self.path)):
            return []
        found = [m for s in self._fs.listStatus(self._hpath(self.path)) if (m := re.fullmatch(r"v=(\d+)", s.getPath().getName()))]
        return sorted(int(m[1]) for m in found if self._fs.exists(self._hpath(f"{self.path}/{m[0]}/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame:
        have = self.versions()
        if not have:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/v={have[-1] if version is None else version}")

    def write(self, df: DataFrame) -> int:
        have = self.versions()
        n = (have[-1] if have else 0) + 1
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/v={n}")
        for old in have[: max(0, len(have) + 1 - self.keep)]:
            self._fs.delete(self._hpath(f"{self.path}/v={old}"), True)
        return n

    def undo(self) -> DataFrame:
        have = self.versions()
        if len(have) < 2:
            raise ValueError("nothing to undo")
        self._fs.delete(self._hpath(f"{self.path}/v={have[-1]}"), True)
        return self.read()

    def derive(self, query: str, target: str) -> "VersionedTable":
        """Rows that a filter picks, as a new table."""
        from loamgrid.operators.tables import filter_rows

        out = VersionedTable(self.spark, target, self.keep)
        if out.versions():
            raise ValueError(f"{target} exists")
        out.write(filter_rows(self.read(), query))
        return out


class EditSession:
    """Edits of a versioned table that are only kept when saved: ``edit`` (a function of the table, with a line for the log), ``save``, ``save_as``, ``discard``."""

    def __init__(self, table: VersionedTable):
        self.table, self.df, self.log = table, table.read(), []
        self.start = table.versions()[-1]

    def edit(self, note: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        self.df = change(self.df)
        self.log.append(note)
        return self.df

    def save(self) -> int:
        """Overwrites: a new version. Refused if the table changed since the session began."""
        if self.table.versions()[-1] != self.start:
            raise ValueError("the table has changed since the session began")
        self.start = self.table.write(self.df) if self.log else self.start
        return self._again()

    def save_as(self, path: str) -> VersionedTable:
        """The edited rows as a new table; the old one stays as it is."""
        out = VersionedTable(self.table.spark, path, self.table.keep)
        if out.versions():
            raise ValueError(f"{path} exists")
        out.write(self.df)
        self._again()
        return out

    def discard(self) -> None:
        self._again()

    def _again(self) -> int:
        self.df, self.log = self.table.read(), []
        return self.start


def write_csv(df: DataFrame, path: str, digits: int = 7) -> None:
    """Text files with a header; numbers with ``digits`` significant digits."""
    short = {c: F.format_string(f"%.{digits}g", F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    df.withColumns(short).write.mode("error").option("header", True).csv(path)


def station_feed(spark: SparkSession, path: str, city: str | None = None, state: str | None = None, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """State / City / Station / Pollutant_Index XML as one row a pollutant: state, city, station, updated, lat, lon, pollutant, low, high, mean.

    Read by states and exploded, so that a station keeps the city and state above it. Filters go without case, other city names by ``aliases``; texts
    that are no number (NA) are null.
    """
    station = "struct<_id:string,_lastupdate:string,_latitude:string,_longitude:string,Pollutant_Index:array<struct<_id:string,_min:string,_max:string,_avg:string>>>"
    schema = f"_id string, City array<struct<_id:string,Station:array<{station}>>>"
    raw = spark.read.format("xml").option("rowTag", "State").option("attributePrefix", "_").schema(schema).load(path)
    c = raw.select(F.col("_id").alias("state"), F.explode("City").alias("c")).select("state", F.col("c._id").alias("city"), F.explode("c.Station").alias("s"))
    p = c.select("state", "city", "s.*").select("state", "city", F.col("_id").alias("station"), F.col("_lastupdate").alias("updated"), F.col("_latitude").try_cast("double").alias("lat"), F.col("_longitude").try_cast("double").alias("lon"), F.explode_outer("Pollutant_Index").alias("p"))
    out = p.select("state", "city", "station", "updated", "lat", "lon", F.col("p._id").alias("pollutant"), *(F.col(f"p._{a}").try_cast("double").alias(n) for a, n in (("min", "low"), ("max", "high"), ("avg", "mean"))))
    if city:
        out = out.where(F.contains(F.lower("city"), F.lit((aliases or {}).get(city.lower(), city).lower())))
    return out.where(F.lower(F.regexp_replace("state", "_", " ")) == state.lower().replace("_", " ")) if state else out


def table_list(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder, the newest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "path")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """SHA-256 of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def product_names(df: DataFrame, name: str) -> DataFrame:
    """Satellite, level, date and tile out of product names."""
    c = F.col(name)
    part = lambda p, g=1: F.nullif(F.regexp_extract(c, p, g), F.lit(""))
    return df.withColumns({"mission": part(r"^(S[12][A-D])_"), "level": part(r"_MSI(L[12][AC])_"), "tile": part(r"_T(\d{2}[A-Z]{3})_"), "sensed": F.try_to_timestamp(part(r"_(\d{8}T\d{6})"), F.lit("yyyyMMdd'T'HHmmss"))})


def backscatter(df: DataFrame, dn: str, gain: str, row: str = "row", col: str = "col", looks: int = 4) -> DataFrame:
    """Radar sigma nought in dB: the mean power of looks x looks pixels, DN^2 / gain^2, as 10 log10."""
    power = F.pow(F.col(dn), 2) / F.pow(F.col(gain), 2)
    g = df.groupBy(F.floor(F.col(row) / looks).alias(row), F.floor(F.col(col) / looks).alias(col)).agg(F.avg(power).alias("p"))
    return g.select(row, col, (10 * F.log10(F.when(F.col("p") > 0, F.col("p")))).alias("sigma0_db"))
