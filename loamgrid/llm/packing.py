"""Items of varying length in containers of fixed capacity."""

from __future__ import annotations

import base64
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.storage import Staged

#: Fixed value: how the public byte-level tokenizer cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict = {}


def _encoding(path: str):
    """The tokenizer of a ranks file, loaded once in each Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_lengths(df: DataFrame, key: str, text: str, ranks_path: str) -> DataFrame:
    """``key, tokens`` of every row: tokens of the whole text; null and empty texts have 0."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(ranks_path).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int32")

    return df.select(F.col(key).alias("key"), count(F.col(text)).alias("tokens"))


def optimal_buckets(histogram: Mapping[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least total padding (each item padded to its bound).

    Dynamic programming over the distinct lengths: best(k, j) = min over i < j of best(k - 1, i) + padding of lengths i..j to length j.
    """
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    n = np.array([histogram[x] for x in lengths.tolist()], np.float64)
    count, total = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n * lengths)))
    size = len(lengths)
    # cost[i, j]: lengths i..j (0-based) in one bucket.
    cost = lengths[None, :] * (count[None, 1:] - count[:-1, None]) - (total[None, 1:] - total[:-1, None])
    cost[np.tril_indices(size, -1)] = np.inf
    best, cuts = cost[0].copy(), [np.zeros(size, np.int64)]
    for _ in range(min(buckets, size) - 1):
        options = np.concatenate(([np.inf], best[:-1]))[:, None] + cost
        cut = options.argmin(0)
        new = options[cut, np.arange(size)]
        keep = new < best
        cuts.append(np.where(keep, cut, -1))
        best = np.where(keep, new, best)
    bounds, j, k = [], size - 1, len(cuts) - 1
    while j >= 0:
        while k > 0 and cuts[k][j] < 0:
            k -= 1
        bounds.append(int(lengths[j]))
        j, k = int(cuts[k][j]) - 1 if k else -1, k - 1
    return bounds[::-1]


def container_patterns(bounds: list[int], counts: list[int], capacity: int, mixed: bool = False) -> list[tuple[int, list[tuple[int, int]]]]:
    """Container patterns ``(repeat, [(bucket, items), ...])`` that hold all items.

    A pattern is a token-budget batch of one bucket: as many items as fit at the bucket's bound. ``mixed`` adds, in the space that the batch leaves, batches
    of the next smaller buckets. A pattern repeats as long as its buckets last. The work depends on the number of buckets, never on the number of items.
    """
    left, out = list(counts), []
    for k in range(len(bounds) - 1, -1, -1):
        while left[k]:
            room, pattern = capacity, []
            for j in range(k, -1, -1) if mixed else (k,):
                m = min(room // bounds[j], left[j])
                if m:
                    pattern.append((j, m))
                    room -= m * bounds[j]
            repeat = min(left[j] // m for j, m in pattern)
            for j, m in pattern:
                left[j] -= repeat * m
            out.append((repeat, pattern))
    return out


class Packing:
    """Containers of ``capacity`` tokens filled with whole items; only items longer than a container are split.

    1. Lengths: tokens of whole texts, in Arrow batches, written down once.
    2. Pieces: an item up to the capacity is one piece; a longer one becomes full containers and a rest.
    3. Histogram: pieces of each length (at most ``capacity`` rows come to the driver, whatever the corpus).
    4. Buckets by dynamic programming; token-budget batches inside each bucket, from the buckets' counts. By themselves they leave the space
       of long items empty (a text of 1,100 tokens is alone in its container); ``containers(mixed=True)`` combines batches of several buckets in one container.
    5. Batches: each piece gets its number in its bucket and with it its container. Numbers come from counts of hashed parts and
       ranks within a part, so a bucket with a third of all items is never ordered in one task.

    Null and empty texts have no token and no piece. A null key is kept as any other key. Repeated rows are separate items.
    """

    def __init__(self, df: DataFrame, key: str, text: str, ranks_path: str, capacity: int = 2048, buckets: int = 256, part_rows: int = 50_000):
        self.capacity, self.part_rows, self.buckets = capacity, part_rows, buckets
        self.lengths = Staged(token_lengths(df, key, text, ranks_path))

    def split_items(self) -> DataFrame:
        """Items longer than a container, with their ``tokens``."""
        return self.lengths.df.where(F.col("tokens") > self.capacity)

    def pieces(self) -> DataFrame:
        """``key, piece, start, length``: what goes into containers."""
        c = self.capacity
        rows = self.lengths.df.where("tokens > 0")
        last = F.floor((F.col("tokens") - 1) / c).cast("int")
        each = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
        return each.select("key", "piece", (F.col("piece") * c).alias("start"), F.least(F.lit(c), F.col("tokens") - F.col("piece") * c).cast("int").alias("length"))

    def containers(self, mixed: bool = False) -> DataFrame:
        """``key, piece, start, length, container_id``; each container is a batch of one bucket, or with ``mixed`` batches of several."""
        spark = self.lengths.spark
        histogram = {r.length: r.n for r in self.pieces().groupBy("length").agg(F.count("*").alias("n")).collect()}
        bounds = optimal_buckets(histogram, self.buckets)
        counts = [0] * len(bounds)
        for length, n in histogram.items():
            counts[int(np.searchsorted(bounds, length))] += n
        segments, used, done = [], 0, [0] * len(bounds)
        for repeat, pattern in container_patterns(bounds, counts, self.capacity, mixed):
            for j, m in pattern:
                segments.append((j, done[j], done[j] + m * repeat - 1, m, used))
                done[j] += m * repeat
            used += repeat
        plan = spark.createDataFrame(segments, "bucket int, lo long, hi long, m long, first long")  # bounded by the buckets
        parts = max(1, -(-max(counts, default=0) // self.part_rows))
        # The bucket of a length through a table of at most `capacity` rows.
        table = spark.createDataFrame([(x, int(np.searchsorted(bounds, x))) for x in sorted(histogram)], "length int, bucket int")
        items = self.pieces().join(F.broadcast(table), "length").withColumn("part", F.pmod(F.xxhash64("key", "piece"), F.lit(parts)).cast("int"))
        sizes = items.groupBy("bucket", "part").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n")
        offsets = sizes.select("bucket", "part", before.alias("before"))  # buckets x parts rows
        rank = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("key", "piece"))
        numbered = items.withColumn("rank", rank).join(offsets, ["bucket", "part"]).withColumn("ordinal", F.col("before") + F.col("rank") - 1)
        put = numbered.join(F.broadcast(plan), "bucket").where(F.col("ordinal").between(F.col("lo"), F.col("hi")))
        return put.select("key", "piece", "start", "length", (F.col("first") + F.floor((F.col("ordinal") - F.col("lo")) / F.col("m"))).cast("long").alias("container_id"))
