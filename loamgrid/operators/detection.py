"""Boxes of detections: overlaps, suppression, matching, and the cascade that judges photos."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.operators.joins import box_iou, boxes_of
from loamgrid.operators.vectors import box_pairs, spread
from loamgrid.storage import Staged

BOX = ("x0", "y0", "x1", "y1")


def iou_pairs(df: DataFrame, key: str, cls: str, size: float, least: float = 0.0) -> DataFrame:
    """Pairs of boxes of one class with their IoU above ``least``; each pair once (the smaller key is a)."""
    a, b = boxes_of(df, "a", *BOX), boxes_of(df, "b", *BOX)
    pairs = box_pairs(a, b, size).where((F.col(f"a_{key}") < F.col(f"b_{key}")) & F.col(f"a_{cls}").eqNullSafe(F.col(f"b_{cls}"))).withColumn("iou", box_iou())
    return pairs.where(F.col("iou") > least)


def suppress(df: DataFrame, key: str, cls: str, score: str, size: float, iou: float = 0.5) -> DataFrame:
    """Greedy non-maximum suppression within classes: the best box stays, those over ``iou`` with it go, and so on (ties: the smaller key first).

    In rounds over overlap pairs: a box with no better undecided neighbour stays, its neighbours go. That is the greedy result, without
    gathering a class; the rounds are few, as each settles all local maxima at once. Rounds are written to the shared folder.
    """
    rank = df.select(F.col(key).alias("k"), F.struct(F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))).alias("s"), (-F.col(key)).alias("k")).alias("r"))
    pairs = iou_pairs(df, key, cls, size, iou).select(F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"))
    ranked = pairs.join(rank.select(F.col("k").alias("a"), F.col("r").alias("ra")), "a").join(rank.select(F.col("k").alias("b"), F.col("r").alias("rb")), "b")
    better = F.col("ra") > F.col("rb")
    left = Staged(ranked.select(F.when(better, F.col("a")).otherwise(F.col("b")).alias("hi"), F.when(better, F.col("b")).otherwise(F.col("a")).alias("lo")))
    gone = None
    while left.rows:
        # Local maxima: they suppress someone and nobody undecided suppresses them.
        keep = left.df.select(F.col("hi").alias("k")).distinct().join(left.df.select(F.col("lo").alias("k")), "k", "left_anti")
        lost = Staged(left.df.join(keep, F.col("hi") == F.col("k"), "left_semi").select(F.col("lo").alias("k")).distinct())
        gone = lost.df if gone is None else gone.unionByName(lost.df)
        new = Staged(left.df.join(lost.df, F.col("lo") == F.col("k"), "left_anti").join(lost.df, F.col("hi") == F.col("k"), "left_anti"))
        rest = new.df.join(keep, F.col("hi") == F.col("k"), "left_anti")
        fresh = Staged(rest)
        new.drop()
        left.drop()
        left = fresh
    return df if gone is None else df.join(gone.select(F.col("k").alias("__gone")), F.col(key) == F.col("__gone"), "left_anti")


def match_truth(pred: DataFrame, truth: DataFrame, key: str, cls: str, score: str, size: float, iou: float = 0.5) -> DataFrame:
    """``pred, truth, iou``: one-to-one matches, greedily by score, then IoU, then keys.

    In rounds: a pair that is the best one left for both its boxes is a match, and all pairs of these boxes go; that is the greedy result.
    """
    a, b = boxes_of(pred, "a", *BOX), boxes_of(truth, "b", *BOX)
    pairs = box_pairs(a, b, size).where(F.col(f"a_{cls}").eqNullSafe(F.col(f"b_{cls}"))).withColumn("iou", box_iou()).where(F.col("iou") >= iou)
    p, t = F.col(f"a_{key}"), F.col(f"b_{key}")
    left = Staged(pairs.select(p.alias("p"), t.alias("t"), "iou", F.struct(F.col(f"a_{score}").cast("double").alias("s"), F.col("iou").alias("i"), (-p).alias("p"), (-t).alias("t")).alias("r")))
    out = left.df.select("p", "t", "iou").limit(0)
    while left.rows:
        best_p = left.df.groupBy("p").agg(F.max("r").alias("r"))
        best_t = left.df.groupBy("t").agg(F.max("r").alias("r"))
        hit = Staged(left.df.join(best_p, ["p", "r"], "left_semi").join(best_t, ["t", "r"], "left_semi").select("p", "t", "iou"))
        out = out.unionByName(hit.df)
        new = Staged(left.df.join(hit.df.select("p"), "p", "left_anti").join(hit.df.select("t"), "t", "left_anti").select(*left.df.columns))
        left.drop()
        left = new
    return out.select(F.col("p").alias("pred"), F.col("t").alias("truth"), "iou")


def merge_cut(df: DataFrame, key: str, cls: str, score: str, tile: str, size: float, least: float = 0.5) -> DataFrame:
    """``key, cls, x0, y0, x1, y1, score, pieces``: boxes of one class from different tiles that share at least ``least`` of the smaller one become one object.

    Pieces are joined by components (minimum labels), so an object cut by many tiles comes out once, under its least key, with the box around all pieces and the best score.
    """
    from loamgrid.operators import cells
    from loamgrid.operators.raster import spread_labels

    boxes = Staged(spread(df.select(key, cls, tile, *(F.col(c).cast("double").alias(c) for c in BOX)))).df

    def joined(x, y, i, j, s, t):
        least_area = np.minimum((x[2] - x[0]) * (x[3] - x[1]), (y[2] - y[0]) * (y[3] - y[1]))
        with np.errstate(divide="ignore", invalid="ignore"):
            ok = cells.common(x, y) / least_area >= least
        # Classes (null is one) and tiles (null is none) as numbers that both sides share.
        for name, same, none in ((cls, True, True), (tile, False, False)):
            p, q = s[f"a_{name}"].take(pa.array(i)), t[f"b_{name}"].take(pa.array(j))
            codes = pa.chunked_array([*p.chunks, *q.chunks]).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            u, v = codes[: len(i), None], codes[None, len(i) :]
            ok &= (u == v) == same
            if not none:
                ok &= p.is_valid().to_numpy()[:, None] & q.is_valid().to_numpy()[None]
        return ok

    # Within a cell pieces go to their least key at once; only the keys that share a piece are joined on.
    found = Staged(cells.labels(boxes, key, size, joined)).df
    least_root = Staged(found.groupBy(F.col(f"b_{key}").alias("piece")).agg(F.min("b_root").alias("root"))).df
    bonds = found.join(least_root, F.col(f"b_{key}") == F.col("piece")).where("b_root <> root").select(F.col("b_root").alias("a"), F.col("root").alias("b")).distinct()
    ends = spread_labels(found.select(F.col("b_root").alias("node")).distinct(), bonds)
    pieces = least_root.join(ends, F.col("root") == F.col("node")).select("piece", "label")
    labels = df.select(F.col(key).alias("node")).join(pieces, F.col("node") == F.col("piece"), "left").select("node", F.coalesce("label", "node").alias("label"))
    named = df.join(labels, F.col(key) == F.col("node"))
    g = named.groupBy(F.col("label").alias(key), cls)
    return g.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max(score).alias(score), F.count("*").alias("pieces"))


def detection_scores(matches: int, predicted: int, true: int) -> dict:
    p, r = matches / predicted if predicted else 0.0, matches / true if true else 0.0
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0}


def tile_boxes(df: DataFrame, tile: float, overlap: float, min_visible: float = 0.4) -> DataFrame:
    """Boxes cut to overlapping tiles (label lines): ``trow, tcol`` and the centre and size as shares of the tile; pieces under ``min_visible`` of the box drop."""
    step = tile * (1 - overlap)
    span = lambda a, b: F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(a) - tile) / step)).cast("long"), F.floor(F.col(b) / step).cast("long")))
    put = df.withColumn("tcol", span("x0", "x1")).withColumn("trow", span("y0", "y1"))
    l, t = F.col("tcol") * step, F.col("trow") * step
    x0, x1, y0, y1 = F.greatest(F.col("x0"), l), F.least(F.col("x1"), l + tile), F.greatest(F.col("y0"), t), F.least(F.col("y1"), t + tile)
    seen = F.try_divide(F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0)), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return put.withColumns({"cx": ((x0 + x1) / 2 - l) / tile, "cy": ((y0 + y1) / 2 - t) / tile, "w": (x1 - x0) / tile, "h": (y1 - y0) / tile, "visible": seen}).where((F.col("visible") >= min_visible) & (F.col("w") > 0) & (F.col("h") > 0))


#: Photo gates.
SHORT_SIDE, DARK, BRIGHT, FLAT, SHARP = 96, 45, 235, 10, 45


def photo_issue(short_side: Column, p90: Column, mean: Column, std: Column, sharpness: Column, least_sharp: float = SHARP) -> Column:
    """The first reason why a photo can't be judged; null if none."""
    return F.when(short_side < SHORT_SIDE, "too small").when(p90 < DARK, "too dark").when(mean > BRIGHT, "too bright").when(std < FLAT, "no detail").when(sharpness < least_sharp, "blurry")
