"""Layers of boxes that meet in grid cells, compared in numpy: a cell's boxes in blocks of rows, without a row for each pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.geometry import fewer_boxes
from loamgrid.operators.meeting import PART_ROWS
from loamgrid.operators.vectors import fitted_cells
from loamgrid.storage import Staged, broadcast_upto

CORNERS = ("x0", "y0", "x1", "y1")
#: Rows of one layer and of the other that are compared at once.
BLOCK, WINDOW = 128, 4096


def blocks(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``a`` and in ``b`` (rows x0, y0, x1, y1) of blocks that hold all pairs that meet: along the axis on which boxes are shorter, each block meets the b that reach it."""
    size = lambda k: np.mean(a[k + 2] - a[k]) + np.mean(b[k + 2] - b[k])
    k = 1 if size(1) * np.ptp(b[0]) <= size(0) * np.ptp(b[1]) else 0
    rows, cols = np.argsort(a[k], kind="stable"), np.argsort(b[k], kind="stable")
    start, end = b[k][cols], np.maximum.accumulate(b[k + 2][cols])
    for at in range(0, len(rows), BLOCK):
        i = rows[at : at + BLOCK]
        low, high = np.searchsorted(end, a[k][i].min(), "left"), np.searchsorted(start, a[k + 2][i].max(), "right")
        for j in range(low, high, WINDOW):
            yield i, cols[j : min(j + WINDOW, high)]


def in_cells(a: DataFrame, b: DataFrame, size: float, find: Callable, schema: str, finish: Callable | None = None) -> DataFrame:
    """Rows that ``find`` yields from boxes that meet. ``a`` and ``b`` have a_x0 .. a_y1 and b_x0 .. b_y1; columns are plain or lists of numbers, a box with a null border meets none.

    Where a has corners __x0 .. __y1 too, those are compared, and its own ones only tell the cells.

    ``find(i, j, x, y, own, s, t)`` gets the places of a block, their corners x (columns) and y (rows of the other side), a function that tells in which pairs this cell
    is the pair's own (each pair has one), and both sides' Arrow tables; it gives a dict of columns, those named a_* and b_* as places. ``finish(columns, s, t)`` makes a cell's rows of all its blocks. Full cells of a are cut into counted parts.
    """
    put_a, put_b, sx, sy = fitted_cells(a, b, size)
    keys = ["__g", "__i", "__j"]
    left, right = put_a.withColumn("__side", F.lit(True)), put_b.withColumn("__side", F.lit(False))
    full = Staged(put_a.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > PART_ROWS).select(*keys, F.ceil(F.col("__n") / PART_ROWS).cast("int").alias("__parts")))
    if full.rows:
        counted, parts = broadcast_upto(full, 100_000), F.coalesce("__parts", F.lit(1))
        row = F.xxhash64(*(F.col(c) for c, kind in a.dtypes if "<" not in kind))
        left = left.join(counted, keys, "left").withColumn("__salt", F.pmod(row, parts).cast("int")).drop("__parts")
        right = right.join(counted, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
        keys = [*keys, "__salt"]
    names, whole = [f.split()[0] for f in schema.split(", ")], {f.split()[0] for f in schema.split(", ") if f.endswith(" long")}
    names_a, names_b = [*a.columns, "__la"], [*b.columns, "__lb"]

    def run(table: pa.Table) -> pa.Table:
        side = table["__side"]
        s, t = table.filter(side).select(names_a), table.filter(pa.compute.invert(side)).select(names_b)
        out = []
        if s.num_rows and t.num_rows:
            x, y = (np.stack([u[f"{n}_{c}"].to_numpy() for c in CORNERS]) for u, n in ((s, "a"), (t, "b")))
            exact = np.stack([s[f"__{c}"].to_numpy() for c in CORNERS]) if "__x0" in names_a else x
            la, lb = s["__la"].to_numpy(), t["__lb"].to_numpy()
            g, ci, cj = (table[c][0].as_py() for c in ("__g", "__i", "__j"))
            wide = 2.0**g

            def own(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                """Of pairs (arrays that broadcast): each meets in the coarser grid of the two, in the cell that holds the lower corner of its common box."""
                here = np.maximum(la[i], lb[j]) == g
                for k, w, c in ((0, sx, ci), (1, sy, cj)):
                    here &= np.floor(np.maximum(x[k][i], y[k][j]) / (w * wide)) == c
                return here

            for i, j in blocks(x, y):
                out.append(find(i, j, exact[:, i, None], y[:, None, j], own, s, t))
        out = [o for o in out if o]
        columns = {n: np.concatenate([o[n] for o in out]) for n in out[0]} if out else {}
        if finish and out:
            columns = finish(columns, s, t)
        # Keys are places until here, so that any type of key comes through.
        taken = {}
        for n in names:
            side, v = s if n.startswith("a_") else t, columns.get(n, np.array([]))
            taken[n] = side[n].combine_chunks().take(pa.array(v.astype(np.int64))) if n[:2] in ("a_", "b_") else pa.array(v.astype(np.int64 if n in whole else float))
        return pa.table(taken)

    return left.unionByName(right, allowMissingColumns=True).groupBy(*keys).applyInArrow(run, schema)


def _kinds(df: DataFrame, *columns: str) -> list[str]:
    kinds = dict(df.dtypes)
    return [f"{c} {kinds[c]}" for c in columns]


def meets(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x[0] <= y[2]) & (y[0] <= x[2]) & (x[1] <= y[3]) & (y[1] <= x[3])


def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Area that boxes share, 0 where they don't meet."""
    w = np.minimum(x[2], y[2])
    w -= np.maximum(x[0], y[0])
    h = np.minimum(x[3], y[3])
    h -= np.maximum(x[1], y[1])
    np.maximum(w, 0.0, out=w)
    np.maximum(h, 0.0, out=h)
    w *= h
    return w


def related(a: DataFrame, b: DataFrame, a_key: str, b_key: str, size: float, test: Callable) -> DataFrame:
    """``a_key, b_key`` of the meeting boxes for which ``test(x, y)`` holds."""

    def find(i, j, x, y, own, s, t):
        p, q = np.nonzero(test(x, y))
        here = own(i[p], j[q])
        return {a_key: i[p[here]], b_key: j[q[here]]}

    return in_cells(a, b, size, find, ", ".join(_kinds(a, a_key) + _kinds(b, b_key)))


def having(a: DataFrame, b: DataFrame, a_key: str, size: float, test: Callable) -> DataFrame:
    """``a_key`` of the boxes that meet some box for which ``test(x, y)`` holds; a key may come from several cells."""
    return in_cells(a, b, size, lambda i, j, x, y, own, s, t: {a_key: i[test(x, y).any(1)]}, _kinds(a, a_key)[0])


def best(a: DataFrame, b: DataFrame, a_key: str, b_key: str, size: float, others: bool = False, touching: bool = True) -> DataFrame:
    """``a_key, b_key, overlap``: of each box a the b with the largest common area, ties to the smaller b. ``others`` leaves out equal keys, without ``touching`` pairs need an area."""

    def find(i, j, x, y, own, s, t):
        # In the order of keys the first of the largest is the one with the least key.
        keys = t[b_key].take(pa.array(j))
        order = pa.compute.sort_indices(keys).to_numpy()
        y, j = y[:, :, order], j[order]
        area = common(x, y)
        if touching:
            np.copyto(area, -1.0, where=~meets(x, y))
        if others:
            mine = {k: n for n, k in enumerate(keys.take(pa.array(order)).to_pylist())}
            for n, k in enumerate(s[a_key].take(pa.array(i)).to_pylist()):
                if k in mine:
                    area[n, mine[k]] = -1.0
        top = area.argmax(1)
        most = area[np.arange(len(i)), top]
        ok = most >= 0 if touching else most > 0
        return {a_key: i[ok], b_key: j[top[ok]], "overlap": most[ok]}

    found = Staged(in_cells(a, b, size, find, ", ".join([*_kinds(a, a_key), *_kinds(b, b_key), "overlap double"]))).df
    top = found.groupBy(F.col(a_key).alias("__k")).agg(F.max("overlap").alias("__top"))
    most = found.join(top, F.col(a_key).eqNullSafe(F.col("__k")) & (F.col("overlap") == F.col("__top")))
    return most.groupBy(a_key, "overlap").agg(F.min(b_key).alias(b_key)).select(a_key, b_key, "overlap")


def shared_area(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """``area``, rows whose sum is the common area of all pairs of boxes."""

    def find(i, j, x, y, own, s, t):
        area = common(x, y)
        p, q = np.nonzero(area)
        return {"area": np.array([area[p, q][own(i[p], j[q])].sum()])}

    return in_cells(a, b, size, find, "area double")


def labels(a: DataFrame, key: str, size: float, test: Callable) -> DataFrame:
    """``b_<key>, b_root``: boxes joined by meeting pairs for which ``test(x, y, i, j, s, t)`` holds, and the least key of those joined within a cell; a key may come from several cells."""
    a_key, b_key = f"a_{key}", f"b_{key}"
    sides = [a.select(*(F.col(c).alias(f"{s}_{c}") for c in a.columns)) for s in "ab"]

    def find(i, j, x, y, own, s, t):
        p, q = np.nonzero(test(x, y, i, j, s, t))
        return {"i": i[p], "j": j[q]}

    def finish(columns, s, t):
        # All of s are in t; places in the order of keys, so that the least place is the least key.
        keys = t[b_key].combine_chunks()
        rank = np.empty(len(keys), np.int64)
        rank[order := pa.compute.sort_indices(keys).to_numpy()] = np.arange(len(keys))
        mine = pa.compute.index_in(s[a_key].combine_chunks(), keys).to_numpy()
        p, q = rank[mine[columns["i"]]], rank[columns["j"]]
        root = least_joined(len(keys), p, q)
        used = np.unique(np.concatenate([p, q]))
        return {b_key: order[used], "b_root": order[root[used]]}

    return in_cells(*(d.withColumn("b_root", F.col(b_key)) if n else d for n, d in enumerate(sides)), size, find, f"{b_key} {dict(a.dtypes)[key]}, b_root {dict(a.dtypes)[key]}", finish)


def least_joined(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each of n places the least one that pairs p, q join it to, in as many rounds as that takes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[p], root[q])
        new = root.copy()
        for at in (root[p], root[q], p, q):
            np.minimum.at(new, at, low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, root):
            return root
        root = new


def ring_counts(points: DataFrame, rings: DataFrame, b_key: str, size: float, corners: int, value: str | None) -> DataFrame:
    """``b_key, n, s``: how many points each shape of one ring (``b_ring``: x and y of ``corners`` points) holds by the even-odd rule and the sum of their a_<value>; a key may come from several cells."""

    def find(i, j, x, y, own, s, t):
        p, q = np.nonzero(meets(x, y))
        p, q = i[p], j[q]
        px, py = s["a_x0"].to_numpy()[p], s["a_y0"].to_numpy()[p]
        ring = t["b_ring"].combine_chunks().flatten().to_numpy().reshape(-1, 2 * corners)
        odd = np.zeros(len(p), bool)
        for k in range(1, corners):
            e = ring[:, 2 * k - 2 : 2 * k + 2]
            if (e[:, :2] == e[:, 2:]).all():
                continue
            ax, ay, bx, by = e[q].T
            with np.errstate(divide="ignore", invalid="ignore"):
                odd ^= ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
        p, q = p[odd], q[odd]
        here = own(p, q)
        p, q = p[here], q[here]
        v = pa.compute.fill_null(s[f"a_{value}"], 0.0).to_numpy()[p] if value else np.zeros(len(p))
        return {"n": np.bincount(q, minlength=t.num_rows)[None], "s": np.bincount(q, v, minlength=t.num_rows)[None]}

    def finish(columns, s, t):
        n = columns["n"].sum(0)
        held = np.flatnonzero(n)
        return {b_key: held, "n": n[held], "s": columns["s"].sum(0)[held]}

    return in_cells(points, rings, size, find, ", ".join([*_kinds(rings, b_key), "n long", "s double"]), finish)


def cover(a: DataFrame, b: DataFrame, a_key: str, size: float) -> DataFrame:
    """``a_key, whole, x0, y0, x1, y1``: rectangles with the union of what the b cover of a box, as few as they become within a cell; ``whole`` is 1 where a cell's b cover all of it."""

    def find(i, j, x, y, own, s, t):
        whole = ((y[0] <= x[0]) & (y[1] <= x[1]) & (y[2] >= x[2]) & (y[3] >= x[3])).any(1)
        shared, boxes, corners = common(x, y) > 0, y[:, 0].T, x[:, :, 0].T
        at, rows, full = [i[whole]], [corners[whole]], [np.ones(whole.sum())]
        for n in np.flatnonzero(~whole & shared.any(1)):
            met = boxes[shared[n]]
            cut = np.column_stack([np.maximum(met[:, :2], corners[n, :2]), np.minimum(met[:, 2:], corners[n, 2:])])
            less = fewer_boxes(cut)
            at.append(np.full(len(less), i[n]))
            rows.append(less)
            full.append(np.full(len(less), float(len(less) == 1 and (less[0] == corners[n]).all())))
        return {a_key: np.concatenate(at), "whole": np.concatenate(full), **dict(zip(CORNERS, np.concatenate(rows).T, strict=True))}

    return in_cells(a, b, size, find, ", ".join([*_kinds(a, a_key), "whole long", *(f"{c} double" for c in CORNERS)]))
