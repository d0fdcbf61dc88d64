"""Reading level of documents from sentence-level character and word models."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.batches import slices

#: A sentence ends at . ! ? (or a line break between blocks), followed by space and no lower-case letter.
_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[\"'(\[]*[^\sa-z])|\n\s*\n|\n(?=\s*(?:[-*#>|]|\d+[.)]))")
_MARK = re.compile(r"</?[a-zA-Z!][^<>]*>|&(?:\w{2,8}|#\d{1,6});|[*#>|_`~]+")
_SPACE = re.compile(r"[^a-z]+")
_BASE = np.uint64(1_000_003)


def sentences(text: str, least: int = 3) -> list[str]:
    """Lower-case letter words of each sentence, joined by spaces; pieces of fewer than ``least`` words join the next one."""
    out, held = [], ""
    for piece in _END.split(_MARK.sub(" ", text)):
        words = _SPACE.sub(" ", piece.lower()).strip()
        held = f"{held} {words}".strip()
        if held.count(" ") + 1 >= least:
            out.append(held)
            held = ""
    if held and out:
        out[-1] += " " + held
    elif held:
        out.append(held)
    return out


class Features:
    """Hashed features of many sentences at once: character n-grams of padded words and whole words, without a loop over characters."""

    def __init__(self, bits: int = 15, grams: Sequence[int] = (2, 3, 4)):
        self.bits, self.grams = bits, tuple(grams)

    @property
    def size(self) -> int:
        return (len(self.grams) + 1) << self.bits

    def index(self, sents: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Of each family: (feature numbers, start of each sentence); and per sentence words, characters."""
        # Every sentence is " word word " and ends with a line feed, so n-grams across sentences can be told.
        data = np.frombuffer((" " + " \n ".join(sents) + " \n").encode("ascii", "ignore"), np.uint8)
        ends = np.flatnonzero(data == 10)
        starts = np.concatenate(([0], ends[:-1] + 1))
        codes = data.astype(np.uint64)
        top, out = np.uint64(64 - self.bits), []
        for f, n in enumerate(self.grams):
            h = np.zeros(len(codes), np.uint64)
            for k in range(n):
                h[: len(codes) - k] = h[: len(codes) - k] * _BASE + codes[k:]
            h = ((h * np.uint64(0x9E3779B97F4A7C15)) >> top).astype(np.int32) + np.int32(f << self.bits)
            out.append((h, starts))
        letter = (data != 32) & (data != 10)
        first = np.flatnonzero(letter & ~np.concatenate(([False], letter[:-1])))
        at = np.zeros(len(data), np.int32)
        at[first] = first
        place = np.arange(len(data), dtype=np.int32) - np.maximum.accumulate(at)
        power = np.cumprod(np.full(64, _BASE, np.uint64))
        values = np.where(letter, codes * power[np.clip(place, 0, 63)], np.uint64(0))
        words = np.add.reduceat(values, first) if len(first) else np.zeros(0, np.uint64)
        words = ((words * np.uint64(0x9E3779B97F4A7C15)) >> top).astype(np.int32) + np.int32(len(self.grams) << self.bits)
        out.append((words, np.searchsorted(first, starts)))
        n_words = np.diff(np.append(out[-1][1], len(first)))
        n_chars = np.add.reduceat(letter.astype(np.int64), starts)
        return out, np.stack([n_words, n_chars], 1).astype(np.float64)


def _sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows from each start to the next; 0 where a stretch is empty."""
    if not len(rows):
        return np.zeros((len(starts), rows.shape[1]), rows.dtype)
    ends = np.append(starts[1:], len(rows))
    out = np.add.reduceat(rows, np.minimum(starts, len(rows) - 1), 0)
    out[ends == starts] = 0
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class ReadingModel:
    """Levels of texts: a regularised softmax model over the hashed features of each sentence, and a calibrated model over a text's sentence-level distribution.

    ``fit`` takes a bounded list of labelled texts (on the driver); ``distribution`` gives sentence levels averaged over each text
    (by words), ``levels`` the calibrated level.
    """

    def __init__(self, bits: int = 15, ridge: float = 3e-3, rounds: int = 25, folds: int = 3):
        self.features, self.ridge, self.rounds, self.folds = Features(bits), ridge, rounds, folds

    def _flat(self, sents: list[str]):
        """Sparse rows: (row, column, value) with each family scaled to unit weight per sentence, and two numbers on length."""
        families, size = self.features.index(sents)
        rows, cols, vals = [], [], []
        for h, starts in families:
            n = np.diff(np.append(starts, len(h)))
            rows.append(np.repeat(np.arange(len(sents)), n))
            cols.append(h)
            vals.append(np.repeat(1 / np.sqrt(np.maximum(n, 1)), n))
        return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals), self._shape(size)

    @staticmethod
    def _shape(size: np.ndarray) -> np.ndarray:
        words, chars = np.maximum(size[:, 0], 1), size[:, 1]
        return np.stack([np.log(words) - 2.5, chars / words - 5.5, np.ones(len(size))], 1)

    def _softmax_fit(self, flat, y: np.ndarray, weight: np.ndarray, pick: np.ndarray):
        row, col, val, shape = flat
        use = pick[row]
        row, col, val = row[use], col[use], val[use]
        n, k = len(y), self.k
        w, v = np.zeros((self.features.size, k)), np.zeros((shape.shape[1], k))
        target = np.eye(k)[y] * weight[:, None] * pick[:, None]
        total = (weight * pick).sum()
        # Nesterov steps; the features of a sentence have a squared length of about 4, which bounds the curvature.
        w_old, v_old, step = w.copy(), v.copy(), 0.7
        for t in range(self.rounds):
            m = t / (t + 3)
            wm, vm = w + m * (w - w_old), v + m * (v - v_old)
            z = np.stack([np.bincount(row, wm[col, c] * val, n) for c in range(k)], 1) + shape @ vm
            g = (_softmax(z) * (weight * pick)[:, None] - target) / total
            gw = np.stack([np.bincount(col, g[row, c] * val, len(w)) for c in range(k)], 1) + self.ridge * wm
            w_old, v_old = w, v
            w, v = wm - step * gw, vm - 0.3 * step * (shape.T @ g + 1e-3 * vm)
        return w, v

    def _sentence_levels(self, sents: list[str], w: np.ndarray, v: np.ndarray) -> np.ndarray:
        families, size = self.features.index(sents)
        z = self._shape(size) @ v
        for h, starts in families:
            n = np.diff(np.append(starts, len(h)))
            z += _sums(w[h], starts) / np.sqrt(np.maximum(n, 1))[:, None]
        return _softmax(z)

    @staticmethod
    def _gather(levels: np.ndarray, words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        out = np.stack([np.bincount(owner, levels[:, c] * words, n) for c in range(levels.shape[1])], 1)
        return out / np.maximum(out.sum(1, keepdims=True), 1e-9)

    @staticmethod
    def _doc_features(d: np.ndarray) -> np.ndarray:
        mean = d @ np.arange(d.shape[1])
        return np.concatenate([d, np.log(d + 0.02), mean[:, None], np.ones((len(d), 1))], 1)

    def fit(self, texts: Sequence[str], levels: Sequence[int], seed: int = 5) -> "ReadingModel":
        self.k = k = max(levels)
        y_doc = np.asarray(levels) - 1
        each = [sentences(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in each])
        sents = [s for e in each for s in e]
        words = np.array([s.count(" ") + 1 for s in sents], float)
        flat, y = self._flat(sents), y_doc[owner]
        fold = np.random.default_rng(seed).permutation(len(texts)) % self.folds
        held = np.zeros((len(sents), k))
        for f in range(self.folds):
            w, v = self._softmax_fit(flat, y, words, (fold[owner] != f).astype(float) > 0)
            test = np.flatnonzero(fold[owner] == f)
            held[test] = self._sentence_levels([sents[i] for i in test], w, v)
        self.w, self.v = (a.astype(np.float32) for a in self._softmax_fit(flat, y, words, np.ones(len(sents), bool)))
        # Calibration on distributions of texts that the sentence model hadn't seen.
        x = self._doc_features(self._gather(held, words, owner, len(texts)))
        b = np.zeros((x.shape[1], k))
        for _ in range(3000):
            slope = x.T @ (_softmax(x @ b) - np.eye(k)[y_doc]) / len(x) + 1e-3 * b
            b -= 0.05 * slope
            if np.abs(slope).max() < 1e-5:
                break
        self.b, self.held_out = b, float((np.argmax(x @ b, 1) == y_doc).mean())
        return self

    def levels(self, texts: Sequence[str]) -> np.ndarray:
        each = [sentences(t) for t in texts]
        sents = [s for e in each for s in e]
        if not sents:
            return np.ones(len(texts), int)
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in each])
        words = np.array([s.count(" ") + 1 for s in sents], float)
        d = self._gather(self._sentence_levels(sents, self.w, self.v), words, owner, len(texts))
        return np.argmax(self._doc_features(d) @ self.b, 1) + 1


def fit_reading_model(graded: DataFrame, text: str, level: str, max_rows: int = 20_000, **options) -> ReadingModel:
    """Fits on at most ``max_rows`` labelled texts (rows without a text or level are left out; the order is by hash, so the sample is fair and fixed)."""
    rows = graded.select(F.col(text).alias("t"), F.col(level).cast("int").alias("l")).where("t is not null and t <> '' and l > 0")
    rows = rows.orderBy(F.xxhash64("t"), "l").limit(max_rows).collect()
    return ReadingModel(**options).fit([r.t for r in rows], [r.l for r in rows])


def reading_levels(df: DataFrame, key: str, text: str, model: ReadingModel) -> DataFrame:
    """``key, reading_level`` of every row with a text. Whole texts are read, in Arrow batches; null and empty texts give no row; a text without a Latin word level 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b in slices(pdf["text"].tolist()):
                part = pdf.iloc[a:b]
                yield pd.DataFrame({"key": part["key"].to_numpy(), "reading_level": model.levels(part["text"].tolist()).astype("int32")})

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null and text <> ''")
    kind = dict(rows.dtypes)["key"]
    return rows.mapInPandas(run, f"key {kind}, reading_level int")
