"""Evaluation passages in training texts: multi-pattern search by block shifts, then direct comparison."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.batches import slices
from loamgrid.storage import Staged

#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = str.maketrans("авеёкмнорстухіјѕԁһαεικνορτυχ", "abeekmhopctyxijsdhaeikvoptux")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\([nrt\"/\\])")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_BROKEN = re.compile(r"(?<=\w)[-\u2010\u2011][ \t]*\r?\n[\s>*#|-]*(?=[^\W\d_])")
_MARKS = re.compile("[\u0300-\u036f]")
_WORD = re.compile(r"[^\W_]+(?:[\u0900-\u0963\u0966-\u096f]+)*")
_PLAIN = re.compile(r"[a-z0-9]+")


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2]
    return chr(int(code, 16)) if code else " " if m[3] in "nrt" else m[3]


def _from_percent(m: re.Match) -> str:
    return bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")


def words_of(text: str) -> list[str]:
    """The words of a text without case, punctuation, spacing, line breaks, mark-up, escapes, look-alike letters and hidden characters."""
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "%" in text:
        text = _PERCENT.sub(_from_percent, text)
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    if not text.isascii():
        text = _HIDDEN.sub("", text)
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
        text = text.lower()
        # Whole words in another alphabet stay; single letters of it among Latin ones are look-alikes.
        text = re.sub(r"\w+", lambda m: m[0].translate(LOOKALIKES) if not m[0].isascii() and re.search("[a-z]", m[0] + m[0].translate(LOOKALIKES)) else m[0], text)
        return _WORD.findall(text)
    return _PLAIN.findall(text.lower())


#: A window that more passages than this hold is wide; a text is cut into lanes of LANE window ends, so that a very long one takes no more steps than others.
WIDE, LANE = 8, 2048


class WuManber:
    """Multi-pattern search over word numbers, run on many texts at once.

    The patterns are all windows of ``m`` words of the passages. A block is two words. ``shift``, a table addressed by the block's hash, gives how far a
    window may jump by its last block: the least distance from a pattern's end of any block with that hash, m - 1 if no pattern has one. It is
    read only for the block at which a window stands, so positions that can't match are jumped over. Where the shift is 0,
    a hash of the window selects among the patterns that end with such a block, and comparing the words confirms. Each stretch of text is a lane with its
    own position; numpy moves all lanes together.
    """

    def __init__(self, passages: Sequence[Sequence[str]], m: int = 4, least: float = 0.2):
        self.m = m
        vocabulary = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for p in passages for w in p))}
        self.vocabulary, self.base = vocabulary, np.int64(len(vocabulary) + 1)
        self.coded = [np.array([vocabulary[w] for w in p], np.int64) for p in passages]
        self.sizes = np.array([len(p) for p in passages], np.int64)
        windows = {}
        for item, p in enumerate(self.coded):
            for k in range(len(p) - m + 1):
                windows.setdefault(tuple(p[k : k + m].tolist()), []).append((item, k))
        self.patterns = np.array(list(windows), np.int64).reshape(-1, m)
        where = list(windows.values())
        self.place_start = np.concatenate(([0], np.cumsum([len(w) for w in where]))).astype(np.int64)
        self.places = np.array([x for w in where for x in w], np.int64).reshape(-1, 2)
        # Shift table: the least shift of all blocks with a hash; a hash that no block has shifts by m - 1.
        blocks = self.patterns[:, :-1] * self.base + self.patterns[:, 1:]
        far = np.broadcast_to(m - 2 - np.arange(m - 1), blocks.shape)
        self.bits = np.uint64(64 - min(24, max(12, int(blocks.size).bit_length() + 3)))
        self.shift = np.full(1 << (64 - int(self.bits)), m - 1, np.int8)
        np.minimum.at(self.shift, self._slot(blocks.ravel()), far.ravel().astype(np.int8))
        # Suffix buckets: patterns ordered by the hash of the window.
        self.hashes = self._hash([self.patterns[:, i] for i in range(m)])
        self.by_hash = np.argsort(self.hashes, kind="stable")
        self.sorted_hashes = self.hashes[self.by_hash]
        # Wide windows are looked at only beside a narrow one of the passage, unless they alone could make up the least share of it.
        many = np.array([len({i for i, _ in w}) > WIDE for w in where], bool)
        wide = np.repeat(many, np.diff(self.place_start))
        per_item = np.bincount(self.places[wide, 0], minlength=len(passages))
        alone = per_item * m >= least * self.sizes
        self.later = wide & ~alone[self.places[:, 0]] if len(wide) else wide

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits

    @staticmethod
    def _hash(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * np.uint64(0x100000001B3) + np.uint64(0x9E3779B97F4A7C15)
        return h

    def code(self, words: list[str]) -> list[int]:
        get = self.vocabulary.get
        return [get(w, 0) for w in words]

    def search(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of coded texts ``text[starts:ends]``: window positions in ``text`` and the pattern found there."""
        m, found, none = self.m, [], np.zeros(0, np.int64)
        first = starts + m - 1
        lanes = np.maximum(0, -(-(ends - first) // LANE))
        if not len(self.patterns) or not lanes.sum():
            return none, none
        nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(first, lanes) + nth * LANE
        stop = np.minimum(at + LANE, np.repeat(ends, lanes))
        while len(at):
            jump = self.shift[self._slot(text[at - 1] * self.base + text[at])]
            hit = at[jump == 0]
            if len(hit):
                found.append(hit)
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return none, none
        end = np.sort(np.concatenate(found))
        h = self._hash([text[end - (m - 1) + i] for i in range(m)])
        spot = np.minimum(np.searchsorted(self.sorted_hashes, h), len(self.sorted_hashes) - 1)
        ok = self.sorted_hashes[spot] == h
        end, pattern = end[ok], self.by_hash[spot[ok]]
        same = np.all(np.stack([text[end - (m - 1) + i] == self.patterns[pattern, i] for i in range(m)]), 0)
        return end[same] - (m - 1), pattern[same]

    def _places_of(self, which: np.ndarray, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each found pattern the places of passages that hold it, of those marked in ``which``: index into ``pattern``, row of ``places``."""
        kept = np.flatnonzero(which)
        start = np.searchsorted(kept, self.place_start)
        many = (start[1:] - start[:-1])[pattern]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(np.arange(len(pattern)), many), kept[np.repeat(start[pattern], many) + step]

    def candidates(self, lane: np.ndarray, at: np.ndarray, pattern: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``key`` (text x passages + passage), text place and passage place of all hits of those texts and passages that share enough windows."""
        n = np.int64(max(1, len(self.coded)))
        i, row = self._places_of(~self.later, pattern)
        key = lane[i] * n + self.places[row, 0]
        j, more = self._places_of(self.later, pattern[np.isin(lane, np.unique(key // n))]) if self.later.any() and len(key) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(j):
            j = np.flatnonzero(np.isin(lane, np.unique(key // n)))[j]
            also = lane[j] * n + self.places[more, 0]
            ok = np.isin(also, key)
            i, row, key = np.concatenate((i, j[ok])), np.concatenate((row, more[ok])), np.concatenate((key, also[ok]))
        # Each window covers at most m words: too few windows can't reach the least share.
        size = np.int64(max(1, self.sizes.max(initial=1)))
        distinct = np.unique(key * size + self.places[row, 1]) // size
        keys, windows = np.unique(distinct, return_counts=True)
        ok = np.isin(key, keys[windows * self.m >= least * self.sizes[keys % n]])
        key, i, row = key[ok], i[ok], row[ok]
        order = np.lexsort((self.places[row, 1], at[i], key))
        return key[order], at[i][order], self.places[row, 1][order]


def _chain(hits: np.ndarray, m: int, size: int) -> list[tuple[int, int, int]]:
    """The longest chain of matching words, rising in text and passage: segments (text place, passage place, words).

    Of all word pairs that some window covers, those of a longest rising sequence; among equally long ones, one in the fewest segments.
    Pairs are taken by text place; ``ends`` keeps, in order of the passage place, the chain ends that no earlier place matches or betters, at most
    the passage's length. So each pair costs one search in a short list, however many segments there are.
    """
    step = np.arange(m)
    keys = np.unique((hits[:, 0, None] + step) * size + size - 1 - (hits[:, 1, None] + step))
    texts, places = (keys // size).tolist(), (size - 1 - keys % size).tolist()
    word = size + 1  # a word outweighs any number of new segments
    ends, tops, owners, back, last = [], [], [], array("q"), {}
    for i, (d, p) in enumerate(zip(texts, places, strict=True)):
        at = bisect_left(ends, p)
        top, b = (tops[at - 1] - 1, owners[at - 1]) if at else (0, -1)
        # The word before on the same diagonal; within a text place the pairs come from the last passage place down.
        before, score = last.get(p - 1, (-1, 0))
        if before >= 0 and texts[before] == d - 1 and score >= top:
            top, b = score, before
        top += word
        back.append(b)
        last[p] = (i, top)
        if at and tops[at - 1] >= top:
            continue
        stop = at
        while stop < len(ends) and tops[stop] <= top:
            stop += 1
        ends[at:stop], tops[at:stop], owners[at:stop] = [p], [top], [i]
    i, chain = owners[-1], []
    while i >= 0:
        d, p = texts[i], places[i]
        if chain and chain[-1][0] == d + 1 and chain[-1][1] == p + 1:
            chain[-1] = (d, p, chain[-1][2] + 1)
        else:
            chain.append((d, p, 1))
        i = back[i]
    return chain[::-1]


def carried(doc: np.ndarray, passage: np.ndarray, hits: np.ndarray, m: int, slack: int = 12) -> list[tuple[int, int]]:
    """The words of the passage that the text carries in order: (place in passage, run) pairs.

    ``hits``: rows (text place, passage place) of matching windows. The best chain of the words they cover, rising in both, is chosen (``_chain``);
    between two chained segments at most ``slack`` words apart in both, the words of the shorter stretch that are equal
    in order count as well (around wrong, missing and added words), and the two form one run; so do such words next to a run's ends.
    """
    chain = _chain(hits, m, len(passage))
    out, run = [], 0

    def between(texts: np.ndarray, p: int, end: int) -> None:
        """Equal words in order, those of the text met one by one."""
        for x in texts:
            same = np.flatnonzero(passage[p:end] == x) if x else ()
            if len(same):
                out.append((p + int(same[0]), run))
                p += int(same[0]) + 1

    d, p, _ = chain[0]
    between(doc[max(0, d - slack) : d], max(0, p - slack), p)
    done_d, done_p = d, p
    for d, p, n in chain:
        if d - done_d <= slack and p - done_p <= slack:
            between(doc[done_d:d], done_p, p)
        else:
            between(doc[done_d : done_d + slack], done_p, min(p, done_p + slack))
            run += 1
        out += [(q, run) for q in range(p, p + n)]
        done_d, done_p = d + n, p + n
    between(doc[done_d : done_d + slack], done_p, min(len(passage), done_p + slack))
    return list(dict(out).items())


class _Items:
    """The distinct passages of one block of items, the engine that searches them and what it found."""

    def __init__(self, rows: list, m: int, least: float):
        groups: dict = {}
        for r in rows:
            groups.setdefault(tuple(words_of(r.p)), []).append(r.i)
        self.ids = list(groups.values())
        self.engine = WuManber(list(groups), m, least)
        self.hits: Staged


class LeakSearch:
    """Documents that carry evaluation passages.

    Pass 1 (Arrow batches of whole texts): words, the search, and for each document and item that shares at least ``least`` of the passage's words the carried
    places; with it the windows of each distinct text, by a hash of its words. Pass 2 (SQL and the bounded pattern list): a window is
    public where more than ``public`` of all distinct texts carry it and it is over three times as frequent as the middle window of its passage
    (copies of one text, in whatever case or mark-up, count once);
    stretches of public windows of at least ``public_words`` words never count, and a run made of public windows only is no leak.
    A leak is a document with at least ``share`` of the passage's words in runs of at least ``run_words``.

    Null and empty texts and passages leak nothing; equal documents each come out, and so do items with equal passages; an item shorter than a window can't be found.
    Items are read in blocks of about ``block_items`` (equal passages in one block), each searched in a pass of its own over the documents.
    """

    schema = "doc_id long, item int, places array<int>, runs array<int>, text long, windows array<int>"

    def __init__(self, docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, m: int = 4, least: float = 0.2, share: float = 1 / 3, public: float = 0.01, public_words: int = 10, run_words: int = 6, block_items: int = 50_000):
        self.m, self.least, self.share, self.public, self.public_words, self.run_words = m, least, share, public, public_words, run_words
        wanted = items.select(F.col(item_id).cast("long").alias("i"), F.col(passage).alias("p")).where("i is not null and p is not null")
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null and text <> ''")
        blocks = max(1, -(-wanted.count() // block_items))
        self.blocks = []
        for b in range(blocks):
            block = _Items(wanted.where(F.pmod(F.xxhash64("p"), F.lit(blocks)) == b).orderBy("i").collect(), m, least)
            block.hits = self._search(rows, block.engine)
            self.blocks.append(block)

    def _search(self, rows: DataFrame, engine: WuManber) -> Staged:
        shared, least = rows.sparkSession.sparkContext.broadcast(engine), self.least

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                ids, texts = pdf["doc_id"].to_numpy(), pdf["text"].tolist()
                for a, b in slices(texts, 4_000_000):
                    yield _search_batch(shared.value, ids[a:b], texts[a:b], least)

        return Staged(rows.mapInPandas(search, self.schema))

    def public_places(self, block: _Items) -> list[np.ndarray]:
        """Of each passage of a block, the places in windows that are public."""
        engine, m = block.engine, self.m
        df = np.zeros(len(engine.patterns))
        # A group of copies collapses map-side to one text.
        texts = Staged(block.hits.df.where("item < 0").groupBy("text").agg(F.first("windows").alias("windows")))
        # Bounded by the block's windows, whatever the corpus.
        for r in texts.df.select(F.explode("windows").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).toLocalIterator():
            df[r.pattern] = r.n
        total = texts.rows
        texts.drop()
        n_of = np.repeat(df, np.diff(engine.place_start))
        by_item = np.argsort(engine.places[:, 0], kind="stable")
        cuts = np.searchsorted(engine.places[by_item, 0], np.arange(len(engine.coded) + 1))
        out = []
        for item, words in enumerate(engine.coded):
            mine = by_item[cuts[item] : cuts[item + 1]]
            flags = np.zeros(len(words), bool)
            if len(mine):
                n = n_of[mine]
                for k in engine.places[mine, 1][(n > self.public * total) & (n > 3 * np.median(n)) & (n > 3)]:
                    flags[k : k + m] = True
            out.append(flags)
        return out

    def leaks(self) -> DataFrame:
        """``doc_id, item_id, words`` (carried) and ``share`` of the passage's words."""
        return reduce(DataFrame.unionByName, (self._judged(b) for b in self.blocks))

    def _judged(self, block: _Items) -> DataFrame:
        flags, sizes, ids = self.public_places(block), block.engine.sizes.tolist(), block.ids
        long_public = []
        for f in flags:
            keep = np.zeros(len(f), bool)
            edges = np.flatnonzero(np.diff(np.concatenate(([0], f.astype(int), [0]))))
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                keep[a:b] = b - a >= self.public_words
            long_public.append(keep)
        run_words, share = self.run_words, self.share

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for d, item, places, runs in zip(pdf["doc_id"], pdf["item"], pdf["places"], pdf["runs"], strict=True):
                    places, runs = np.asarray(places), np.asarray(runs)
                    ok = ~long_public[item][places]
                    count = np.bincount(runs, ok)
                    fresh = np.bincount(runs, ~flags[item][places])
                    n = int(count[(count >= run_words) & (fresh >= 2)].sum())
                    if n >= share * sizes[item]:
                        out += [(d, i, n, n / sizes[item]) for i in ids[item]]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "words", "share"])

        return block.hits.df.where("item >= 0").select("doc_id", "item", "places", "runs").mapInPandas(judge, "doc_id long, item_id long, words int, share double")


def _search_batch(engine: WuManber, ids: np.ndarray, texts: list[str], least: float) -> pd.DataFrame:
    coded, distinct = [], {}
    for i, t in enumerate(texts):
        words = words_of(t)
        coded.append(array("q", engine.code(words)))
        distinct[int.from_bytes(hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)] = i
    sizes = np.array([len(c) for c in coded], np.int64)
    text = np.concatenate([np.frombuffer(c, np.int64) for c in coded]) if len(coded) else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    at, pattern = engine.search(text, starts, ends)
    lane = np.searchsorted(ends, at, "right")
    # The windows of each distinct text, those without any as well: they are counted.
    span = np.int64(len(engine.patterns) + 1)
    once = np.unique(lane * span + pattern)
    cuts = np.searchsorted(once, np.arange(len(texts) + 1) * span)
    once = (once % span).tolist()
    rows = [(0, -1, None, None, h, once[cuts[i] : cuts[i + 1]]) for h, i in distinct.items()]
    key, at, place = engine.candidates(lane, at, pattern, least)
    cuts = np.concatenate((np.flatnonzero(np.diff(key, prepend=-1)), [len(key)]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        d, item = divmod(int(key[a]), len(engine.coded))
        passage = engine.coded[item]
        got = carried(text[starts[d] : ends[d]], passage, np.stack([at[a:b] - starts[d], place[a:b]], 1), engine.m)
        if len(got) >= least * len(passage):
            rows.append((int(ids[d]), item, [g[0] for g in got], [g[1] for g in got], 0, None))
    return pd.DataFrame(rows, columns=["doc_id", "item", "places", "runs", "text", "windows"])
