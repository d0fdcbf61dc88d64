import itertools
import random
from collections import Counter, defaultdict

from loamgrid.llm.packing import Packing, _encoding, container_patterns, optimal_buckets

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _padding(hist, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in hist.items())


def test_buckets_are_optimal():
    rng = random.Random(1)
    for _ in range(20):
        hist = {rng.randrange(1, 60): rng.randrange(1, 9) for _ in range(9)}
        for k in (1, 2, 3, 20):
            got = optimal_buckets(hist, k)
            best = min(_padding(hist, [*c, max(hist)]) for m in range(min(k, len(hist))) for c in itertools.combinations(sorted(hist)[:-1], m))
            assert len(got) <= k and got == sorted(got) and _padding(hist, got) == best
    assert optimal_buckets({}, 4) == []


def test_patterns_hold_everything():
    rng = random.Random(2)
    for _ in range(30):
        bounds = sorted(rng.sample(range(1, 101), 7))
        counts = [rng.randrange(0, 5000) for _ in bounds]
        got = container_patterns(bounds, counts, 100, mixed=True)
        used = Counter()
        for repeat, pattern in got:
            assert repeat > 0 and sum(m * bounds[j] for j, m in pattern) <= 100
            for j, m in pattern:
                used[j] += repeat * m
        assert [used[j] for j in range(7)] == counts
        # First-fit decreasing: within 11/9 of the total length.
        assert sum(r for r, _ in got) <= 11 / 9 * max(1, sum(b * n for b, n in zip(bounds, counts, strict=True)) / 100) * 1.3 + 2


def test_containers(spark):
    rng = random.Random(3)
    texts = ["crop " * rng.choice([3, 3, 3, rng.randrange(1, 120)]) for _ in range(700)] + ["", None, "water " * 1000, "x" * 30_000, "leaf " * 64]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)] + [(5, texts[5], "copy", 1)], "doc_id long, text string, bucket string, length int")
    p = Packing(df, "doc_id", "text", RANKS, capacity=64, buckets=16, part_rows=50)
    rows = p.containers(mixed=True).collect()
    enc = _encoding(RANKS)
    size = {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    fill, pieces = Counter(), defaultdict(list)
    for r in rows:
        fill[r.container_id] += r.length
        pieces[r.key].append((r.start, r.length))
    assert max(fill.values()) <= 64 and set(fill) == set(range(len(fill)))
    for i, n in size.items():
        copies = 2 if i == 5 else 1
        assert sum(k for _, k in pieces[i]) == n * copies
        assert len(pieces[i]) == copies * -(-n // 64)
    assert sum(fill.values()) / (64 * len(fill)) > 0.93
    assert {r.key for r in p.split_items().collect()} == {i for i, n in size.items() if n > 64}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    p = Packing(df, "doc_id", "text", RANKS)
    assert p.containers().count() == 0 and p.split_items().count() == 0
    assert Packing(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string"), "doc_id", "text", RANKS).containers().count() == 0


def test_found_comes_from_the_containers(spark, tmp_path, monkeypatch):
    from loamgrid.llm.queries import p7_found

    texts = ["crop " * n for n in (1, 100, 2040, 2100, 5000, 9000)] + ["", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    calls, whole = [], Packing.containers
    monkeypatch.setattr(Packing, "containers", lambda self, **k: calls.append(1) or whole(self, **k))
    assert sorted(r.doc_id for r in p7_found(spark, str(tmp_path)).collect()) == [3, 4, 5]
    assert calls


def test_batches_of_one_bucket(spark):
    rng = random.Random(6)
    bounds = sorted(rng.sample(range(1, 101), 7))
    counts = [rng.randrange(0, 500) for _ in bounds]
    for repeat, pattern in container_patterns(bounds, counts, 100):
        ((j, m),) = pattern
        assert repeat > 0 and m * bounds[j] <= 100
    df = spark.createDataFrame([(i, "crop " * rng.randrange(1, 60)) for i in range(400)], "doc_id long, text string")
    rows = Packing(df, "doc_id", "text", RANKS, capacity=64, buckets=8, part_rows=50).containers().collect()
    longest, total = {}, Counter()
    for r in rows:
        total[r.container_id] += r.length
        longest[r.container_id] = max(longest.get(r.container_id, 0), r.length)
    assert max(total.values()) <= 64 and len(rows) == 400
    assert len({r.container_id for r in rows}) == len(total) == max(total) + 1
