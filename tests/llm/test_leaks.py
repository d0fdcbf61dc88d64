import random

import numpy as np
import pytest

from loamgrid.llm.leaks import LeakSearch, WuManber, _chain, carried, words_of

WORDS = [a + b for a in "ba ce di fo gu ka le mi no pu ra se".split() for b in "bel dor fin gam hup jek lom nar pid rus".split()]


def _sentence(rng, n=9):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def _text(rng, n=8):
    return " ".join(_sentence(rng) for _ in range(n))


def test_search_finds_every_window():
    rng = random.Random(1)
    small = WORDS[:6]
    for m in (3, 4, 5):
        passages = [[rng.choice(small) for _ in range(rng.randrange(1, 30))] for _ in range(6)]
        engine = WuManber(passages, m)
        texts = [[rng.choice(small + ["other"]) for _ in range(rng.randrange(0, 200))] for _ in range(30)]
        coded = [engine.code(t) for t in texts]
        ends = np.cumsum([len(c) for c in coded])
        starts = ends - [len(c) for c in coded]
        at, pattern = engine.search(np.array([x for c in coded for x in c], np.int64), starts, ends)
        windows = {tuple(p[k : k + m]) for p in passages for k in range(len(p) - m + 1)}
        want = sorted(int(s) + k for s, t in zip(starts, texts, strict=True) for k in range(len(t) - m + 1) if tuple(t[k : k + m]) in windows)
        assert sorted(at.tolist()) == want
        flat = [w for t in texts for w in t]
        names = {v: k for k, v in engine.vocabulary.items()}
        assert all(flat[a : a + m] == [names[x] for x in engine.patterns[p]] for a, p in zip(at.tolist(), pattern.tolist(), strict=True))


def test_words_are_the_same_in_every_dress():
    plain = "the first classification will cover 7 deciduous fields"
    dressed = [
        "The FIRST, classification will\ncover 7 deciduous fields!", "<p>The&nbsp;<b>first</b> classification will cover&#32;7 deciduous fields</p>", "> the first classi-\n> fication will cover 7 deci-\n  duous fields",
        "The first сlаssifiсаtiоn will соvеr 7 deciduous fields", "The ｆｉｒｓｔ classi­fication will co​ver 7 deciduous fields", "the ﬁrst classiﬁcation will cover 7 deciduous fields",
        '{"a": "The first\\nclassification will cover 7 decid\\u0075ous fields"}', "* the **first** classification_will cover 7 deciduous fields",
    ]
    for d in dressed:
        got = words_of(d)
        assert " ".join(got[1:] if d[0] == "{" else got) == plain, d


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    public = _sentence(rng, 14)
    items = [(i, (public + " " if i % 4 == 0 else "") + _text(rng)) for i in range(1, 25)] + [(100, None), (101, ""), (102, "two words")]
    passage = dict(items)
    docs, want, add = [], set(), lambda t, leak=None: (docs.append((len(docs), t)), leak and want.add((len(docs) - 1, leak)))
    for _ in range(150):
        add(_text(rng, 6))
    for i in range(1, 13):
        w = passage[i].split()
        add(f"{_text(rng, 3)} {passage[i]} {_text(rng, 2)}", i)
        add(f"{_text(rng, 2)} {' '.join(w[len(w) // 2:])}", i)
        noisy = [rng.choice(WORDS) if rng.random() < 0.07 else x for x in w if rng.random() > 0.04]
        add(" ".join(noisy).upper() + _text(rng, 3), i)
        s = [x + "." for x in passage[i].split(". ")]
        add(" ".join(_sentence(rng) + " " + x for x in s), i)  # in pieces of a sentence
        add(" ".join(rng.sample(w, len(w))) + _text(rng, 2))  # other order
        add(" ".join(w[-10:]) + " " + _text(rng, 4))  # one short piece
    for _ in range(12):
        add(public + " " + _text(rng, 3))
    add(None), add(""), add(passage[20] * 400, 20)
    return docs, items, want


def test_leaks_of_every_kind(spark, corpus):
    docs, items, want = corpus
    d = spark.createDataFrame([(*x, "c", 1) for x in docs], "doc_id long, text string, item string, n int")
    i = spark.createDataFrame([(*x, "q") for x in items], "item_id long, passage string, text string")
    got = [(r.doc_id, r.item_id) for r in LeakSearch(d, "doc_id", "text", i, "item_id", "passage", public=0.03).leaks().collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, passage string")
    assert LeakSearch(d, "doc_id", "text", i, "item_id", "passage").leaks().count() == 0
    d = spark.createDataFrame([(1, "one two three four five six seven"), (2, "x " * 200_000)], "doc_id long, text string")
    assert LeakSearch(d, "doc_id", "text", i.limit(0), "item_id", "passage").leaks().count() == 0
    assert [tuple(r)[:2] for r in LeakSearch(d, "doc_id", "text", i, "item_id", "passage").leaks().collect()] == [(1, 1)]


def test_copies_of_a_partial_leak_are_not_public(spark):
    rng = random.Random(8)
    public = _sentence(rng, 14)
    items = [(i, public + " " + _text(rng)) for i in range(1, 5)]
    docs = [_text(rng, 6) for _ in range(130)] + [f"{public} {_text(rng, 3)}" for _ in range(20)]
    w = items[0][1].split()
    leak = f"{_text(rng, 2)} {' '.join(w[20:58])} {_text(rng, 2)}"  # 38 of 86 words
    copies = [leak if k % 2 else f"<p>{leak.upper()}</p>" for k in range(80)]
    other = f"{_text(rng, 3)} {' '.join(w[18:58])}"
    d = spark.createDataFrame(list(enumerate([*copies, other, *docs])), "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, passage string")
    got = [(r.doc_id, r.item_id) for r in LeakSearch(d, "doc_id", "text", i, "item_id", "passage").leaks().collect()]
    assert sorted(got) == [(k, 1) for k in range(81)]


def test_chain_against_brute_force():
    rng = random.Random(9)
    for _ in range(150):
        m, text, passage = rng.choice([2, 3]), [rng.randrange(3) for _ in range(rng.randrange(3, 40))], [rng.randrange(3) for _ in range(rng.randrange(3, 14))]
        hits = [(t, k) for t in range(len(text) - m + 1) for k in range(len(passage) - m + 1) if text[t : t + m] == passage[k : k + m]]
        if not hits:
            continue
        covered = {(t + x, k + x) for t, k in hits for x in range(m)}
        best = np.zeros((len(text) + 1, len(passage) + 1), int)
        for t in range(len(text)):
            for k in range(len(passage)):
                best[t + 1, k + 1] = max(best[t, k + 1], best[t + 1, k], best[t, k] + ((t, k) in covered))
        pairs = [(d + x, p + x) for d, p, n in _chain(np.array(hits), m, len(passage)) for x in range(n)]
        assert set(pairs) <= covered and len(pairs) == best[-1, -1]
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))


def test_leak_behind_many_repeated_openings():
    # 450 copies of the opening and then six pieces of eight words between wrong ones: more segments than any fixed number.
    passage = np.arange(1, 101)
    text = [x for _ in range(450) for x in [*range(1, 15), 0, 0, 0]]
    for k in range(6):
        text += [*range(20 + 13 * k, 28 + 13 * k), *[0] * 15]
    text = np.array(text)
    hits = np.array([(t, text[t] - 1) for t in range(len(text) - 3) if text[t] and (np.diff(text[t : t + 4]) == 1).all()])
    got = {p for p, _ in carried(text, passage, hits, 4)}
    assert got == {*range(14), *(19 + 13 * k + x for k in range(6) for x in range(8))}


def test_items_in_blocks_equal_passages_and_shared_sentences(spark):
    # Thirty passages open with one sentence, two items have equal passages; block by block the answer is the same.
    rng = random.Random(12)
    shared = _sentence(rng, 12)
    items = [(k, f"{shared} {_text(rng, 3)}") for k in range(30)] + [(90, None), (91, ""), (92, "three short words")]
    items.append((50, items[3][1]))
    docs = [(k, f"{_text(rng, 2)} {items[k][1]} {_text(rng, 2)}") for k in range(0, 30, 3)] + [(100 + k, f"{shared} {_text(rng, 4)}") for k in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, passage string")
    want = sorted([(k, k) for k in range(0, 30, 3)] + [(3, 50)])
    for block in (50_000, 7):
        got = [(r.doc_id, r.item_id) for r in LeakSearch(d, "doc_id", "text", i, "item_id", "passage", block_items=block).leaks().collect()]
        assert sorted(got) == want


def test_search_finds_every_window():
    rng = random.Random(13)
    for _ in range(40):
        passages = [[str(rng.randrange(6)) for _ in range(rng.randrange(2, 14))] for _ in range(rng.randrange(1, 12))]
        engine = WuManber(passages, 4)
        texts = [engine.code([str(rng.randrange(7)) for _ in range(rng.choice([0, 2, 4, 60, 5000]))]) for _ in range(4)]
        text = np.array([x for t in texts for x in t], np.int64)
        ends = np.cumsum([len(t) for t in texts])
        at, pattern = engine.search(text, ends - [len(t) for t in texts], ends)
        known = {tuple(p.tolist()) for p in engine.patterns}
        start = ends - [len(t) for t in texts]
        want = [s + k for t, s in zip(texts, start, strict=True) for k in range(len(t) - 3) if tuple(t[k : k + 4]) in known]
        assert at.tolist() == want
        assert all(tuple(text[a : a + 4].tolist()) == tuple(engine.patterns[p].tolist()) for a, p in zip(at, pattern, strict=True))


def test_long_tags_are_no_words():
    assert words_of(f'one <a href="{"x" * 900}" title="two"> three') == ["one", "three"]
