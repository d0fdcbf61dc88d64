import os
import random

import numpy as np
import pytest

from loamgrid.llm.reading import Features, ReadingModel, fit_reading_model, reading_levels, sentences

DATA = "/root/testdata/sf0.01/graded_texts.parquet"


def _graded(seed=1, n=160):
    rng = random.Random(seed)
    vocab = {l: ["".join(rng.choice("aeioukstrnml") for _ in range(2 + 2 * l)) for _ in range(60)] for l in (1, 2, 3, 4)}

    def one(level):
        word = lambda: rng.choice(vocab[level if rng.random() < 0.7 else rng.choice([1, 2, 3, 4])])
        return " ".join(" ".join(word() for _ in range(4 + 2 * level)).capitalize() + "." for _ in range(8))

    return [(one(l), l) for l in (1, 2, 3, 4) for _ in range(n // 4)]


def test_levels_of_unseen_texts():
    rows = _graded()
    random.Random(0).shuffle(rows)
    m = ReadingModel().fit([t for t, _ in rows[:110]], [l for _, l in rows[:110]])
    got = m.levels([t for t, _ in rows[110:]])
    assert np.mean(got == [l for _, l in rows[110:]]) > 0.9


@pytest.mark.skipif(not os.path.exists(DATA), reason="no data")
def test_held_out_accuracy_on_graded_texts(spark):
    m = fit_reading_model(spark.read.parquet(DATA), "text", "reading_level")
    assert m.held_out > 0.9  # some labels are off by one


def test_whole_words_and_grams_do_not_depend_on_neighbours():
    f = Features(bits=12)
    one, _ = f.index(["the cat sat"])
    two, size = f.index(["a dog", "the cat sat", ""])
    h, starts = two[-1]
    assert h[starts[1] : starts[2]].tolist() == one[-1][0].tolist()
    assert size.tolist() == [[2, 4], [3, 9], [0, 0]]


def test_sentences():
    assert sentences("The field is wet. About 7.5 kg i.e. a bag was used!\n\n- one two three\n- four five six") == ["the field is wet", "about kg i e a bag was used", "one two three", "four five six"]
    assert sentences("") == [] and sentences("नमस्ते 123") == []


def test_frame_with_nulls_long_and_empty(spark):
    rows = _graded(2, 40)
    m = ReadingModel(rounds=10).fit([t for t, _ in rows], [l for _, l in rows])
    df = spark.createDataFrame([(1, rows[0][0], "x"), (2, None, "x"), (3, "", "x"), (4, "12 34", "x"), (5, rows[-1][0] * 300, "x"), (1, rows[0][0], "x")], "doc_id long, text string, key string")
    got = sorted((r.key, r.reading_level) for r in reading_levels(df, "doc_id", "text", m).collect())
    assert [k for k, _ in got] == [1, 1, 4, 5] and got[0] == got[1] and got[2] == (4, 1)
    assert reading_levels(df.limit(0), "doc_id", "text", m).count() == 0
