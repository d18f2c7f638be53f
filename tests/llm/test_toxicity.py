"""Compression distance held against plain loops, and the sample's rules."""

import math
import random

import numpy as np
import pytest

from gridloom.llm import op3_toxicity as m


def _made(n=240, seed=3):
    r = random.Random(seed)
    plain = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(2000)]
    rude = ["worthless", "stupidity", "disgusting"]
    out = []
    for i in range(n):
        w = [r.choice(plain) for _ in range(r.randint(1, 150))]
        for _ in range(4 * (i % 3 == 0)):
            w.insert(r.randrange(len(w) + 1), r.choice(rude))
        out.append((" ".join(w), int(i % 3 == 0)))
    return out


@pytest.fixture(scope="module")
def fitted():
    rows = _made()
    return m.fit([t for t, _ in rows], [y for _, y in rows], 0.2)


def test_score_equals_a_loop_over_windows(fitted):
    texts = [None, "", " \n", "one", "One TWO three", "worthless stupidity " * 40, "ü漢 " * 9, "x" * 30_000, *(t for t, _ in _made(20, 9))]
    packers = [m._compressor(c) for c in (fitted.ordinary, fitted.toxic)]
    want = []
    for t in texts:
        words = (t or "").encode().lower().split()
        gains = []
        for i in range(0, len(words), 2):
            x = b" " + b" ".join(words[i : i + 2]) + b" " + m.TAIL
            gains.append(len(packers[0].compress(x)) - len(packers[1].compress(x)))
        z = [math.log((sum(g >= k for g in gains) + 0.5) / (len(gains) * s + 0.5)) for k, s in zip(m.GAINS, fitted.shares, strict=True)]
        z += [math.log(len(gains) + 3), 1]
        want.append(1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(z, fitted.weights, strict=True)))))))
    got = fitted.score([m._words(t) for t in texts])
    assert np.abs(got - np.array(want)).max() < 1e-9
    assert got[5] > 0.9 > got[4]


def test_both_dictionaries_share_what_is_ordinary(fitted):
    n = m.OWN_BYTES
    assert fitted.toxic[:-n] == fitted.ordinary[:-n]
    assert b"worthless" in fitted.toxic[-n:]
    assert b"worthless" not in fitted.ordinary


def test_cutoff_keeps_unseen_ordinary_rows(fitted):
    rows = _made(300, 11)
    s = fitted.score([m._words(t) for t, _ in rows])
    y = np.array([y for _, y in rows])
    assert np.mean(s[y == 0] < fitted.cutoff) > 0.95
    assert np.mean(s[y == 1] >= fitted.cutoff) > 0.9


@pytest.mark.parametrize("toxic", [[], [0, 0], [1, 1], [0, 1], [None, 1], [2, 0]])
def test_fit_on_few_rows(toxic):
    model = m.fit(["a b c", None][: len(toxic)], toxic)
    s = model.score([m._words(t) for t in (None, "", "a b c", "worthless")])
    assert ((s >= 0) & (s <= 1)).all()


def test_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "b", "x"), (1, "a", "x"), (2, None, "x"), (3, "ccc", "x"), (4, "dddd", "x"), (None, "e", "x"), (5, "f" * 100, "x")], "doc_id long, text string, _toxic string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, None), (3, 0), (4, 7), (None, 1), (5, 1), (9, 1)], "doc_id long, toxic int")
    import zlib

    free = [i for i in (1, 2, 3, 5, 9) if zlib.crc32(str(i).encode()) % 4 != 2]
    texts, toxic, share = m.sample(docs, labels)
    want = {1: ("a", 1), 3: ("ccc", 0), 5: ("f" * 100, 1)}
    assert sorted(zip(texts, toxic, strict=True)) == sorted(want[i] for i in free if i in want)
    assert share == sum(i != 3 for i in free) / len(free)
    monkeypatch.setattr(m, "SAMPLE_CHARS", 50)
    assert sum(map(len, m.sample(docs, labels)[0])) <= 50
    assert m.sample(docs.limit(0), labels.limit(0)) == ([], [], 0.0)
