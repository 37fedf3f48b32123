import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from bagloom.llm import suffixes


def naive(t):
    return sorted(range(len(t)), key=lambda i: bytes(t[i:]))


@pytest.mark.parametrize("seed", range(30))
def test_suffix_array_and_prefixes(seed):
    r = random.Random(seed)
    kind = seed % 5
    n = r.randint(0, 400)
    sigma = [1, 2, 4, 26, 200][kind]
    t = [r.randrange(sigma) for _ in range(n)]
    if kind == 3 and n > 60:
        t = t[:50] * 4 + t
    a = np.array(t, np.uint8)
    sa = suffixes.suffix_array(a)
    assert sa.tolist() == naive(t)
    plcp, phi = suffixes.common_prefixes(a, sa)
    for x, y in zip(sa.tolist(), sa.tolist()[1:]):
        k = 0
        while max(x, y) + k < len(t) and t[x + k] == t[y + k]:
            k += 1
        assert (plcp[y], phi[y]) == (k, x)


def test_large_alphabets(monkeypatch):
    monkeypatch.setattr(suffixes, "ALPHABET", 3)
    r = random.Random(5)
    t = [r.randrange(6) for _ in range(300)] * 2
    assert suffixes.suffix_array(np.array(t)).tolist() == naive(t)


@pytest.mark.parametrize("seed", range(12))
def test_both_scans_agree_at_every_level(seed, monkeypatch):
    r = random.Random(seed)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 6))) for _ in range(40)]
    text = np.frombuffer(" ".join(r.choice(words) for _ in range(r.randint(1, 900))).encode() * (1 + seed % 3), np.uint8)
    levels = []
    own = suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda t: levels.append(len(t)) or own(t))
    expected = naive(text.tolist())
    for alphabet in (10**9, 512, 20, 0):
        monkeypatch.setattr(suffixes, "ALPHABET", alphabet)
        assert own(text).tolist() == expected
    assert len(levels) >= 4 or len(text) < 100


def brute(docs, length=200):
    seen = Counter()
    raws = [(t or "").encode() for _, t in docs]
    for raw in raws:
        seen.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = []
    for (doc, _), raw in zip(docs, raws):
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def made(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(60), text(18)
    docs = [text(r.randint(0, 120)) for _ in range(25)]
    docs += [text(20) + " " + passage + " " + text(r.randint(0, 30)) for _ in range(6)]
    docs += [text(30) + line + text(40) for _ in range(5)]
    base = text(150).split(" ")
    for _ in range(8):
        own = list(base)
        own[r.randrange(150)] = "X" + word()
        docs.append(" ".join(own))
    docs += [docs[3], docs[3], docs[-1], "", None, "a" * 199, "ab" * 300, "ab" * 150 + "c", "z" * 900, text(5) + "z" * 201, passage + "." + passage]
    return list(enumerate(docs)) + [(0, docs[0]), (None, "tiny")]


@pytest.mark.parametrize(("seed", "hot"), [(1, 20_000), (2, 3), (3, 1)])
def test_against_all_windows(spark, seed, hot, monkeypatch):
    docs = made(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, chunk string").repartition(4)
    assert sorted(map(tuple, suffixes.remove_repeats(df, hot).collect()), key=repr) == brute(docs)


def test_empty_table(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
