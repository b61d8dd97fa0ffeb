"""Relative Lempel-Ziv parsing against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from mnemoweave.llm import op10_rlz
from mnemoweave.llm._words import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    low, out = {}, []
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - 12):
            if d is not None:
                low[tuple(w[i : i + 13])] = min(d, low.get(tuple(w[i : i + 13]), d))
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = {j for i in range(len(w) - 12) if d is not None and low[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(200)]
    line = lambda n: " ".join(rng.choices(vocab, k=n))
    passages = [line(n) for n in (13, 20, 60, 200)]
    out = []
    for i in range(40):
        parts = [line(rng.randint(0, 40)) for _ in range(3)] + rng.sample(passages, rng.randint(0, 3))
        rng.shuffle(parts)
        out.append((i, rng.choice(["\n", " ", "\t"]).join(parts)))
    long = line(30_000)
    words = long.split()
    out += [(50, long), (51, " ".join(words[500:9000] + words[100:700])), (52, "a b " * 4000), (53, "b a " * 3000), (54, "a b " * 10)]
    # ids that stand in several rows, with equal and with different texts
    out += [(7, out[9][1]), (7, passages[3] + " x y z"), (7, passages[2]), (60, out[3][1]), (60, out[3][1]), (60, passages[2] + " " + passages[0])]
    # a passage that several references have in part, and windows that share an anchor only
    half = passages[3].split()
    out += [(61, " ".join(half[:120])), (62, " ".join(half[90:])), (63, passages[3])]
    for i in range(64, 74):
        w = passages[2].split()
        w[rng.randrange(20, 40)] = "zz"
        out.append((i, " ".join(w)))
    return out + [(80, None), (81, ""), (82, "one two"), (None, passages[2]), (None, None)]


def test_parse_equals_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, op10_rlz.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == brute(rows)


def test_other_columns_do_not_matter(spark, rows):
    docs = spark.createDataFrame(rows[:20], "doc_id long, text string").selectExpr("doc_id", "text", "'x' anchor", "1 low", "2 row", "'y' entries")
    got = sorted(map(tuple, op10_rlz.dedup_substrings(docs).collect()), key=str)
    assert got == brute(rows[:20])


def test_factors_are_longest_matches():
    ref = Words([b"a b c d x", b"a b c d e f g", b"d e f q"])
    w = Words([b"z a b c d e f q"])
    places = np.array([0, 5])
    assert op10_rlz.longest(w, ref, 1, 8, places, np.array([5, 12])) == (6, 5)
    order, low, high = np.array([0, 5, 12]), np.array([0, 2]), np.array([2, 3])
    spans, missed = op10_rlz.factors(w, ref, np.array([1, 4]), 8, low, high, order, ref.first[1:][ref.text_of()], 3)
    assert spans == [(1, 6)] and missed == []  # the window at 4 lies inside the factor
    spans, _ = op10_rlz.factors(w, ref, np.array([1, 4]), 8, np.array([0, 2]), np.array([1, 3]), order, ref.first[1:][ref.text_of()], 3)
    assert spans == [(1, 4), (4, 4)]  # the boundary of the first factor is checked


def test_unequal_words_with_equal_hashes_are_no_match():
    ref, w = Words([b"a b c d"]), Words([b"a b x d"])
    ref.hash[:] = w.hash
    assert op10_rlz.factors(w, ref, np.array([0]), 4, np.array([0]), np.array([1]), np.array([0]), np.array([4] * 4), 3) == ([], [0])


def test_empty(spark):
    assert op10_rlz.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
