"""Periodic runs against a plain search by period, on odd rows and empty tables."""

import random
import zlib
from fractions import Fraction

import brute
import numpy as np
import pytest

from reelmark.llm import queries
from reelmark.llm.periodic_runs import CommonPrefixes, collapse_runs, next_smaller, runs_of_texts


def plain_runs(w, least=24, times=3):
    """Every period in turn: stretches of words alike with those before, but those that a shorter period has whole."""
    found, codes = {}, np.unique(np.array(w, object), return_inverse=True)[1] if w else np.zeros(0, int)
    for q in range(1, len(w) // times + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], codes[q:] == codes[:-q], [0]]).astype(int))).tolist()
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a + q >= max(least, times * q):
                found.setdefault((a, b - a + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic(rng, n, vocabulary):
    w = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(3, 11)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize(("least", "times"), [(24, 3), (6, 2), (2, 2), (10, 4)])
def test_runs_random(least, times):
    rng = random.Random(least)
    for _ in range(60):
        texts = [periodic(rng, rng.randrange(150), rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 7))]
        got = runs_of_texts([[x.encode() for x in w] for w in texts], least, times)
        assert [[tuple(r) for r in x.tolist()] for x in got] == [plain_runs(w, least, times) for w in texts]


def test_parts_of_the_theorem():
    rng = random.Random(5)
    s = np.array([0, *(rng.randrange(2, 4) for _ in range(200)), 1])
    cp = CommonPrefixes(s)
    assert cp.rank.tolist() == np.argsort(sorted(range(len(s)), key=lambda i: s[i:].tolist())).tolist()
    for _ in range(300):
        i, j = rng.sample(range(len(s)), 2)
        n = next(k for k in range(len(s)) if i + k >= len(s) or j + k >= len(s) or s[i + k] != s[j + k])
        assert cp.at(np.array([i]), np.array([j]))[0] == n
    values = [rng.randrange(50) for _ in range(200)]
    assert next_smaller(values).tolist() == [next((j for j in range(i + 1, 200) if values[j] < values[i]), 200) for i in range(200)]


def test_collapse_odd(spark, odd_docs, no_docs):
    docs = odd_docs.select("*", *(odd_docs["n_chars"].alias(c) for c in ("RUNS", "collapsed", "a`b.c")))
    out = collapse_runs(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "items", "quality_score", "a`b.c", "n_words", "runs", "collapsed"]
    want = []
    for r in odd_docs.collect():
        w = brute_words(r["text"])
        want.append((r["doc_id"], r["source"], len(w), runs := plain_runs(w), collapsed(w, runs)))
    got = [(r["doc_id"], r["source"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert collapse_runs(no_docs).count() == 0


def brute_words(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_long_and_repeated_texts(spark):
    """A text of over a megabyte with a period of 1000 words, and a hot group of one text."""
    rng = random.Random(3)
    base = brute.random_words(rng, 1000)
    text = " ".join([*base * 180, "end"])
    docs = spark.createDataFrame([(1, text), *((i, "tick tock\t" * 20) for i in range(2, 400)), (400, "no-break space " * 30)], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in collapse_runs(docs).collect()}
    assert [tuple(x) for x in rows[1]["runs"]] == [(0, 180_000, 1000)] and rows[1]["collapsed"] == " ".join([*base, "end"])
    assert all([tuple(x) for x in rows[i]["runs"]] == [(0, 40, 2)] and rows[i]["collapsed"] == "tick tock" for i in range(2, 400))
    assert rows[400]["collapsed"] == "no-break space"


def test_query(spark, small):
    """The registered query against its definition, word by word."""
    want = []
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        w = brute_words(r["text"])
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        milli = best[1] * 1000 // best[2] if runs else None
        want.append((r["doc_id"], len(runs), *best, milli, brute.sha("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()), brute.sha(collapsed(w, runs).encode())))
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, small).collect()]
    assert sorted(got) == sorted(want)
    assert sum(x[1] > 0 for x in want) > 5
