"""Spelling variants against a comparison of all pairs, on odd rows and empty tables."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reelmark.llm import queries
from reelmark.llm.spelling import Halves, last_forms, letter_runs, near_words, one_edit, spelling_variants, without_one, word_counts


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain_variants(counts, times=2):
    near = {w: [] for w in counts}
    words = sorted(counts)
    for i, a in enumerate(words):
        for b in words[:i]:
            if abs(len(a) - len(b)) <= 1 and distance(a, b) == 1:
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, form[w], counts.get(form[w]), len(near[w]), root))
    return sorted(out)


def random_counts(rng, n, letters="abé"):
    return {"".join(rng.choices(letters, k=rng.randrange(5, 9))): rng.choice([3, 4, 8, 20, 100]) for _ in range(n)}


def test_one_edit():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randrange(1, 6))) for _ in range(2))
        assert one_edit(a, b) == (distance(a, b) == 1)


@pytest.mark.parametrize("few", [0, 32, 10**9])
def test_halves_find_every_near_word_once(monkeypatch, few):
    monkeypatch.setattr(Halves, "FEW", few)
    monkeypatch.setattr(Halves, "CELLS", 100)
    rng = random.Random(2)
    counts = random_counts(rng, 250)
    halves = Halves((s, h, w, n) for w, n in counts.items() for s, h in enumerate((w[: len(w) // 2], w[len(w) // 2 :])))
    want = {w: [(-n, o) for o, n in counts.items() if distance(o, w) == 1] for w in counts}
    assert halves.near(counts) == {w: (len(near), min(near)) for w, near in want.items() if near}
    assert Halves(()).near(["nothing"]) == {}


@pytest.mark.parametrize(("a_shard", "a_segment"), [(200_000, 20_000), (50, 3)])
def test_variants_random(spark, a_shard, a_segment):
    """Also with segments dealt over many shards: all words share one beginning or end."""
    rng = random.Random(a_segment)
    counts = random_counts(rng, 300) | {"stem" + w: n for w, n in random_counts(rng, 60).items()} | {w + "stem": n for w, n in random_counts(rng, 60).items()}
    df = spark.createDataFrame([*counts.items()], "word string, n bigint")
    got = [tuple(r) for r in spelling_variants(df, a_shard=a_shard, a_segment=a_segment).collect()]
    assert sorted(got, key=lambda r: r[0]) == plain_variants(counts)
    assert near_words(df.limit(0)).count() == 0 and spelling_variants(df.limit(0)).count() == 0


def test_odd_words(spark):
    df = spark.createDataFrame([("abcde", 9, 1), ("abcde", 12, 2), (None, 50, 3), ("abcdf", 6, None), ("abcdeé", 2, 4), ("abcd", 99, 5)], "word string, n bigint, root int")
    got = {r["word"]: tuple(r)[1:] for r in spelling_variants(df).collect()}
    assert got == {"abcde": (12, None, None, 2, "abcde"), "abcdf": (6, "abcde", 12, 1, "abcde"), "abcdeé": (2, "abcde", 12, 1, "abcde")}


def test_long_chains(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)], "word string, form string")
    assert {r["root"] for r in last_forms(chain).collect()} == {"w37"}
    assert last_forms(chain.limit(0)).count() == 0


def test_runs_and_counts(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    want = Counter(w for r in rows for w in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or "") for w in ["".join(c.lower() if c.isascii() else c for c in w)])
    runs = lambda d: d.select(F.explode(letter_runs(F.col("text"))).alias("word"))
    got = {r["word"]: r["n"] for r in word_counts(runs(odd_docs)).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert word_counts(runs(no_docs)).count() == 0
    cut = spark.createDataFrame([("aÀßz", k) for k in range(4)], "w string, k int").select(without_one(F.col("w"), F.col("k")).alias("c")).collect()
    assert [r["c"] for r in cut] == ["Àßz", "aßz", "aÀz", "aÀß"]


def test_query(spark, small):
    """The registered query's words and counts against their definition, and its forms where words are common."""
    want = Counter()
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{r['doc_id']}:{w}".encode())
            want[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    rows = queries.op11_spelling_variants(spark, small).collect()
    assert {r["word"]: r["n"] for r in rows} == want
    deleted = {}
    for w in want:
        for i in range(len(w)):
            deleted.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    for r in rows:
        w = r["word"]
        near = {o for i in range(len(w)) for o in deleted.get(w[:i] + w[i + 1 :], ()) if distance(o, w) == 1} | {o for o in deleted.get(w, ())} | {c for i in range(len(w)) if (c := w[:i] + w[i + 1 :]) in want}
        best = min(near, key=lambda o: (-want[o], o), default=None)
        form = best if best is not None and want[best] >= 2 * want[w] else None
        assert (r["n_near"], r["form"], r["form_n"]) == (len(near), form, want.get(form))
