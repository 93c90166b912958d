"""The ten operators on odd rows, empty tables and against the brute-force versions."""

import hashlib
import itertools
import math
import random

import brute
import numpy as np
import pytest
import zstandard
from brute import random_words
from pyspark.sql import functions as F

from reelmark.llm import licenses
from reelmark.llm.components import components
from reelmark.llm.decontaminate import Matchers, find_items
from reelmark.llm.language import UND, Compressors, identify, learn_dictionaries, letters
from reelmark.llm.licenses import license_blocks, scan_licenses
from reelmark.llm.line_dedup import PerfectHash, dedup_lines, folded, perfect_fold
from reelmark.llm.near_duplicates import near_duplicate_components, prefix, shingle_set
from reelmark.llm.neighbours import balanced_parts, nearest, neighbour_graph
from reelmark.llm.packing import Sums, WordCache, pack, pack_documents, plan
from reelmark.llm.quality import drawn, features, sample_features, score, train_model
from reelmark.llm.queries import tokenizer_path
from reelmark.llm.suffix_dedup import SuffixLevels, remove_repeats
from reelmark.llm.warc import WarcError, read_warc, record, records, write_warc


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(rows):
    return sorted(rows, key=repr)


# --- line dedup ------------------------------------------------------------------------------------------------------
def test_lines(odd_docs, no_docs):
    out = dedup_lines(odd_docs)
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], brute.sha(r["text"].encode())) for r in out.collect()]
    assert key(got) == key(brute.line_dedup(pairs(odd_docs)))
    assert {"source", "lang", "quality_score"} <= set(out.columns) and out.columns.count("n_lines") == 1
    assert dedup_lines(no_docs).count() == 0


def test_lines_one_hot_shard(spark):
    docs = spark.createDataFrame([(i, "the very common line\nline number %d of this" % (i // 2)) for i in range(300)], "doc_id bigint, text string")
    out = dedup_lines(docs, keys_a_shard=20)
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], brute.sha(r["text"].encode())) for r in out.collect()]
    assert key(got) == key(brute.line_dedup(pairs(docs)))


def test_repeats_of_one_id_with_different_texts(spark):
    rng = random.Random(12)
    copy, shared, plain, short = ("".join(rng.choices("abcdefgh", k=n)) for n in (90, 70, 80, 20))
    docs = [(1, copy), (2, shared), (5, copy), (5, plain), (5, "x" + shared + "y" * 9), (5, short), (5, None), (6, plain), (7, short + plain[:60])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"]).decode()) for r in remove_repeats(df).collect()]
    want = [(1, 90, 0, copy), (2, 70, 0, shared), (5, 90, 90, ""), (5, 80, 0, plain), (5, 80, 70, "x" + "y" * 9), (5, 20, 0, short), (5, 0, 0, ""), (6, 80, 80, ""), (7, 80, 60, short)]
    assert key(got) == key(want)


def test_components_of_one_id_with_different_texts(spark):
    rng = random.Random(13)
    docs = []
    for i in range(12):
        w, other = random_words(rng, 60, 3000), random_words(rng, 60, 3000)
        docs += [(10 * i, " ".join(w)), (10 * i, " ".join(other)), (10 * i + 1, " ".join([*w[:-1], "end"])), (10 * i + 2, " ".join([*other[:-1], "end"]))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r["doc_id"], r["component_id"]) for r in near_duplicate_components(df).collect()}
    assert got == {(i, i // 10 * 10) for i, _ in docs}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 5000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
    assert sorted(PerfectHash.build(keys).index(keys)) == list(range(len(keys)))


def test_perfect_hash_of_keys_alike_in_a_half():
    """128-bit keys that share a half, or both halves swapped; keys that repeat end in an error."""
    hi = np.repeat(np.array([7, 9], np.uint64), 500)
    lo = np.tile(np.arange(500, dtype=np.uint64), 2)
    for a, b in ((hi, lo), (lo, hi), (np.append(hi, np.uint64(3)), np.append(lo, np.uint64(7)))):
        fold, ph = perfect_fold(a, b)
        assert sorted(ph.index(folded(a, b, fold))) == list(range(len(a)))
    with pytest.raises(ValueError, match="distinct"):
        perfect_fold(np.append(hi, np.uint64(7)), np.append(lo, np.uint64(0)))
    with pytest.raises(ValueError, match="distinct"):
        PerfectHash.build(np.array([5, 5, 6], np.uint64), load=3)


# --- n-gram Jaccard join ---------------------------------------------------------------------------------------------
def test_components_odd(odd_docs, no_docs):
    got = [tuple(r) for r in near_duplicate_components(odd_docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert key(got) == key(brute.components(pairs(odd_docs)))
    assert near_duplicate_components(no_docs).count() == 0


def test_components_random(spark):
    rng = random.Random(2)
    docs, seeds = [], [random_words(rng, rng.randint(6, 60), 300) for _ in range(12)]
    for i in range(160):
        w = list(rng.choice(seeds))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = "new%d" % rng.randrange(5)
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = [tuple(r) for r in near_duplicate_components(df).collect()]
    assert key(got) == key(brute.components(docs))


def test_prefixes_share_enough():
    """Two sets of Jaccard 0.8 or more share as many prefix tokens as the smaller k."""
    rng = np.random.default_rng(5)
    checked = 0
    for _ in range(300):
        both = rng.integers(0, 2**62, rng.integers(8, 80))
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**62, rng.integers(0, len(both) // 8 + 1))])) for _ in range(2))
        i = len(np.intersect1d(a, b))
        if 100 * i < 80 * (len(a) + len(b) - i):
            continue
        others = {x: int(rng.integers(2, 40)) for x in both} | {x: int(rng.integers(1, 3)) for x in [*a, *b] if x not in both}
        got = []
        for s in (a, b):
            held = np.array([x for x in s if others[x] > 1])
            own, k = prefix(len(s), held, np.array([others[x] for x in held], np.int32), (80, 100))
            got.append((held[own], k))
        (pa, ka), (pb, kb) = got
        assert len(np.intersect1d(pa, pb)) >= min(ka, kb)
        checked += 1
    assert checked > 50
    assert len(prefix(100, np.arange(79), np.full(79, 2, np.int32), (80, 100))[0]) == 0


def test_shingles():
    assert len(shingle_set(b"")) == 0 == len(shingle_set(b" \n\t")) and len(shingle_set(b"a B c")) == 1
    assert (shingle_set(b"A b\nc") == shingle_set(b" a  B\tC ")).all()
    assert len(shingle_set(b"a b c d e f")) == 2 and len(shingle_set(b"a " * 100)) == 1


def test_component_search(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}


def test_ids_that_meet(spark, monkeypatch):
    """Sets, and texts, that share an id under the first seed are told apart and get others."""
    from reelmark.llm import near_duplicates, suffix_dedup

    rng = random.Random(21)
    docs = [(i, " ".join(random_words(rng, 30, 5000))) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    own, digest = near_duplicates._set_id, suffix_dedup._digest
    monkeypatch.setattr(near_duplicates, "_set_id", lambda s, seed=0: (5, own(s, seed)[1]) if seed == 0 else own(s, seed))
    monkeypatch.setattr(suffix_dedup, "_digest", lambda t, seed: (5, digest(t, seed)[1]) if seed == 0 else digest(t, seed))
    assert {(r["doc_id"], r["component_id"]) for r in near_duplicate_components(df).collect()} == {(i, i) for i, _ in docs}
    assert remove_repeats(df).filter("n_removed > 0").count() == 0


def test_components_of_a_group_that_stars_do_not_link(spark):
    """Edits of one text that is not there, far enough apart that many link through others alone; groups are dealt."""
    rng = random.Random(31)
    base = random_words(rng, 200, 9000)
    docs = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(200), rng.choice([2, 4, 5, 6])):
            w[k] = "new%d" % rng.randrange(40)
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = key(brute.components(docs))
    assert 1 < len({c for _, _, c in want}) < 150
    for rounds in (0, 2):
        assert key(tuple(r) for r in near_duplicate_components(df, star_rounds=rounds, rows_a_group=7).collect()) == want


# --- suffix arrays ---------------------------------------------------------------------------------------------------
def test_repeats_odd(odd_docs, no_docs):
    out = remove_repeats(odd_docs)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), brute.sha(bytes(r["kept"]))) for r in out.collect()]
    assert key(got) == key(brute.repeats(pairs(odd_docs)))
    assert remove_repeats(no_docs).count() == 0


def test_repeats_random(spark):
    rng = random.Random(9)
    passages = ["".join(rng.choices("ab cdé", k=rng.randint(40, 140))) for _ in range(8)]
    docs = [(i, "".join(rng.choice([*passages, "".join(rng.choices("xyz", k=9))]) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), brute.sha(bytes(r["kept"]))) for r in remove_repeats(df, places_a_shard=500).collect()]
    assert key(got) == key(brute.repeats(docs))


def test_levels_grow_geometrically():
    levels, rng = SuffixLevels(50), np.random.default_rng(1)
    for d in range(64):
        levels.add([bytes(rng.integers(0, 256, 113, dtype=np.uint8))], np.array([d]))
        sizes = [len(k) for k, _ in levels.levels]
        assert len(sizes) <= 8 and all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    assert sum(sizes) == 64 * 64


# --- decontamination -------------------------------------------------------------------------------------------------
ITEMS = [(1, "Hi"), (2, None), (3, ""), (4, "!?"), (5, "a a a a a a a a a a a"), (None, "own line of words here"), (6, "CC by CC by all rights")]


def test_hits(spark, odd_docs, no_docs):
    base = brute.words(odd_docs.filter("doc_id = 1").first()["text"])
    items = [*ITEMS, (7, " ".join(base[30:55]))]
    df = spark.createDataFrame(items, "item_id bigint, text string")
    want = key((i, n, h, f) for i, n, h, f in brute.hits(pairs(odd_docs), items))
    got = key((r["doc_id"], r["n_words"], r["hit_words"], r["items"]) for r in find_items(odd_docs, df).collect())
    assert got == want
    assert find_items(no_docs, df).count() == 0
    assert find_items(odd_docs, df.limit(0)).filter(F.size("hit_words") > 0).count() == 0


def test_hits_in_blocks(spark, odd_docs):
    big = [(k, " ".join(random_words(random.Random(k), 40))) for k in range(200)] + ITEMS
    df = spark.createDataFrame(big, "item_id bigint, text string")
    want = key((i, n, h, f) for i, n, h, f in brute.hits(pairs(odd_docs), big))
    got = key((r["doc_id"], r["n_words"], r["hit_words"], r["items"]) for r in find_items(odd_docs, df, block_bytes=20_000).collect())
    assert got == want
    for held in (1, 1000):
        out = find_items(odd_docs, df, block_bytes=2000, held_bytes=held)
        assert key((r["doc_id"], r["n_words"], r["hit_words"], r["items"]) for r in out.collect()) == want
        assert "Scan" not in "".join(x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "hits" in x)  # no table of the documents is written


def test_wu_manber_finds_what_a_scan_finds():
    rng = random.Random(4)
    for length in (1, 2, 3, 5, 10):
        for vocabulary in (3, 8):
            text = [b"w%d" % rng.randrange(vocabulary) for _ in range(600)]
            wanted = [text[k : k + length] for k in rng.sample(range(390), 4)]
            m = Matchers([(k, b" ".join(w)) for k, w in enumerate(wanted)], 10)
            text[rng.randrange(600)] = b"never"
            hit = {p for k in range(len(text) - length + 1) if text[k : k + length] in wanted for p in range(k, k + length)}
            found = {j for k in range(len(text)) for j, w in enumerate(wanted) if text[k : k + length] == w}
            assert m.search(text) == (hit, found)


def test_tables_of_a_large_benchmark():
    """About 2 MB of items: tables of some 40 bytes a word, not a hundred times the text."""
    import pickle

    rng = random.Random(3)
    some = random_words(rng, 3000, 3000)
    items = [(str(k), " ".join(rng.choices(some, k=300)).encode()) for k in range(1000)]
    m = Matchers(items, 10)
    assert len(pickle.dumps(m)) < 30 << 20
    words = items[17][1].split()
    assert m.search([b"x", *words[5:16], b"y"]) == (set(range(1, 12)), {"17"})


# --- licenses --------------------------------------------------------------------------------------------------------
def test_licenses(odd_docs, no_docs):
    got = {(r["doc_id"], r["n_words"], tuple((p["start"], p["label"]) for p in sorted(r["places"]))) for r in scan_licenses(odd_docs).collect()}
    want = {(i, *(lambda n, p: (n, tuple(p)))(*brute.phrases(t, licenses.PHRASES))) for i, t in pairs(odd_docs)}
    assert got == want
    rows = {r["doc_id"]: r for r in scan_licenses(odd_docs).collect()}
    assert rows[12]["labels"] == ["cc-by", "reserved"] and rows[12]["score"] == 1.0
    assert rows[13]["labels"] == ["apache-2.0"] and rows[13]["base_labels"] == [] and rows[4]["score"] == 0.0
    assert scan_licenses(no_docs).count() == 0


def test_license_join_finds_every_block(spark):
    rng = random.Random(3)
    docs = []
    for i in range(120):
        lines = []
        for _ in range(3):
            w = brute.words(rng.choice(licenses.TEMPLATES)[1])
            rng.shuffle(w)
            lines.append(" ".join([x for x in w if rng.random() > 0.06] + random_words(rng, rng.randint(0, 4), 30)))
        docs.append((i, "\n".join(lines)))
    docs += [(None, "Released under the MIT License"), (500, None), (501, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = []
    for i, t in docs:
        w = brute.words(t or "")
        for label, template in licenses.TEMPLATES:
            own = set(brute.words(template))
            width = -(-10 * len(brute.words(template)) // 9)
            for at, word in enumerate(w):
                block = w[at : at + width]
                if word in own and 10 * len(own.intersection(block)) >= 9 * len(own):
                    want.append((i, at, label, template, len(own.intersection(block)), " ".join(block)))
    got = [(r["doc_id"], r["start"], r["label"], r["template"], r["shared"], r["block"]) for r in license_blocks(df).collect()]
    assert key(got) == key(want) and len(want) > 100
    assert license_blocks(df, templates=()).count() == 0


def test_license_notices_across_lines(spark):
    """Notices wrapped to short lines behind comment marks, with a word put in; scattered words, over lines or in one, meet none."""
    rng = random.Random(5)
    docs, want = [], {}
    for i, (label, template) in enumerate(licenses.TEMPLATES):
        w = template.split()
        w.insert(len(w) // 2, "really")
        lines = [" ".join(w[at : at + 2]) for at in range(0, len(w), 2)] if len(w) > 5 else w
        docs.append((i, "\n# ".join([" ".join(random_words(rng, 5, 30)), *lines, " ".join(random_words(rng, 5, 30))])))
        want[i] = label
        far = [x for v in w for x in (v, *["filler"] * 30)]
        docs.append((100 + i, "\n".join(" ".join(far[at : at + 9]) for at in range(0, len(far), 9))))
        docs.append((200 + i, " ".join(far)))
    rows = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert all(label in rows[i]["labels"] and rows[i]["score"] == 1.0 for i, label in want.items())
    assert all(rows[k + i]["labels"] == [] and rows[k + i]["score"] == 0.0 for i in want for k in (100, 200))


def test_license_above_a_long_table(spark):
    """A notice whose words, one of them an indexed one, come up again all over a text of megabytes."""
    head = "Licensed under the Apache License, Version 2.0\n"
    docs = [(1, head + "0 " * 300_000), (2, "2.0 license " * 400_000 + head), (3, "0 " * 500_000), (4, "license version apache 0 " * 100 + "x " * 1000 + head + "under " * 3000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in scan_licenses(df).collect()}
    assert {i: (r["n_words"], r["labels"], r["score"]) for i, r in rows.items()} == {1: (300_008, ["apache-2.0"], 1.0), 2: (1_200_008, ["apache-2.0"], 1.0), 3: (500_000, [], 0.0), 4: (4408, ["apache-2.0"], 1.0)}
    starts = {(r["doc_id"], r["start"]) for r in license_blocks(df).select("doc_id", "start").collect()}
    assert (1, 0) in starts and (2, 1_200_000) in starts and (4, 1400) in starts and all(i != 3 for i, _ in starts)


def test_whole_notices(spark):
    """A notice with other line ends is found as a whole; with a third of its distinct words lost, it is not."""
    rng = random.Random(7)
    docs = []
    for i, (_, notice) in enumerate(licenses.NOTICES):
        w = notice.split()
        distinct = sorted(set(brute.words(notice)))
        lost = set(rng.sample(distinct, len(distinct) // 3))
        for base, left in ((0, w), (100, [x for x in w if not lost.intersection(brute.words(x))])):
            docs.append((base + i, " ".join(random_words(rng, 9, 30)) + "\n" + "\n * ".join(" ".join(left[at : at + 7]) for at in range(0, len(left), 7))))
    found = license_blocks(spark.createDataFrame(docs, "doc_id bigint, text string"), templates=licenses.NOTICES).select("doc_id", "label").distinct().collect()
    assert sorted((r[0], r[1]) for r in found) == [(i, label) for i, (label, _) in enumerate(licenses.NOTICES)]


# --- nearest neighbours ----------------------------------------------------------------------------------------------
def exact(rows, queries, k):
    good = {i: np.array(v, float) for i, v in rows if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)}
    out = []
    for q in queries:
        if q in good:
            d = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q)[:k]
            out += [(q, r + 1, i, t) for r, (t, i) in enumerate(d)]
    return out


SCHEMA = "vec_id bigint, embedding array<float>, id string, v int"


def test_nearest_odd(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4).astype(np.float32)]) for i in range(60)]
    rows += [(100 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(30)] + [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan"), 1.0, 0.0, 0.0]), (204, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (100, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA)
    got = [tuple(r) for r in nearest(df, F.col("id") % 10 == 0, k=10, least_probes=512).collect()]
    want = exact(rows, [i for i in {i for i, _ in rows if i is not None} if i % 10 == 0], 10)
    assert [(a, b, c) for a, b, c, _ in sorted(got)] == [(a, b, c) for a, b, c, _ in sorted(want)]
    assert np.allclose([r[3] for r in sorted(got)], [r[3] for r in sorted(want)], atol=0, rtol=1e-15)
    routed = nearest(df, F.col("id") % 10 == 0, k=10).groupBy("query_id").count().collect()
    assert len(routed) == len({r[0] for r in want}) and all(r[1] == 10 for r in routed)
    assert nearest(df.limit(0), F.col("id") % 10 == 0).count() == 0
    assert nearest(df.filter("vec_id = 10"), F.col("id") % 10 == 0).count() == 0
    odd = nearest(df.union(spark.createDataFrame([(900, [1.0], "x", 0)], SCHEMA)), F.col("id") % 10 == 0, least_probes=512)
    assert sorted(tuple(r) for r in odd.collect()) == sorted(got)


def test_recall_with_many_partitions(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16)) * 3
    x = centres[rng.integers(0, 40, 3000)] + rng.standard_normal((3000, 16))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    out = nearest(df, F.col("id") % 50 == 0, k=10, rows_a_group=50, queries_a_group=10)
    got = {(r["query_id"], r["id"]) for r in out.collect()}
    want = {(q, i) for q, _, i, _ in exact(list(enumerate(x.tolist())), range(0, 3000, 50), 10)}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9


def test_recall_with_own_parameters(spark):
    """As op5 calls it, over more vectors than one part takes; uniform ones have no structure to route by."""
    x = np.random.default_rng(6).standard_normal((4500, 64))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["id"]) for r in nearest(df, F.col("id") % 100 == 0, k=10).collect()}
    want = {(q, i) for q, _, i, _ in exact(list(enumerate(x.tolist())), range(0, 4500, 100), 10)}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9


def test_balanced_parts():
    x = np.random.default_rng(1).standard_normal((500, 8))
    graph = neighbour_graph(x, 10)
    part = balanced_parts(graph, 8)
    cut = (part[:, None] != part[graph]).mean()
    sizes = np.bincount(part, minlength=8)
    assert sizes.max() - sizes.min() <= 3 and cut < 0.75  # 7 of 8 for parts by chance


# --- quality and language --------------------------------------------------------------------------------------------
def test_quality_learns(spark, odd_docs, no_docs):
    rng = random.Random(1)
    rows = [(i, ("buy now %s cheap %s" if i % 2 else "however the %s considered %s") % tuple(random_words(rng, 2)), i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 - y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    model = train_model(sample_features(docs, labels, F.col("doc_id") < 300))
    held = score(docs, model).filter("doc_id >= 300").collect()
    assert all((r["quality_score"] > 0.5) == (r["doc_id"] % 2 == 0) for r in held)
    out = score(odd_docs, model)
    assert out.count() == odd_docs.count() and out.filter("quality_score between 0 and 1").count() == odd_docs.count()
    assert score(no_docs, model).count() == 0
    untaught = train_model(sample_features(no_docs.select("doc_id", "text"), labels, F.lit(True)))
    assert score(odd_docs, untaught).select("quality_score").distinct().collect() == [(0.5,)]


def test_the_sample_is_bounded_in_bytes(spark):
    """Long texts give as many buckets as they may, others all of theirs."""
    rng = random.Random(8)
    docs = [(k, " ".join(random_words(rng, 30_000 if k % 2 else 50, 50_000))) for k in range(12)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id bigint, quality int")
    sample = sample_features(df, labels, F.lit(True), buckets=1000)
    for label, buckets, weights in sample:
        assert len(buckets) == len(weights) and (len(buckets) == 1000 if label else len(buckets) < 1000) and abs(weights.sum() - 1) < 1e-5
    whole = {label: set() for label in (0, 1)}
    for k, t in docs:
        whole[k % 2] |= set(features(t).tolist())
    assert all(set(b.tolist()) <= whole[label] for label, b, _ in sample)
    assert len({tuple(b[:5]) for label, b, _ in sample if label}) == 6
    assert drawn(np.arange(9), np.ones(9), 2**63 - 1, 4)[0].size == 4 and drawn(np.arange(9), np.ones(9), -5, 9)[0].size == 9
    # 6000 such rows, as the query takes them, are under 500 MB.
    assert 6000 * 4096 * 8 < 500e6


def test_scores_against_a_plain_sum(spark, odd_docs):
    """A document's score is that of the mean of its buckets' numbers, taken one by one."""
    rng = np.random.default_rng(4)
    model = rng.normal(size=(1 << 18) + 1).astype(np.float32)
    for r in score(odd_docs.drop("quality_score"), model).collect():
        own = features(r["text"]).tolist()
        z = float(model[-1]) + (math.fsum(float(model[b]) for b in own) / len(own) if own else 0.0)
        assert math.isclose(r["quality_score"], 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_features_of_spans():
    text = " ".join(random_words(random.Random(1), 60_000))
    assert len(features(None)) == 0 == len(features(" \n")) and len(features(text)) > 100_000
    assert (features("a b") == features(" a\nb ")).all()


def test_language(spark, odd_docs, no_docs):
    texts = {"en": "the house and the garden are where we live with all of them ", "de": "das haus und der garten sind wo wir mit ihnen allen leben ", "fr": "la maison et le jardin sont où nous vivons avec eux tous "}
    rows = [(3 * k + j, " ".join(random.Random(k).sample(t.split(), 8)), lang) for k in range(40) for j, (lang, t) in enumerate(texts.items())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = learn_dictionaries(docs, F.col("doc_id") < 60)
    assert sorted(learned) == ["de", "en", "fr"]
    out = identify(docs.filter("doc_id >= 60"), learned).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) / len(out) > 0.9
    odd = {r["doc_id"]: r for r in identify(odd_docs.dropDuplicates(["doc_id"]), learned).collect()}
    assert all((odd[i]["lang_pred"], odd[i]["lang_score"], odd[i]["lang_rejected"]) == (UND, 0.0, True) for i in (4, 5, 6))
    assert identify(no_docs, learned).count() == 0
    assert learn_dictionaries(no_docs, F.lit(True)) == {} and identify(odd_docs, {}).filter("lang_pred <> 'und'").count() == 0
    assert Compressors({"en": b"x"}, 3, 100).predict("word")[0] == "en"


def test_language_of_long_texts_only(spark):
    texts = {"en": "the house and the garden are where we live with all of them ", "de": "das haus und der garten sind wo wir mit ihnen allen leben "}
    rows = [(2 * k + j, " ".join(random.Random(k).choices(t.split(), k=6000 if lang == "de" and k < 20 else 8)), lang) for k in range(30) for j, (lang, t) in enumerate(texts.items())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = learn_dictionaries(docs, F.col("doc_id") < 40)
    assert sorted(learned) == ["de", "en"] and all(len(d) <= 32_100 for d in learned.values())
    assert all(r["lang_pred"] == "de" for r in identify(docs.filter("doc_id >= 40 and lang = 'de'"), learned).collect())
    own = letters(max((t for i, t, _ in rows if i < 40), key=len))
    one = learn_dictionaries(docs.filter(F.length("text") == max(len(t) for _, t, _ in rows)).limit(1), F.lit(True), dictionary_bytes=1001)["de"]
    assert len(one) == 1001 and one == own[(len(own) - 1001) // 2 :][:1001]


def test_dictionary_is_raw_content():
    d = zstandard.ZstdCompressionDict(b"some raw text", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    assert d.as_bytes() == b"some raw text"


# --- packing ---------------------------------------------------------------------------------------------------------
def check_sequences(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_odd(spark, odd_docs, no_docs):
    import zlib

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, text in pairs(odd_docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(i, k, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], np.uint32).tobytes())) for k, at in enumerate(range(0, len(ids), 64))]
    rows = pack_documents(odd_docs, tokenizer_path(), size=64).collect()
    assert key((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == key(want)
    n = check_sequences(rows, 64)
    assert n <= -(-sum(r["length"] for r in rows) // 64) + 1
    assert pack_documents(no_docs, tokenizer_path()).count() == 0


def test_packing_lengths(spark):
    rng = random.Random(6)
    rows = [(i, 0, 0, rng.choice([1, 2, 3, 50, 64, 64, 33, 31, 30, 20, 13]), 0) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    out = pack(df, size=64).collect()
    assert len(out) == 900 and check_sequences(out, 64) <= -(-sum(r[3] for r in rows) // 64) + 1


def test_plan_uses_every_piece():
    rng = random.Random(8)
    for _ in range(30):
        counts = {rng.randint(1, 40): rng.randint(1, 60) for _ in range(rng.randint(1, 12))}
        used: dict[int, int] = {}
        for times, members in plan(counts, 40):
            assert sum(x * k for x, k in members) <= 40
            for x, k in members:
                used[x] = used.get(x, 0) + times * k
        assert used == counts
    assert plan({10: 3, 20: 1, 30: 3, 7: 1, 13: 1}, 40)[0] == (3, [(30, 1), (10, 1)])


def test_special_pieces_in_texts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = ["a <|endoftext|> b", "a<|endoftext|>b", "<|endoftext|>", "(<|endoftext|>).", "<|ENDOFTEXT|> <|startoftext|>x", "endoftext <| endoftext |>"]
    rows = pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), tokenizer_path()).collect()
    import zlib

    want = [(i, zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0], np.uint32).tobytes())) for i, x in enumerate(texts)]
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in rows) == want
    assert t.encode(texts[0], add_special_tokens=False).ids == [320, 49407, 321]


def test_sums_of_lengths():
    """Singles, pairs and triples are found as long as their lengths are there, and no longer."""
    rng = random.Random(2)
    for _ in range(200):
        have = np.zeros(31, np.int64)
        for x in rng.sample(range(1, 31), 8):
            have[x] = rng.randint(1, 2)
        sums = Sums(have)
        for _ in range(30):
            gap, used = rng.randint(1, 30), (rng.choice(np.flatnonzero(have).tolist()),)
            pool = [x for x in np.flatnonzero(have).tolist() for _ in range(int(have[x]) - used.count(x))]
            for n, find in ((1, sums.single), (2, sums.pair), (3, sums.triple)):
                got = find(gap, used)
                assert (got is not None) == any(sum(c) == gap for c in itertools.combinations(pool, n))
                assert got is None or (len(got) == n and sum(got) == gap and all(got.count(x) <= pool.count(x) for x in got))
            x = rng.choice(np.flatnonzero(have).tolist())
            if have.sum() > 3:
                have[x] -= 1


def test_word_cache():
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    odd = ["", "  a\tb c", "İstanbul İ, i̇x", "it's they'll don't, o'x'", "...!!, ,;a", "각 가", "½x²y_z Ⅷ", "<|endoftext|>", "ﬁn ﬀ.", "中文字符。日本", "(abc) \"de\" f--g %%%", "_x_", "'s, ('s)", "x y z\x85w"]
    flat, at = WordCache(tokenizer_path(), entries=5).encode(pa.array(odd))
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [e.ids for e in t.encode_batch(odd, add_special_tokens=False)]


# --- WARC ------------------------------------------------------------------------------------------------------------
def test_warc_round_trip(spark):
    long = "x" * 1500 + "é"
    pages = [(1, "http://a b", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", long), (7, "u", "y" * 300_000 + "\r\n\r\n"), (3, "u", long), (8, "http://a b", long)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, payload string")
    archives = write_warc(df, archive_bytes=1000)
    rows = read_warc(archives).collect()
    assert archives.agg(F.sum("n_records")).first()[0] == len(pages) == len(rows)
    got = {(r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in rows}
    want = set()
    for i, _, html in pages:
        b = (html or "").encode()
        old = len(b) >= 1000 and html == long and i not in (8, None)
        want.add((f"urn:page:{'null' if i is None else i}", "revisit" if old else "response", "urn:page:8" if old else None, len(b), hashlib.sha1(b).hexdigest()))
    assert got == want
    assert all(r["digest_ok"] is True and bytes(r["payload"]) for r in rows if r["record_type"] == "response" and r["payload_bytes"])
    assert read_warc(write_warc(df.limit(0))).count() == 0


def test_warc_of_large_ids(spark):
    """Ids beyond 2^53 stay exact, also beside a null id."""
    big, body = 1 << 60, "z" * 2000
    pages = [(big + k, "u", body) for k in range(4)] + [(None, "u", body), (None, "u", "other"), (big + 9, "u", "other")]
    rows = read_warc(write_warc(spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1))).collect()
    got = sorted((r["record_id"], r["record_type"], r["refers_to"] or "") for r in rows)
    last = f"urn:page:{big + 3}"
    assert got == sorted([(f"urn:page:{big + k}", "revisit", last) for k in range(3)] + [(last, "response", ""), (f"urn:page:{big + 9}", "response", "")] + [("urn:page:null", "response", "")] * 2)


def test_a_damaged_payload_is_an_error(spark, tmp_path):
    import gzip

    good = record("urn:page:1", "u", b"body", hashlib.sha1(b"body").hexdigest())
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(good.replace(b"body", b"b0dy")))
    archives = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "archive string")
    assert [r["digest_ok"] for r in read_warc(archives, strict=False).collect()] == [False]
    with pytest.raises(Exception, match="differs from its digest"):
        read_warc(archives).collect()


def test_broken_archives(tmp_path):
    import io
    import zlib

    def gz(b):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(b) + z.flush()

    good = record("urn:x", "u", b"body", hashlib.sha1(b"body").hexdigest())
    assert [r["payload"] for r in records(io.BytesIO(gz(good) * 3), chunk=7)] == [b"body"] * 3
    assert not next(records(io.BytesIO(gz(good.replace(b"body", b"b0dy")))))["digest_ok"]
    for bad in (gz(good)[:-20], gz(good[:-2]), gz(good.replace(b"Content-Length: 4", b"Content-Length: 4").replace(b"body", b"bo")), gz(b"no header")):
        with pytest.raises(WarcError):
            list(records(io.BytesIO(bad)))


# --- names, long texts, the shared folder ----------------------------------------------------------------------------
def test_odd_column_names(spark):
    """Columns named like internal ones, like added ones in another case, and with a backtick."""
    names = ["doc_id", "text", "lang", "_id", "_doc", "_drop", "_text", "id", "h", "rn", "LANG_PRED", "N_Lines", "Hit_Words", "Quality_Score", "a`b", "sid", "token"]
    rows = [(i, f"some text of number {i}\nand a common line of all", "en", *["x"] * (len(names) - 3)) for i in range(4)]
    df = spark.createDataFrame(rows, ", ".join("`" + n.replace("`", "``") + ("` bigint" if n == "doc_id" else "` string") for n in names))
    items = spark.createDataFrame([(1, "a common line of all", "x")], "item_id bigint, text string, item string")
    labels = spark.createDataFrame([(0, 1, "x"), (1, 0, "x")], "doc_id bigint, quality int, _label string")
    learned = learn_dictionaries(df, F.col("doc_id") < 3)
    assert sorted(learned) == ["en"]
    outs = {
        "lang_pred": identify(df, learned), "n_lines": dedup_lines(df), "hit_words": find_items(df, items), "quality_score": score(df, train_model(sample_features(df, labels, F.lit(True)))),
    }
    for added, out in outs.items():
        lower = [c.lower() for c in out.columns]
        assert lower.count(added) == 1 and {"_id", "_doc", "_drop", "a`b"} <= set(out.columns) and out.count() == 4
    for out in (near_duplicate_components(df), remove_repeats(df), scan_licenses(df), pack_documents(df, tokenizer_path())):
        assert out.count() == 4


def test_sample_is_bounded_whatever_repeats(spark):
    docs = spark.createDataFrame([(1, f"word{k}") for k in range(50)] + [(2, "other")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id bigint, quality int")
    assert [s[0] for s in sample_features(docs, labels, F.lit(True), rows=2)] == [1, 0]


def test_texts_over_a_megabyte(spark):
    """One text of 1.5 MB, its copy, and a near copy, through every text operator."""
    rng = random.Random(17)
    w = random_words(rng, 220_000, 60_000)
    near = [*w[:100_000], "changed", *w[100_001:]]
    docs = [(1, " ".join(w)), (2, " ".join(w)), (3, " ".join(near)), (4, "short text of a few words")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {(r["doc_id"], r["component_id"]) for r in near_duplicate_components(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    removed = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in remove_repeats(df).drop("kept").collect()}
    assert removed[1][1] == 0 and removed[2][0] == removed[2][1] and 0 < removed[3][0] - removed[3][1] <= len("changed")
    items = spark.createDataFrame([(9, " ".join(near[99_995:100_005]))], "item_id bigint, text string")
    assert {r["doc_id"]: r["hit_words"] for r in find_items(df, items).collect()} == {1: [], 2: [], 3: list(range(99_995, 100_005)), 4: []}
    dropped = {r["doc_id"]: r["n_dropped"] for r in dedup_lines(df).collect()}
    assert dropped == {1: 0, 2: 1, 3: 0, 4: 0}
    scanned = {r["doc_id"]: (r["n_words"], r["places"], r["labels"]) for r in scan_licenses(df).collect()}
    assert scanned == {i: (len(brute.words(t)), [], []) for i, t in docs}
    assert score(df, np.zeros((1 << 18) + 1, np.float32)).filter("quality_score = 0.5").count() == 4
    assert identify(df, {"en": b"short text", "de": b"kurzer satz"}).count() == 4
    check_sequences(pack_documents(df, tokenizer_path()).collect(), 2048)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from reelmark.llm.common import shared_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context), "x")


def test_intermediate_tables_go(spark):
    from pathlib import Path

    from reelmark.llm.common import kept_alone

    docs = spark.createDataFrame([(i, f"line of number {i % 3}") for i in range(9)], "doc_id bigint, text string")
    out = kept_alone(spark, lambda: dedup_lines(docs), "kept")
    root = Path(out.scratch.removeprefix("file:")).parent
    before = {p.name for p in root.iterdir()}
    kept_alone(spark, lambda: dedup_lines(docs), "again")
    assert [n for n in {p.name for p in root.iterdir()} - before if not n.startswith("again")] == []
    assert out.count() == 9


def test_two_at_a_time_leave_each_other_alone(spark):
    """While one call is at work, another begins and ends, and cleans up."""
    import threading

    from reelmark.llm.common import kept_alone, written

    docs = spark.createDataFrame([(i, f"line of number {i % 3}") for i in range(9)], "doc_id bigint, text string")
    begun, go, out = threading.Event(), threading.Event(), {}

    def slow():
        mid = written(docs, "mid")
        begun.set()
        go.wait(60)
        return mid.filter("doc_id > 2")

    first = threading.Thread(target=lambda: out.update(first=kept_alone(spark, slow, "first")))
    first.start()
    begun.wait(60)
    out["second"] = kept_alone(spark, lambda: written(docs, "mid").filter("doc_id > 4"), "second")
    go.set()
    first.join(120)
    assert out["first"].count() == 6 and out["second"].count() == 4
