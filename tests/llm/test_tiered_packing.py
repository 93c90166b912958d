"""Hierarchical packing: every token once, full sequences, even steps; against the tokenizer itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from reelmark.llm import queries
from reelmark.llm.packing import WordCache
from reelmark.llm.tiered_packing import layout, pack_in_tiers, step_groups, tier_steps


def check(rows, docs, end_id, tiers, step_tokens):
    """Against the tokenizer's ids of (doc_id, text) rows."""
    from tokenizers import Tokenizer

    tokenizer, size = Tokenizer.from_file(queries.tokenizer_path()), max(tiers)
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id]) for i, t in docs]
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == {i for i, _ in ids} and sum(r["length"] for r in rows) == sum(len(x) for _, x in ids)
    for i, own in ids:
        if sum(j == i for j, _ in ids) > 1:
            continue
        got = sorted(by_doc[i], key=lambda r: r["start"])
        assert [r["start"] for r in got] == np.cumsum([0, *(r["length"] for r in got)])[:-1].tolist()
        assert all(r["doc_tokens"] == len(own) and r["length"] > 0 and r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], np.uint32).tobytes()) for r in got)
    sequences, steps = defaultdict(list), defaultdict(set)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    short = 0
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert len({(r["tier"], r["step_group"]) for r in own}) == 1
        total, tier = sum(r["length"] for r in own), own[0]["tier"]
        assert total <= tier <= size
        short += total < tier
        steps[own[0]["step_group"]].add((own[0]["sequence_id"], tier))
    assert short <= 1 and sorted(steps) == list(range(len(steps)))
    assert all(len({t for _, t in s}) == 1 for s in steps.values())
    partial = [s for s in steps.values() if sum(t for _, t in s) < step_tokens]
    assert len(partial) <= len(tiers) and all(sum(t for _, t in s) <= step_tokens for s in steps.values())


def test_query(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    check(queries.op12_tiered_packing(spark, small).collect(), docs, 1, (256, 512, 1024, 2048), 16_384)


def test_odd(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check(pack_in_tiers(odd_docs, queries.tokenizer_path(), tiers=(8, 64, 32)).collect(), docs, 1, (8, 32, 64), 16_384)
    assert pack_in_tiers(no_docs, queries.tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        pack_in_tiers(odd_docs, queries.tokenizer_path(), tiers=())


def test_very_long_and_equal_texts(spark):
    """A text of over a megabyte, and many documents of one length."""
    long = " ".join(f"word{i % 977} ΟΔΟΣ" for i in range(100_000))
    docs = [(1, long), *((i, f"a b c {i % 10}") for i in range(2, 800)), (900, "ΟΔΟΣ Σ. ΑΣ-ΑΣ2 ΣΣ")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    check(pack_in_tiers(df, queries.tokenizer_path(), step_tokens=4096).collect(), docs, 1, (256, 512, 1024, 2048), 4096)


@pytest.mark.parametrize("most", [2, 60, 10**10])
def test_plan_places_every_piece_once(most):
    rng = random.Random(most)
    for tiers in ((4, 8, 16), (256, 512, 1024, 2048)):
        counts = {rng.randrange(1, tiers[-1] + 1): rng.randrange(1, most) for _ in range(rng.choice([1, 5, 400]))}
        steps = tier_steps(counts, tiers)
        assert sum(s.times for s in steps if sum(k * used for _, k, used in s.members) < s.tier) <= 1
        assert all(sum(k * used for _, k, used in s.members) <= s.tier for s in steps)
        places = layout(steps, counts, tiers)
        for length, rows in places.rows.items():
            edges = sorted({x for r in rows for x in (r[0], r[0] + r[1])})
            assert edges[0] == 0 and edges[-1] == counts[length]
            for at in edges[:-1]:  # each rank's parts make up its piece, gapless
                own = sorted((r[2], r[3]) for r in rows.tolist() if r[0] <= at < r[0] + r[1])
                assert [s for s, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) == length
        assert sum(n for _, n in places.sequences.values()) == sum(s.times for s in steps)


def test_steps_take_turns():
    groups = {2048: 30, 512: 10, 256: 3}
    at = {t: step_groups(np.arange(n), t, groups, 1).tolist() for t, n in groups.items()}
    assert sorted(x for own in at.values() for x in own) == list(range(43))
    assert all(max(np.diff(own)) <= -(-43 // groups[t]) + 2 for t, own in at.items())


def test_word_cache_lower_cases_as_the_tokenizer_does():
    import pyarrow as pa

    cache = WordCache(queries.tokenizer_path())
    texts = ["ΟΔΟΣ", "ΟΔΟΣ.", "(ΟΔΟΣ) ΣΑΣ Σ", "ΑΣ2 Σ-Σ ΑΣ́ ΑΣ'", "İstanbul ΣİΣ ẞ ŒΣ"]
    ids, bounds = cache.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == cache.tokenizer.encode(t, add_special_tokens=False).ids
