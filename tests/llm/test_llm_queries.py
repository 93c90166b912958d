"""The registered queries: against their SQL, or against a plain version on the smallest tables."""

import math
import zlib

import brute
import numpy as np
import pytest
from helpers import connect, same

import corpus_pipeline
from reelmark.llm import queries
from reelmark.llm.language import UND, Compressors, learn_dictionaries
from reelmark.llm.common import held_out
from reelmark.llm.line_dedup import STRIP, line_key, long_enough


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, small, con, name):
    same(queries.QUERIES[name](spark, small), con, queries.ORACLE_SQL[name])


def test_names():
    import __spark_entry__ as e

    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert "pipeline" in e.queries() and set(queries.QUERIES) <= set(e.queries())


def test_quality_held_out(spark, small):
    rows = queries.op1_quality(spark, small).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) >= 0.85


def test_language_held_out(spark, small):
    rows = queries.op2_language(spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) >= 0.95


def test_nearest_recall(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    got = {}
    for r in queries.op5_nearest_neighbours(spark, small).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    found = total = 0
    for q in [i for i in ids if i % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]])
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 11)) and all(math.isclose(s, d[ids == v][0], rel_tol=1e-12) for _, v, s in own)
        found, total = found + len(best & {v for _, v, _ in own}), total + 10
    assert found / total >= 0.9


def plain_pipeline(spark, small):
    """The documents that every stage keeps, one after another in plain Python."""
    df = spark.read.parquet(f"{small}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    model = Compressors(learn_dictionaries(df, ~held_out("doc_id", 4, 2)), 7, 1000)
    docs = [(i, t) for i, t in docs if (p := model.predict(t))[0] != UND and p[1] >= 0.003]
    owners: dict[bytes, set] = {}
    for i, t in docs:
        for x in t.split("\n"):
            owners.setdefault(line_key(x.encode()), set()).add(i)
    kept = []
    for i, t in docs:
        lines = t.split("\n")
        left = [x for x in lines if not (long_enough(k := line_key(x.encode()), 10) and len(owners[k]) > 1 and min(owners[k]) != i)]
        if len(left) == len(lines) or "\n".join(left).encode().strip(STRIP):
            kept.append((i, "\n".join(left)))
    docs = [(i, t) for (i, t), (_, _, c) in zip(kept, brute.components(kept), strict=True) if i == c]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    return [(i, t) for (i, t), h in zip(docs, brute.hits(docs, items), strict=True) if not h[2]]


def test_pipeline(spark, small):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for i, text in plain_pipeline(spark, small):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        want += [(i, k, at, len(p := ids[at : at + 2048]), zlib.crc32(np.array(p, np.uint32).tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    rows = corpus_pipeline.run(spark, small).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in own) <= 2048 and [o for o, _ in sorted(own)] == list(np.cumsum([0, *(n for _, n in sorted(own))])[:-1]) for own in by.values())


def test_packing_of_greek(spark, tmp_path):
    """Capital sigmas at the ends of words, beside marks, digits and accents: the ids are the tokenizer's."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["ΟΔΟΣ", "ΟΔΟΣ. (ΟΔΟΣ) ΣΑΣ Σ", "ΑΣ2 Σ-Σ ΑΣ\u0301 ΑΣ'\nΑΣ", "ΤΕΛΟΣ " * 3000]
    spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for k, x in enumerate(texts):
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        want += [(k, at, zlib.crc32(np.array(ids[at : at + 2048], np.uint32).tobytes())) for at in range(0, len(ids), 2048)]
    got = [(r["doc_id"], r["start"], r["ids_crc32"]) for r in queries.op9_best_fit_packing(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_packing_query(spark, small):
    """The registered query's pieces, place by place; and hardly more sequences than the tokens need."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want += [(r["doc_id"], k, at, len(p := ids[at : at + 2048]), zlib.crc32(np.array(p, np.uint32).tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    rows = queries.op9_best_fit_packing(spark, small).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in own) <= 2048 and [o for o, _ in sorted(own)] == list(np.cumsum([0, *(n for _, n in sorted(own))])[:-1]) for own in by.values())
    assert len(by) <= -(-sum(w[3] for w in want) // 2048) + 2


def test_stages_on_odd_rows(spark, small, odd_docs, no_docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near_duplicates", "benchmark", "packing"]
    for docs in (odd_docs, no_docs):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, small)
            assert out.columns == docs.columns and out.count() <= n
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() >= n
