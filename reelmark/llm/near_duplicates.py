"""Jaccard join of word-shingle sets with adaptive multi-match prefixes, down to connected components.

Sets are 64-bit shingle hashes. Documents with equal sets are one class, so copies are never paired.

1. The tokens of all classes travel as packed blocks to hash buckets, which count their holders. Tokens of a single
   class fall away there; the others return to their class with their count, which gives the global order, rare first.
2. A class of which more than the threshold allows is held by no other has no partner and falls away.
3. Two sets that share at least c tokens share k of their first |x| - c + k, for any k. Each set takes the k, and so the
   prefix, of least estimated cost. Pairs come up by the first token they share, where it stands early enough in both
   (positional filter); they are verified if they share as many prefix tokens as the smaller of their two k.
4. Sets that share a token are first compared with one pivot of that token, and linked sets merged, in a fixed number of
   rounds; then all pairs that may link and are still apart. So a group of near copies is linked by stars, and no pair
   that could add a link is left out. Sets near enough to a text to share the start of its prefix mostly link with it,
   so the last pass meets few of a group's pairs.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, parts, quoted, shared_dir, written
from .components import components

U = np.uint64
RANDOM = np.random.default_rng(11).integers(1, 2**63, 300, dtype=np.uint64) * U(2) + U(1)
SPAN = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size, base = max(n, 1 << 14), int(RANDOM[299])
        _POWERS[:] = [np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, b, U))]) for b in (base, pow(base, -1, 1 << 64))]
    return _POWERS


def _span_words(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], (a == 32) | ((a >= 9) & (a <= 13)), [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    power = _powers(len(a) + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(RANDOM[a] * power[0][: len(a)])])
    return _mix((sums[ends] - sums[starts]) * power[1][starts] + (ends - starts).astype(U) * RANDOM[298])


def word_hashes(data: bytes) -> np.ndarray:
    """A hash per word, A-Z lower-cased, split at ASCII white space; long texts span by span, cut at white space."""
    data, out, at = data.lower(), [], 0
    while at < len(data):
        end = at + SPAN
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        out.append(_span_words(data[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, U)


def shingle_set(data: bytes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; of a text of fewer words, the one of its whole sequence."""
    w = word_hashes(data)
    if not len(w):
        return w
    m = min(n, len(w))
    h = np.full(len(w) - m + 1, m, U)
    for k in range(m):
        h = (h ^ w[k : len(w) - m + 1 + k]) * RANDOM[256 + k]
        h ^= h >> U(29)
    return np.unique(_mix(h))


def _set_id(s: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """Two signed halves of a set's 128-bit digest: its id, and what tells sets of one id apart."""
    both = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes(), seed), np.int64)
    return int(both[0]), int(both[1])


def _sets(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(doc_id, n, sid, check, mark): the size of each document's set, its id and check, null for the empty one, and the
    text's mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sid, check, mark = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text or b"", shingle)
                own = _set_id(s, seed) if len(s) else (None, None)
                n.append(len(s))
                sid.append(own[0])
                check.append(own[1])
                mark.append(_mark(text or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, sid, check, mark))], names=["doc_id", "n", "sid", "check", "mark"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, sid bigint, check bigint, mark bigint")


def _mark(text: bytes) -> int:
    """A text's hash as a signed number: rows of one id may hold different texts."""
    mark = xxhash.xxh3_64_intdigest(text)
    return mark - (1 << 64) if mark >> 63 else mark


def _blocks(sets: list[np.ndarray], sids: list[int], buckets: int) -> pa.RecordBatch:
    """(bucket, block) of some sets: per bucket the sets that have tokens there, their sizes and numbers of tokens, and
    the upper 48 bits of the tokens, which tell the tokens of a bucket apart."""
    tok, index = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    ids, sizes = np.array(sids, np.int64), np.array([len(s) for s in sets], np.int64)
    bucket = (_mix(tok) % U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    six, index = np.ascontiguousarray(tok[order]).view(np.uint8).reshape(-1, 8)[:, 2:], index[order]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
    at, data = np.flatnonzero(np.diff(cuts)), []
    for b in at:
        a, z = cuts[b], cuts[b + 1]
        held, counts = np.unique(index[a:z], return_counts=True)
        data.append(b"".join([np.array([len(held), z - a], np.int64).tobytes(), ids[held].tobytes(), sizes[held].tobytes(), counts.astype(np.int32).tobytes(), six[a:z].tobytes()]))
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "block"])


def _postings(docs: DataFrame, shingle: int, seed: int, buckets: int, tokens_a_block: int = 2_000_000) -> DataFrame:
    """(bucket, block): all tokens of each class. A block holds a class once, and the buckets tell repeats apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[int, None] = OrderedDict()  # the classes sent last, so that copies are mostly sent once
        sets, sids, held = [], [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = shingle_set(text or b"", shingle)
                if not len(s):
                    continue
                sid = _set_id(s, seed)[0]
                if sid in seen:
                    seen.move_to_end(sid)
                    continue
                seen[sid] = None
                if len(seen) > 1_000_000:
                    seen.popitem(last=False)
                sets.append(s)
                sids.append(sid)
                held += len(s)
                if held >= tokens_a_block:
                    yield _blocks(sets, sids, buckets)
                    sets, sids, held = [], [], 0
        if sets:
            yield _blocks(sets, sids, buckets)

    return docs.select("text").mapInArrow(run, "bucket int, block binary")


def _unpack(block: bytes) -> tuple[np.ndarray, ...]:
    """(tokens, sids, sizes, numbers of tokens) of a block."""
    m, n = np.frombuffer(block, np.int64, 2).tolist()
    sids, sizes = np.frombuffer(block, np.int64, m, 16), np.frombuffer(block, np.int64, m, 16 + 8 * m)
    counts = np.frombuffer(block, np.int32, m, 16 + 16 * m)
    tok = np.zeros((n, 8), np.uint8)
    tok[:, :6] = np.frombuffer(block, np.uint8, 6 * n, 16 + 20 * m).reshape(n, 6)
    return tok.view(np.int64).ravel(), sids, sizes, counts


def _held_tokens(postings: DataFrame, shares: int) -> DataFrame:
    """(part, block): for each class, its tokens of this bucket that another class has too, and their holders. A bucket
    sends a block to each share of the classes."""

    def run(table: pa.Table) -> pa.Table:
        blocks = [_unpack(b) for b in table.column("block").to_pylist()]
        tok = np.concatenate([b[0] for b in blocks])
        sid, n = (np.concatenate([np.repeat(b[j], b[3]) for b in blocks]) for j in (1, 2))
        order = np.argsort(tok, kind="stable")
        tok = tok[order]
        same = tok[1:] == tok[:-1]
        more = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        tok, sid, n = tok[more], sid[order[more]], n[order[more]]
        order = np.lexsort((sid, tok))
        tok, sid, n = tok[order], sid[order], n[order]
        first = np.ones(len(tok), bool)
        first[1:] = (tok[1:] != tok[:-1]) | (sid[1:] != sid[:-1])  # a class that several tasks sent
        tok, sid, n = tok[first], sid[first], n[first]
        _, group, count = np.unique(tok, return_inverse=True, return_counts=True)
        holders = count[group]
        more = holders > 1
        tok, sid, n, holders = tok[more], sid[more], n[more], holders[more]
        part = (_mix(sid.view(U)) % U(shares)).astype(np.int32)
        order = np.lexsort((sid, part))
        cuts = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=shares))])
        at = np.flatnonzero(np.diff(cuts))
        data = []
        for k in at:
            o = order[cuts[k] : cuts[k + 1]]
            own, begin = np.unique(sid[o], return_index=True)
            size = np.array([len(own), len(o)], np.int64)
            lengths = np.diff(np.append(begin, len(o)))
            data.append(b"".join(x.tobytes() for x in (size, own, n[o[begin]].astype(np.int64), lengths.astype(np.int64), tok[o], holders[o].astype(np.int32))))
        return pa.table({"part": pa.array(at.astype(np.int32)), "block": pa.array(data, pa.binary())})

    return postings.groupBy("bucket").applyInArrow(run, "part int, block binary")


def _unpack_held(block: bytes) -> tuple[np.ndarray, ...]:
    """(sid, n, token, holders) of every held token of a block."""
    m, k = np.frombuffer(block, np.int64, 2).tolist()
    sid, n, lengths = (np.frombuffer(block, np.int64, m, 16 + 8 * m * j) for j in range(3))
    return np.repeat(sid, lengths), np.repeat(n, lengths), np.frombuffer(block, np.int64, k, 16 + 24 * m), np.frombuffer(block, np.int32, k, 16 + 24 * m + 8 * k)


def prefix(n: int, tokens: np.ndarray, holders: np.ndarray, t: tuple[int, int], most: int = 8) -> tuple[np.ndarray, int]:
    """The places of the tokens of a set's prefix that another set has, rare ones first, and how many of them a pair must
    share (k).

    Of the set's n tokens, `tokens` have two holders or more; the others are rarer and stand before them. With too few
    of them for any partner, the prefix is empty. Costs of a k: a unit per token indexed, one per other holder, and 20
    per candidate; k shared tokens are needed, so candidates are at most holders / k.
    """
    overlap, m = -(-t[0] * n // t[1]), len(tokens)
    if m < overlap:
        return np.zeros(0, np.int64), 1
    order = np.lexsort((tokens, holders))
    ks = np.arange(1, min(most, overlap) + 1)
    others = np.cumsum(holders[order].astype(np.int64) - 1)[m - overlap + ks - 1]
    k = int(ks[np.argmin((m - overlap + ks) + others + 20 * others / ks)])
    return order[: m - overlap + k], k


def _prefixes(held: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(sid, n, m, k, tokens, holders): the prefix tokens, rare ones first, of the classes that may have a partner, and
    how many classes hold each; m of a class's n tokens are in another one too."""

    def run(table: pa.Table) -> pa.Table:
        blocks = [_unpack_held(b) for b in table.column("block").to_pylist()]
        sid, n, tok, holders = (np.concatenate([b[j] for b in blocks]) for j in range(4))
        order = np.argsort(sid, kind="stable")
        sid, n, tok, holders = sid[order], n[order], tok[order], holders[order]
        cuts = np.flatnonzero(np.concatenate([[True], sid[1:] != sid[:-1]]))
        out: list[list] = [[] for _ in range(6)]
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sid)], strict=True):
            own, k = prefix(int(n[a]), tok[a:z], holders[a:z], t)
            if len(own):
                for column, value in zip(out, (sid[a], n[a], z - a, k, tok[a:z][own], holders[a:z][own]), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        return pa.table([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], names=["sid", "n", "m", "k", "tokens", "holders"])

    return held.groupBy("part").applyInArrow(run, "sid bigint, n int, m int, k int, tokens array<bigint>, holders array<int>")


def _rows(now: DataFrame, t: tuple[int, int], rows_a_group: int) -> DataFrame:
    """(token, sid, n, m, pos, comp, groups): each class's tokens that can be the first it shares with a partner, and
    their places among all its tokens. A token of many holders has its rows dealt into groups."""
    first = F.expr(f"posexplode(slice(arrays_zip(tokens, holders), 1, m - cast(ceil({t[0]} * n / {t[1]}) as int) + 1)) as (j, x)")
    rows = now.select("sid", "n", "m", "comp", first)
    groups = F.expr(f"cast((x.holders + {rows_a_group - 1}) div {rows_a_group} as int)")
    return rows.select(F.col("x.tokens").alias("token"), "sid", "n", "m", (F.col("n") - F.col("m") + F.col("j")).alias("pos"), "comp", groups.alias("groups"))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sub", F.expr("cast(pmod(xxhash64(sid), groups) as int)"))


def _for_each_group(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")


def _close(most: str, n1: str, n2: str, t: tuple[int, int]) -> str:
    """Whether sets of n1 and n2 tokens that share `most` at most can have Jaccard t."""
    return f"{t[0] + t[1]} * {most} >= {t[0]} * ({n1} + {n2})"


def _may_link(a: tuple[str, str, str], b: tuple[str, str, str], t: tuple[int, int]) -> str:
    """Of two sets (n, m, pos) whose first common token stands at pos: neither shares more than it has in common with any
    other set (m), nor more than the tokens from that place on."""
    return _close(f"least({a[1]}, {b[1]}, {a[0]} - {a[2]}, {b[0]} - {b[2]})", a[0], b[0], t)


def _enough(pairs: DataFrame, classes: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(a, b, hits): the pairs that share as many prefix tokens as the smaller of their k."""
    x, y = (classes.select(F.col("sid").alias(side), F.struct("n", "m", "k", "tokens").alias(side + "_")) for side in "ab")
    both = pairs.join(x, "a").join(y, "b").withColumn("need", F.least("a_.k", "b_.k")).withColumn("least", F.expr(f"cast(ceil({t[0]} * (a_.n + b_.n) / {t[0] + t[1]}) as int)"))
    hits = F.expr("size(array_intersect(slice(a_.tokens, 1, a_.m - least + need), slice(b_.tokens, 1, b_.m - least + need)))")
    return both.withColumn("hits", hits).filter("hits >= need").select("a", "b", "hits")


def _star_pairs(rows: DataFrame, classes: DataFrame, seed: int, t: tuple[int, int]) -> DataFrame:
    """Each class with the pivot, of another component, that it shares most prefix tokens with.

    Every other round a token's pivot is the class that is most made of what others have, as the text that a group's
    near copies were edited from is; in the rounds between it is any.
    """
    first = -F.col("m") / F.col("n") if seed % 2 == 0 else F.lit(0.0)
    chosen = F.min_by(F.struct(*(F.col(c).alias("p" + c) for c in ("sid", "n", "m", "pos", "comp"))), F.struct(first, F.xxhash64("sid", F.lit(seed))))
    pivot = rows.groupBy("token").agg(chosen.alias("pivot"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("groups").alias("groups")).filter("lo <> hi")
    near = _dealt(rows).join(_for_each_group(pivot.select("token", "pivot.*", "groups")), ["token", "sub"]).filter("comp <> pcomp").filter(_may_link(("n", "m", "pos"), ("pn", "pm", "ppos"), t))
    pairs = _enough(near.select(F.col("psid").alias("a"), F.col("sid").alias("b")).distinct(), classes, t)
    return pairs.groupBy("b").agg(F.max_by("a", F.struct("hits", "a")).alias("a")).select("a", "b")


def _rest_pairs(rows: DataFrame, classes: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The pairs still apart that may link, by their first common tokens. One side leaves out the token's largest
    component, so that component is walked only for the classes outside it."""
    sizes = rows.groupBy("token", "comp").agg(F.count("*").alias("c"), F.max("groups").alias("groups"))
    main = sizes.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps"), F.max("groups").alias("groups")).filter("comps > 1")
    dealt = _dealt(rows)
    outside = dealt.join(_for_each_group(main.drop("comps")), ["token", "sub"]).filter("comp <> main")
    x = _for_each_group(outside.select("token", "main", "groups", *(F.col(c).alias("x" + c) for c in ("sid", "n", "m", "pos", "comp"))))
    near = x.join(dealt, ["token", "sub"]).filter("xcomp <> comp and (comp = main or xsid < sid)").filter(_may_link(("n", "m", "pos"), ("xn", "xm", "xpos"), t))
    return _enough(near.select(F.least("xsid", "sid").alias("a"), F.greatest("xsid", "sid").alias("b")).distinct(), classes, t).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, t: tuple[int, int]) -> DataFrame:
    """The pairs whose sets have Jaccard t or more; texts are stored in buckets by sid and not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        known: dict[int, np.ndarray] = {}
        held = 0

        def set_of(sid: int, data: bytes) -> np.ndarray:
            nonlocal held
            s = known.get(sid)
            if s is None:
                s = known[sid] = shingle_set(unpack(data), shingle)
                held += len(s)
            return s

        for batch in batches:
            a, b, x, y = (batch.column(k).to_pylist() for k in range(4))
            good = []
            for p, q, u, v in zip(a, b, x, y, strict=True):
                if held > 4_000_000:  # 32 MB
                    known.clear()
                    held = 0
                both = np.concatenate([set_of(p, u), set_of(q, v)])
                n = len(both)
                both.sort(kind="stable")
                i = int((both[1:] == both[:-1]).sum())
                good.append(t[1] * i >= t[0] * (n - i))
            yield pa.RecordBatch.from_arrays([pa.array([v for v, g in zip(c, good, strict=True) if g], pa.int64()) for c in (a, b)], names=["a", "b"])

    x = texts.select(F.col("sid").alias("a"), F.col("data").alias("x"))
    y = texts.select(F.col("sid").alias("b"), F.col("data").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _store_classes(docs: DataFrame, classes: DataFrame, buckets: int) -> str:
    """Writes (sid, n, m, k, tokens, holders, data) in buckets by sid and returns the table's name; data is a text of the
    class, and (doc_id, mark) in `classes` says which.

    Texts are compressed before they travel: half the size of what the shuffle makes of them, and less than their sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_mark(x) for x in texts], pa.int64()), pa.array([pack(x) for x in texts], pa.binary())], names=["doc_id", "mark", "data"])

    path = shared_dir(docs.sparkSession, "classes")
    name = "classes_" + path[-32:]
    packed = docs.filter("text is not null").mapInArrow(run, "doc_id bigint, mark bigint, data binary")
    rows = packed.join(classes, ["doc_id", "mark"]).drop("doc_id", "mark").repartition(buckets, "sid").dropDuplicates(["sid"])
    rows.write.option("path", path).bucketBy(buckets, "sid").sortBy("sid").saveAsTable(name)
    return name


def near_duplicate_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: tuple[int, int] = (80, 100), tokens_a_bucket: int = 2_000_000, star_rounds: int = 2, rows_a_group: int = 1000) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs.

    Null, empty and wordless texts have no shingles and are their own component. Ids are whole numbers (text of digits
    counts as one); rows with a null id, or one that is no number, take no part and are not returned. Repeated rows
    return a row each; rows of one id with different texts link the id with all that either of them links. An empty table
    gives no rows. Extra columns, of whatever name, are ignored. A text is taken whole, however long: a task holds its
    shingles' hashes, some eight bytes a word, at a time.
    """
    spark = docs.sparkSession
    docs = docs.select(F.expr(f"try_cast({quoted(id_col)} as bigint)").alias("doc_id"), column(text_col).cast("binary").alias("text")).filter("doc_id is not null")
    t = threshold
    for seed in range(16):
        found = written(_sets(docs, shingle, seed), "sets")
        classes = found.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min_by("mark", "doc_id").alias("mark"), F.first("n").alias("n"), (F.min("check") < F.max("check")).alias("mixed"))
        size, mixed = classes.agg(F.sum("n"), F.bool_or("mixed")).first()
        if not mixed:  # else two different sets have one id: others with the next seed
            break
    buckets = int(max(2 * parts(spark), (size or 0) // tokens_a_bucket))
    live = written(_prefixes(_held_tokens(_postings(docs, shingle, seed, buckets), buckets), t), "prefixes")
    name = _store_classes(docs, live.join(classes.select("sid", "doc_id", "mark"), "sid"), parts(spark))
    try:
        best = _linked(spark.table(name), classes.select("sid", "doc_id"), shingle, t, star_rounds, rows_a_group)
    finally:
        spark.sql(f"DROP TABLE {name}")
    return found.join(best, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _linked(stored: DataFrame, classes: DataFrame, shingle: int, t: tuple[int, int], star_rounds: int, rows_a_group: int) -> DataFrame:
    """(sid, component_id) of every class: stars first, then the pairs that they left apart."""
    now, links = stored.withColumn("comp", F.col("sid")), None
    for seed in range(star_rounds + 1):
        rows = _rows(now, t, rows_a_group)
        pairs = _star_pairs(rows, stored, seed, t) if seed < star_rounds else _rest_pairs(rows, stored, t)
        more = written(_verified(pairs, stored, shingle, t), "links")
        links = more if links is None else links.union(more)
        comps = components(links)
        now = stored.join(comps.withColumnsRenamed({"node": "sid", "component": "comp"}), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    joined = classes.join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("component", "sid"))
    least = joined.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return written(joined.join(least, "comp").select("sid", "component_id"), "classes")
