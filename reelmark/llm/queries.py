"""The registered queries of this package, each an operator applied to its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses
from .common import held_out, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import sample_features, score, train_model

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = held_out("doc_id", 5, 0)
    model = train_model(sample_features(docs, table(spark, sf_dir, "labels"), ~fold))
    out = score(docs, model)
    return out.select("doc_id", fold.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, learn_dictionaries

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = held_out("doc_id", 4, 2)
    out = identify(docs.drop("lang"), learn_dictionaries(docs, ~fold))
    return out.select("doc_id", fold.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.col("places.start")
    joined = (F.array_join(c, ",").alias(c) for c in ("base_labels", "labels"))
    return out.select("doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), *joined, "score")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    out = nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0, k=10)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("distance").alias("score"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicate_components

    return near_duplicate_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_items

    out = find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_words").cast("bigint")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    out = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), size=2048, end_id=0)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_warc, write_warc

    page = lambda c: F.expr(f"cast(nullif(substring_index({c}, ':', -1), 'null') as bigint)")
    out = read_warc(write_warc(table(spark, sf_dir, "pages")), payloads=False)
    return out.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import letter_runs, spelling_variants, without_one, word_counts

    runs = table(spark, sf_dir, "documents").select("doc_id", F.explode(letter_runs(F.col("text"))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary")))
    word = F.when(F.col("h") % 97 == 0, without_one(F.col("run"), F.col("h") % F.length("run"))).otherwise(F.col("run"))
    out = spelling_variants(word_counts(runs.select(word.alias("word"))))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def op12_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tiered_packing import pack_in_tiers

    return pack_in_tiers(table(spark, sf_dir, "documents"), tokenizer_path(), tiers=(256, 512, 1024, 2048), end_id=1)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import collapse_runs, longest_repetition, repeat_tail, words

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # A lambda's variable holds the words, so that they are cut out of a text once.
    repeated = F.get(F.transform(F.array(words(F.col("text"))), lambda w: F.array_join(repeat_tail(w, F.floor(h / 10)), " ")), F.lit(0))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(h % 10 == 0, repeated).otherwise(F.col("text")).alias("text"))
    out = collapse_runs(docs).withColumn("best", longest_repetition(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return out.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def _rows(pairs) -> str:
    """SQL rows of (phrase or label, text) pairs."""
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in pair) + ")" for pair in pairs)


QUERIES = {f.__name__: f for f in (op1_quality, op2_language, op3_line_dedup, op4_license_scans, op5_nearest_neighbours, op6_jaccard_join, op7_suffix_dedup, op8_decontaminate, op9_best_fit_packing, op10_warc, op11_spelling_variants, op12_tiered_packing, op13_periodic_runs)}

#: CRC-32 in SQL: of the list of bytes b, with the table in crc_table.t.
CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))
)"""
CRC = "xor(list_reduce({b}, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295), 4294967295)"
#: The bytes of a text as numbers.
BYTES = "list_transform(range(CAST(strlen({s}) AS BIGINT)), lambda k: CAST(('0x' || hex(encode({s}))[2 * k + 1 : 2 * k + 2]) AS BIGINT))"

ORACLE_SQL = {
    "op3_line_dedup": r"""
WITH lines AS (
  SELECT d.doc_id, g.i, s.line, lower_ascii AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d,
       LATERAL (SELECT unnest(range(1, len(d.l) + 1)) AS i) g,
       LATERAL (SELECT d.l[g.i] AS line) s,
       LATERAL (SELECT translate(trim(s.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii) k
), keys AS (
  SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.doc_id, l.i, l.line, (k.key IS NOT NULL AND k.owner <> l.doc_id) AS dropped FROM lines l LEFT JOIN keys k ON l.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op4_license_scans": rf"""
WITH w AS (
  SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), phrases(p, label) AS (VALUES {_rows(licenses.PHRASES)}),
places AS (
  SELECT doc_id, i - 1 AS start, label
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) x, (SELECT string_split(p, ' ') AS p, label FROM phrases) y
  WHERE x.w[x.i : x.i + len(y.p) - 1] = y.p
), base AS (
  SELECT doc_id, count(*) AS n, min(start) AS a, max(start) AS b, list(DISTINCT label) AS labels FROM places GROUP BY doc_id
), notices AS (
  SELECT label, regexp_extract_all(lower(t), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM (VALUES {_rows(licenses.TEMPLATES)}) v(label, t)
), templates AS (
  SELECT label, list_distinct(t) AS t, CAST(ceil(10 * len(t) / 9) AS BIGINT) AS width FROM notices
), possible AS (
  SELECT doc_id, w, label, t, width FROM w, templates WHERE 10 * len(list_intersect(list_distinct(w), t)) >= 9 * len(t)
), blocks AS (
  SELECT doc_id, label, t, list_distinct(w[i : i + width - 1]) AS own
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM possible) WHERE list_contains(t, w[i])
), met AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(CAST(len(list_intersect(own, t)) AS DOUBLE) / len(t)) AS most
  FROM blocks WHERE 10 * len(list_intersect(own, t)) >= 9 * len(t) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.a AS first_word, b.b AS last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
       CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(m.most, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base b ON w.doc_id = b.doc_id LEFT JOIN met m ON w.doc_id = m.doc_id
""",
    "op6_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(doc_id, m) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.m = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.m AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT doc_id, min(m) AS m FROM reach GROUP BY doc_id) r ON w.doc_id = r.doc_id
""",
    "op7_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
segments AS (SELECT doc_id, k, substring(h, 2 * k + 1, 698) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49, 300)) AS k FROM d WHERE len(h) >= 100)),
p AS (SELECT doc_id, k + j AS i, substring(g, 2 * j + 1, 100) AS s FROM (SELECT doc_id, k, g, unnest(range(0, len(g) // 2 - 49)) AS j FROM segments)),
o AS (SELECT s, min(doc_id) AS owner FROM p GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT p.doc_id, p.i, p.i - lag(p.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS gap FROM p JOIN o ON p.s = o.s WHERE p.doc_id > o.owner),
runs AS (SELECT doc_id, i, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, r),
edges AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM spans
          UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id),
kept AS (SELECT e.doc_id, string_agg(substring(d.h, 2 * e.a + 1, 2 * (coalesce(e.b, len(d.h) // 2) - e.a)), '' ORDER BY e.a) AS k FROM edges e JOIN d ON e.doc_id = d.doc_id GROUP BY e.doc_id),
n AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n.n_removed, 0) AS BIGINT) AS n_removed, coalesce(n.n_spans, 0) AS n_spans,
       sha256(from_hex(coalesce(k.k, d.h))) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
    "op8_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), pat AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM pat),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)
), hits AS (SELECT q.doc_id, q.i, q.n, pat.item_id FROM places q JOIN pat ON q.n = pat.n AND q.p = pat.p),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.s, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
""",
    "op10_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY h)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.h AS payload_digest,
       CASE WHEN m.last <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.last <> p.page_id THEN m.last END AS refers_to
FROM p LEFT JOIN m ON p.h = m.h AND p.n >= 1000
""",
    "op11_spelling_variants": rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, r, count(*) AS n, CAST(doc_id AS VARCHAR) || ':' || r AS s
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents) GROUP BY doc_id, r
), hashed AS (SELECT r, n, {CRC.format(b=BYTES.format(s="s"))} AS h FROM runs, crc_table),
w AS (
  SELECT w, CAST(sum(n) AS BIGINT) AS n, length(w) AS l FROM (SELECT n, CASE WHEN h % 97 = 0 THEN left(r, h % length(r)) || substring(r, h % length(r) + 2) ELSE r END AS w FROM hashed)
  WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3
), cut AS (SELECT w, n, l, i, left(w, i - 1) || substring(w, i + 1) AS c FROM (SELECT *, unnest(range(1, l + 1)) AS i FROM w)),
near AS (
  SELECT a.w, b.w AS o, b.n FROM cut a JOIN cut b ON a.c = b.c AND a.i = b.i AND a.w <> b.w
  UNION SELECT a.w, b.w, b.n FROM cut a JOIN w b ON a.c = b.w
  UNION SELECT b.w, a.w, a.n FROM cut a JOIN w b ON a.c = b.w
), best AS (SELECT w, count(*) AS n_near, arg_min(o, struct_pack(n := -n, o := o)) AS o, max(n) AS m FROM near GROUP BY w),
formed AS (SELECT w.w, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 2 * w.n THEN b.o END AS form, CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n FROM w LEFT JOIN best b ON w.w = b.w),
walk(w, x) AS (SELECT w, w FROM formed UNION ALL SELECT k.w, f.form FROM walk k JOIN formed f ON k.x = f.w WHERE f.form IS NOT NULL),
roots AS (SELECT k.w, k.x AS root FROM walk k JOIN formed f ON k.x = f.w WHERE f.form IS NULL)
SELECT f.w AS word, f.form, r.root, f.n, f.n_near, CAST(f.form_n AS BIGINT) AS form_n FROM formed f JOIN roots r ON f.w = r.w
""",
    # A window of k words, k at least the period, stands again in a run after just the period.
    "op13_periodic_runs": rf"""
WITH RECURSIVE {CRC_TABLE},
own AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {CRC.format(b="list_transform(range(CAST(strlen(CAST(doc_id AS VARCHAR)) AS BIGINT)), lambda k: CAST(ascii(CAST(doc_id AS VARCHAR)[k + 1]) AS BIGINT))")} AS h FROM documents, crc_table
), seeded AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM own),
d AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM seeded
), grams(doc_id, n, k, hs) AS (
  SELECT doc_id, n, 1, list_transform(w, lambda x: hash(x)) FROM d WHERE n >= 24
  UNION ALL SELECT doc_id, n, 2 * k, list_transform(range(1, len(hs) - k + 1), lambda i: hash(hs[i], hs[i + k])) FROM grams WHERE n >= 3 * k
), gaps AS (
  SELECT doc_id, k, i - lag(i) OVER (PARTITION BY doc_id, k, x ORDER BY i) AS q
  FROM (SELECT doc_id, k, unnest(hs) AS x, unnest(range(len(hs))) AS i FROM grams WHERE k >= 8)
), periods AS (SELECT DISTINCT doc_id, q FROM gaps WHERE q <= k AND (k = 8 OR 2 * q > k)),
alike AS (
  SELECT doc_id, q, i FROM (SELECT p.doc_id, p.q, d.w, unnest(range(p.q, d.n)) AS i FROM periods p JOIN d ON p.doc_id = d.doc_id WHERE 3 * p.q <= d.n) WHERE w[i + 1] = w[i - q + 1]
), stretches AS (
  SELECT doc_id, q, min(i) - q AS s, count(*) + q AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS r FROM alike) GROUP BY doc_id, q, r
), runs AS (SELECT doc_id, s, n, min(q) AS q FROM stretches WHERE n >= greatest(24, 3 * q) GROUP BY doc_id, s, n),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS t, arg_min(struct_pack(s := s, n := n, q := q), struct_pack(e := -CAST(n AS DOUBLE) / q, s := s, q := q)) AS b FROM runs GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM runs),
kept AS (
  SELECT x.doc_id, string_agg(x.x, ' ' ORDER BY x.i) AS t
  FROM (SELECT d.doc_id, unnest(d.w) AS x, unnest(range(d.n)) AS i FROM d SEMI JOIN runs ON d.doc_id = runs.doc_id) x ANTI JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i GROUP BY x.doc_id
)
SELECT d.doc_id, coalesce(l.n_runs, 0) AS n_runs, CAST(l.b.s AS BIGINT) AS start, CAST(l.b.n AS BIGINT) AS length, CAST(l.b.q AS BIGINT) AS period,
       CAST(1000 * l.b.n // l.b.q AS BIGINT) AS exponent_milli, sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(k.t, array_to_string(d.w, ' '))) AS collapsed_sha256
FROM d LEFT JOIN listed l ON d.doc_id = l.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
}
