"""The registered table queries as DuckDB SQL, where it helps in another form than the operators'."""

from __future__ import annotations

FRAMES = """frames AS (
  SELECT user_id AS ep, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value, value / (value + 50.0) AS p,
         CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type AS kind FROM events
)"""
COUNTED = FRAMES + """, counted AS (
  SELECT *, count(*) OVER (PARTITION BY ep) AS n, greatest(1, (count(*) OVER (PARTITION BY ep)) // 4) AS q FROM frames
)"""
STATS = """SELECT ep, count(*) AS n, round(avg(p) FILTER (idx >= n - q), 6) AS p_done_late, round(max(p) FILTER (idx = n - 1), 6) AS p_done_final,
  round(max(p), 6) AS p_done_max, round(avg(p) FILTER (idx >= n - q) - avg(p) FILTER (idx < q), 6) AS p_done_rise FROM counted GROUP BY ep"""
LATE = "late AS (SELECT ep, avg(p) FILTER (idx >= n - q) AS late FROM counted GROUP BY ep)"
ORDER_SIGNAL = "seg AS (SELECT o_custkey AS ep, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END) AS seg_score FROM orders GROUP BY 1)"
CUSTOMER = "geo AS (SELECT CAST(c_custkey AS BIGINT) AS ep, c_acctbal > 0 AS any_hold FROM customer)"
MODELS = "models AS (SELECT ep, kind AS model, avg(p) AS score FROM frames GROUP BY 1, 2)"
TAGS = MODELS + ", tags AS (SELECT *, CASE WHEN score > 0.6 THEN 'success' ELSE 'failure' END AS tag FROM models)"
DOCS = """docs AS (
  SELECT d.doc_id, lang, source, CAST(n_chars AS DOUBLE) AS n_chars, CAST(len(string_split(text, ' ')) AS DOUBLE) AS n_words, quality,
         CASE WHEN quality = 1 THEN 'success' ELSE 'failure' END AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""
TAGGED = f"""WITH {COUNTED}, {LATE}, t AS (SELECT quantile_cont(late, 0.5) AS threshold FROM late),
tagged AS (SELECT ep, round(late, 6) AS late, round(threshold, 6) AS threshold, CASE WHEN late > threshold THEN 'success' ELSE 'failure' END AS tag FROM late, t)"""
SEG = """boxes AS (
  SELECT ep, idx, kind, value AS cx, CAST(k AS DOUBLE) AS cy, n, q, CASE WHEN kind = 'view' THEN value END AS bx, CASE WHEN kind = 'view' THEN CAST(k AS DOUBLE) END AS by_ FROM counted
)"""
CONSENSUS = """CASE WHEN 2 * n_success > n_votes THEN 'success' WHEN 2 * n_success < n_votes THEN 'failure' ELSE 'split' END AS consensus,
  concat(n_success, '/', n_votes) AS votes"""
LOW_RUNS = """runs AS (
  SELECT ep, min(idx) AS run_start, max(idx) + 1 AS run_end, count(*) AS run_length, max(k) AS k_max
  FROM (SELECT ep, idx, k, p < 0.8 AS low, sum(CASE WHEN (p < 0.8) IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY ep ORDER BY idx) AS r
        FROM (SELECT *, lag(p < 0.8) OVER (PARTITION BY ep ORDER BY idx) AS before FROM frames)) WHERE low GROUP BY ep, r
)"""
ATTEMPTS = """f AS (
  SELECT ep, idx, p, coalesce(abs(p - lag(p) OVER (PARTITION BY ep ORDER BY idx)) < 0.3, true) AS still,
         CASE WHEN kind <> 'purchase' THEN CASE WHEN p >= 0.8 THEN 1.0::DOUBLE ELSE 0.0 END END AS inside FROM frames
), g AS (
  SELECT *, sum(CASE WHEN still IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY ep ORDER BY idx) AS r
  FROM (SELECT *, lag(still) OVER (PARTITION BY ep ORDER BY idx) AS before FROM f)
), h AS (SELECT *, min(idx) OVER (PARTITION BY ep, r) AS a FROM g WHERE still),
rests AS (
  SELECT ep, min(idx) AS rest_start, max(idx) + 1 AS rest_end, coalesce(avg(inside) >= 0.5, false) AS "on", avg(inside) FILTER (idx < a + 6) AS seg, avg(p) FILTER (idx < a + 6) AS vlm
  FROM h GROUP BY ep, r HAVING count(*) >= 2
), moves AS (
  SELECT *, lead(rest_start) OVER w AS next_start, lead("on") OVER w AS next_on, lead(seg) OVER w AS next_seg, lead(vlm) OVER w AS next_vlm
  FROM rests WINDOW w AS (PARTITION BY ep ORDER BY rest_start)
)"""
SOURCES = """c AS (SELECT ep, idx FROM frames WHERE kind = 'click'), s AS (SELECT ep, idx, p FROM frames WHERE kind = 'view')"""
GRIPPER = """g0 AS (
  SELECT ep, idx, CASE WHEN (idx // 12) % 2 = 1 THEN 0.9 WHEN k % 29 = 0 THEN 0.001 WHEN k % 31 = 0 THEN 0.008 ELSE 0.02 END::DOUBLE AS obs,
         CASE WHEN ep % 10 = 0 OR kind = 'error' THEN NULL WHEN (idx // 12) % 2 = 1 AND k % 3 = 0 THEN 0.9 ELSE 0.1 END::DOUBLE AS cmd FROM frames
), g1 AS (
  SELECT *, count(*) OVER (PARTITION BY ep) AS n, count(cmd) OVER (PARTITION BY ep) > 0 AS usable, obs < 0.5 AS closed,
         coalesce(abs(obs - lag(obs, 3) OVER (PARTITION BY ep ORDER BY idx)) < 0.01, false) AS settled FROM g0
), g2 AS (SELECT *, CASE WHEN usable THEN coalesce(cmd < 0.5, false) ELSE closed END AS shut FROM g1),
g3 AS (SELECT *, shut AND closed AND obs > 0.01 AND settled AS raw FROM g2),
g4 AS (
  SELECT *, idx - row_number() OVER (PARTITION BY ep, raw ORDER BY idx) AS r FROM g3
), holds AS (SELECT ep, min(idx) AS s, max(idx) + 1 AS e, max(n) AS n, bool_or(usable) AS usable FROM g4 WHERE raw GROUP BY ep, r HAVING count(*) >= 6),
ended AS (
  SELECT h.ep, h.s, h.e, h.n, CASE WHEN h.e >= h.n THEN NULL
    WHEN h.usable AND bool_or(coalesce(f.cmd >= 0.5, false)) THEN 'release' WHEN bool_or(f.obs <= 0.006) THEN 'slip' ELSE 'ambiguous' END AS ending
  FROM holds h LEFT JOIN g3 f ON f.ep = h.ep AND f.idx >= h.e AND f.idx < h.e + 10 GROUP BY h.ep, h.s, h.e, h.n, h.usable
)"""


def _arm(tag: str, obs: str, cmd: str) -> str:
    """Holds of one arm: frames (ep, idx, holding, x) and holds with their ending."""
    return f"""{tag}0 AS (SELECT ep, idx, k, p, ({obs})::DOUBLE AS obs, ({cmd})::DOUBLE AS cmd FROM frames),
{tag}1 AS (SELECT *, count(*) OVER (PARTITION BY ep) AS n, count(cmd) OVER (PARTITION BY ep) > 0 AS usable, coalesce(abs(obs - lag(obs, 3) OVER (PARTITION BY ep ORDER BY idx)) < 0.01, false) AS settled FROM {tag}0),
{tag}2 AS (SELECT *, (CASE WHEN usable THEN coalesce(cmd < 0.5, false) ELSE obs < 0.5 END) AND obs < 0.5 AND obs > 0.01 AND settled AS raw FROM {tag}1),
{tag}3 AS (SELECT *, idx - row_number() OVER (PARTITION BY ep, raw ORDER BY idx) AS r FROM {tag}2),
{tag}h AS (SELECT ep, min(idx) AS s, max(idx) + 1 AS e, max(n) AS n, bool_or(usable) AS usable FROM {tag}3 WHERE raw GROUP BY ep, r HAVING count(*) >= 6),
{tag}e AS (SELECT h.ep, h.s, h.e, CASE WHEN h.e >= h.n THEN NULL WHEN h.usable AND bool_or(coalesce(f.cmd >= 0.5, false)) THEN 'release' WHEN bool_or(f.obs <= 0.006) THEN 'slip' ELSE 'ambiguous' END AS ending
  FROM {tag}h h LEFT JOIN {tag}2 f ON f.ep = h.ep AND f.idx >= h.e AND f.idx < h.e + 10 GROUP BY h.ep, h.s, h.e, h.n, h.usable),
{tag}f AS (SELECT f.ep, f.idx, f.k, f.p, h.ep IS NOT NULL AS holding FROM {tag}2 f LEFT JOIN {tag}h h ON f.ep = h.ep AND f.idx >= h.s AND f.idx < h.e)"""


LEFT = _arm("l", "CASE WHEN (idx // 12) % 2 = 1 THEN 0.9 WHEN k % 29 = 0 THEN 0.001 WHEN k % 31 = 0 THEN 0.008 ELSE 0.02 END", "CASE WHEN ep % 10 = 0 OR kind = 'error' THEN NULL WHEN (idx // 12) % 2 = 1 AND k % 3 = 0 THEN 0.9 ELSE 0.1 END")
RIGHT = _arm("r", "CASE WHEN (idx // 15) % 2 = 1 THEN 0.9 WHEN k % 23 = 0 THEN 0.001 ELSE 0.03 END", "NULL")


def _auroc(source: str, key: str, score: str, positive: str) -> str:
    return f"""SELECT {key}, count(*) FILTER ({positive}) AS n_pos, count(*) FILTER (NOT {positive}) AS n_neg,
  round((sum(CASE WHEN {positive} THEN rk ELSE 0 END) - count(*) FILTER ({positive}) * (count(*) FILTER ({positive}) + 1) / 2.0) / nullif(count(*) FILTER ({positive})::DOUBLE * count(*) FILTER (NOT {positive}), 0), 6) AS auroc
  FROM (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY {score}) + (count(*) OVER (PARTITION BY {key}, {score}) - 1) / 2.0 AS rk FROM {source}) GROUP BY {key}"""


ORACLE_SQL = {
    "vlm_late_features": f"WITH {COUNTED} {STATS}",
    "curve_array_features": f"WITH {COUNTED} SELECT * EXCLUDE (n) FROM ({STATS})",
    "stride_sample": f"WITH {FRAMES} SELECT ep, idx, round(p, 6) AS p FROM frames WHERE idx % 3 = 0",
    "frame_cap": f"WITH {FRAMES} SELECT ep, idx, round(p, 6) AS p FROM frames WHERE idx % 3 = 0 AND idx < 15",
    "median_calibrated_tags": f"{TAGGED} SELECT * FROM tagged",
    "prevalence": f"{TAGGED} SELECT count(*) AS n, count(*) FILTER (tag = 'success') AS n_success, count(*) FILTER (tag = 'failure') AS n_failure, round(avg(CASE WHEN tag = 'failure' THEN 1.0 ELSE 0.0 END), 6) AS failure_share FROM tagged",
    "softmax_pyes": """SELECT vec_id, round(y / (y + n), 6) AS p_yes FROM (
      SELECT vec_id, exp(embedding[1]::DOUBLE) + exp(embedding[2]::DOUBLE) AS y, exp(embedding[3]::DOUBLE) + exp(embedding[4]::DOUBLE) AS n FROM embeddings)""",
    "logprob_pyes": f"""WITH {FRAMES}, b AS (SELECT ep, idx // 10 AS block, coalesce(sum(p) FILTER (kind = 'view'), 0) AS y, coalesce(sum(p) FILTER (kind = 'error'), 0) AS n FROM frames GROUP BY 1, 2)
      SELECT ep, block, round(CASE WHEN y + n < 1e-9 THEN 0.5 ELSE y / (y + n) END, 6) AS p_yes, y + n < 1e-9 AS unresolved FROM b""",
    "top_tokens": """SELECT role, token, n, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, token) AS rank FROM (
        SELECT role, token, count(*) AS n FROM (SELECT role, unnest(string_split(lower(text), ' ')) AS token FROM conversations) WHERE token <> '' GROUP BY 1, 2)) WHERE rank <= 5""",
    "token_surfaces": "SELECT DISTINCT p_partkey AS id FROM part WHERE p_brand IN ('Brand#11', 'Brand#23')",
    "class_mean_gap": f"""WITH {DOCS}, long AS (SELECT 'n_chars' AS statistic, label, n_chars AS v FROM docs UNION ALL SELECT 'n_words', label, n_words FROM docs)
      SELECT statistic, round(avg(v) FILTER (label = 'success'), 6) AS success_mean, round(avg(v) FILTER (label = 'failure'), 6) AS failure_mean,
        round(avg(v) FILTER (label = 'success') - avg(v) FILTER (label = 'failure'), 6) AS gap FROM long GROUP BY statistic""",
    "task_labels": """WITH n AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ship_success' WHEN 'O' THEN 'ship_failure' ELSE 'ship' END AS name, o_orderpriority AS pr FROM orders)
      SELECT o_orderkey, CASE WHEN pr = '1-URGENT' THEN 'failure' WHEN name LIKE '%_success' THEN 'success' WHEN name LIKE '%_failure' THEN 'failure' END AS label,
        CASE WHEN o_orderkey % 3 = 0 THEN name ELSE 'none' END AS task FROM n""",
    "signal_outer_join": f"""WITH {COUNTED}, {LATE}, {ORDER_SIGNAL}, {CUSTOMER}
      SELECT coalesce(late.ep, seg.ep, geo.ep) AS ep, round(late, 6) AS late, round(seg_score, 6) AS seg_score, any_hold, CASE WHEN late.ep IS NOT NULL THEN 'vlm' WHEN seg.ep IS NOT NULL THEN 'seg' ELSE 'geo' END AS first_signal
      FROM late FULL JOIN seg ON late.ep = seg.ep FULL JOIN geo ON coalesce(late.ep, seg.ep) = geo.ep""",
    "calibrated_fusion": f"""WITH {COUNTED}, {LATE}, {ORDER_SIGNAL}, {CUSTOMER}, t AS (SELECT quantile_cont(late, 0.5) AS t FROM late),
      j AS (SELECT coalesce(late.ep, seg.ep, geo.ep) AS ep, late, seg_score, any_hold, t
            FROM late FULL JOIN seg ON late.ep = seg.ep FULL JOIN geo ON coalesce(late.ep, seg.ep) = geo.ep, t),
      c AS (SELECT *, (CASE WHEN late > t THEN 0.5 ELSE 0.0 END) + 0.5 * least(1.0, late / (2 * t)) AS v FROM j),
      m AS (SELECT *, CASE WHEN late IS NULL THEN seg_score WHEN seg_score IS NULL THEN v ELSE (v + seg_score) / 2 END AS mean FROM c),
      f AS (SELECT *, CASE WHEN mean IS NULL THEN NULL WHEN any_hold = false THEN 0.0 ELSE mean END AS fused FROM m)
      SELECT ep, round(late, 6) AS late, round(seg_score, 6) AS seg_score, any_hold, round(t, 6) AS threshold, CASE WHEN late > t THEN 'success' WHEN late IS NOT NULL THEN 'failure' END AS pred_vlm,
        CASE WHEN seg_score >= 0.5 THEN 'success' WHEN seg_score IS NOT NULL THEN 'failure' END AS pred_seg, round(fused, 6) AS fused_score,
        CASE WHEN fused >= 0.5 THEN 'success' WHEN fused IS NOT NULL THEN 'failure' END AS pred_fused FROM f""",
    "report_left_join": f"""WITH {COUNTED}, {LATE}, {ORDER_SIGNAL} SELECT late.ep, round(late, 6) AS late, round(seg_score, 6) AS seg_score, CASE WHEN late > 0.4 THEN 'success' ELSE 'failure' END AS pred
      FROM late LEFT JOIN seg ON late.ep = seg.ep""",
    "final_verdict": f"""WITH {FRAMES}, {MODELS}, {ORDER_SIGNAL}, v AS (SELECT ep, avg(score) AS m, count(*) AS c, count(*) FILTER (score >= 0.5) AS y FROM models GROUP BY ep),
      j AS (SELECT coalesce(v.ep, seg.ep) AS ep, seg_score, m, coalesce(c, 0) AS c, coalesce(y, 0) + CASE WHEN seg_score >= 0.5 THEN 1 ELSE 0 END AS y,
                   CASE WHEN m IS NULL THEN seg_score WHEN seg_score IS NULL THEN m ELSE (m + seg_score) / 2 END AS final FROM v FULL JOIN seg ON v.ep = seg.ep)
      SELECT ep, round(seg_score, 6) AS seg_score, round(m, 6) AS vlm_mean, c AS n_models, round(final, 6) AS final, CASE WHEN final >= 0.5 THEN 'success' ELSE 'failure' END AS tag,
        concat(y, '/', c + CASE WHEN seg_score IS NULL THEN 0 ELSE 1 END) AS votes FROM j""",
    "consensus_pivot": f"""WITH {FRAMES}, {TAGS}, c AS (SELECT ep, {", ".join(f"max(tag) FILTER (model = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view"))},
        count(*) FILTER (tag = 'success') AS n_success, count(*) AS n_votes FROM tags GROUP BY ep) SELECT *, {CONSENSUS} FROM c""",
    "vote_string": f"""WITH {FRAMES}, {MODELS}, c AS (SELECT ep, count(*) FILTER (score >= 0.6) AS n_success, count(*) AS n_votes FROM models GROUP BY ep) SELECT *, {CONSENSUS} FROM c""",
    "agreement_matrix": f"""WITH {FRAMES}, {TAGS} SELECT a.model AS model_a, b.model AS model_b, count(*) AS n_common, round(avg(CASE WHEN a.tag = b.tag THEN 1.0 ELSE 0.0 END), 6) AS agreement
      FROM tags a JOIN tags b ON a.ep = b.ep GROUP BY 1, 2""",
    "auroc_by_lang": f"WITH {DOCS} " + _auroc("docs", "lang", "n_chars", "quality = 1"),
    "accuracy_by_source": f"WITH {DOCS} SELECT source, count(*) AS n, round(avg(CASE WHEN (n_chars > 800) = (quality = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM docs GROUP BY source",
    "roc_points": f"""WITH {DOCS}, r AS (SELECT lang, row_number() OVER w AS point, sum(1 - quality) OVER w AS fp, sum(quality) OVER w AS tp, sum(1 - quality) OVER (PARTITION BY lang) AS n, sum(quality) OVER (PARTITION BY lang) AS p
        FROM docs WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING))
      SELECT lang, point, round(fp / greatest(n, 1), 6) AS fpr, round(tp / greatest(p, 1), 6) AS tpr FROM r UNION ALL SELECT DISTINCT lang, 0, 0.0, 0.0 FROM docs""",
    "group_summary": f"""WITH r AS (SELECT l_returnflag || '|' || l_linestatus AS g, l_returnflag AS dataset, l_linestatus AS model, l_discount * 10 AS late, l_tax * 12 AS peak,
        CASE WHEN l_quantity > 30 THEN 'success' WHEN l_quantity < 20 THEN 'failure' END AS label FROM lineitem),
      s AS (SELECT *, CASE WHEN dataset = 'A' THEN peak ELSE late END > 0.5 AS t FROM r),
      a AS ({_auroc("(SELECT * FROM r WHERE label IS NOT NULL)", "g", "late", "label = 'success'")})
      SELECT dataset, model, count(*) AS n, count(*) FILTER (t) AS n_success, count(*) FILTER (NOT t) AS n_failure, round(avg(CASE WHEN t THEN 0.0 ELSE 1.0 END), 6) AS failure_share,
        count(*) FILTER (late > 0.5) AS success_late, count(*) FILTER (peak > 0.5) AS success_max,
        round(avg(CASE WHEN t = (label = 'success') THEN 1.0 ELSE 0.0 END) FILTER (label IS NOT NULL), 6) AS accuracy, max(auroc) AS auroc
      FROM s JOIN a ON s.g = a.g GROUP BY dataset, model""",
    "feature_separation": f"""WITH {DOCS}, long AS (SELECT label, unnest(['n_chars', 'n_words', 'per_word']) AS feature, unnest([n_chars, n_words, n_chars / n_words]) AS v FROM docs),
      g AS (SELECT feature, avg(v) FILTER (label = 'success') AS s, avg(v) FILTER (label = 'failure') AS f, stddev_pop(v) AS sd FROM long GROUP BY feature)
      SELECT feature, round((s - f) / sd, 6) AS gap, round(s, 6) AS success_mean, round(f, 6) AS failure_mean FROM g""",
    "best_detection": f"""WITH {FRAMES} SELECT ep, kind, CAST(k AS BIGINT) AS k, idx, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY ep, kind ORDER BY k DESC, idx) AS rn FROM frames) WHERE rn = 1""",
    "prompt_objects": f"""WITH {FRAMES}, b AS (SELECT ep, idx // 10 AS block, idx, k, kind, kind IN ('purchase', 'view') AS hit FROM frames),
      r AS (SELECT *, row_number() OVER (PARTITION BY ep, block ORDER BY hit DESC, k DESC, idx) AS rn FROM b)
      SELECT ep, block, count(*) FILTER (hit) AS n_found, max(idx) FILTER (hit AND rn = 1) AS best_id, max(k::DOUBLE) FILTER (hit AND rn = 1) AS best_score FROM r GROUP BY ep, block""",
    "saucer_locf": f"""WITH {COUNTED}, {SEG}, l AS (SELECT *, last_value(bx IGNORE NULLS) OVER w AS lx, last_value(by_ IGNORE NULLS) OVER w AS ly, last_value(bx IGNORE NULLS) OVER a AS zx, last_value(by_ IGNORE NULLS) OVER a AS zy
        FROM boxes WINDOW w AS (PARTITION BY ep ORDER BY idx ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY ep ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
      SELECT ep, idx, round(coalesce(lx, zx) - 37.5, 6) AS x0, round(coalesce(ly, zy) + 37.5, 6) AS y1,
        cx BETWEEN coalesce(lx, zx) - 37.5 AND coalesce(lx, zx) + 37.5 AND cy BETWEEN coalesce(ly, zy) - 37.5 AND coalesce(ly, zy) + 37.5 AS inside, lx IS NULL AS no_box_yet FROM l""",
    "cup_on_saucer": f"""WITH {COUNTED}, {SEG}, v AS (SELECT ep, idx, bx, by_ FROM boxes WHERE bx IS NOT NULL), z AS (SELECT ep, arg_max(bx, idx) AS zx, arg_max(by_, idx) AS zy FROM v GROUP BY ep),
      l AS (SELECT b.ep, b.idx, b.n, b.q, b.kind <> 'error' AS there, b.cx, b.cy, coalesce(v.bx, z.zx) AS x, coalesce(v.by_, z.zy) AS y
            FROM boxes b ASOF LEFT JOIN v ON b.ep = v.ep AND b.idx >= v.idx LEFT JOIN z ON b.ep = z.ep),
      g AS (SELECT ep, max(n) AS n, avg(CASE WHEN there THEN 1.0::DOUBLE ELSE 0.0 END) AS present, avg(CASE WHEN there AND cx BETWEEN x - 90 AND x + 90 AND cy BETWEEN y - 90 AND y + 90 THEN 1.0::DOUBLE ELSE 0.0 END) AS s FROM l WHERE idx >= n - q GROUP BY ep)
      SELECT ep, n, true AS saucer_tracked, round(present, 6) AS cup_present_end, round(s, 6) AS cup_on_saucer, round(s, 6) AS seg_score, 'cup_on_saucer' AS seg_mode FROM g""",
    "fallback_displacement": f"""WITH {COUNTED}, f AS (SELECT ep, idx, n, q, CASE WHEN kind <> 'error' THEN value END AS x, CASE WHEN kind <> 'error' THEN k::DOUBLE END AS y FROM counted),
      g AS (SELECT ep, avg(CASE WHEN x IS NULL THEN 0.0::DOUBLE ELSE 1.0 END) FILTER (idx >= n - q) AS present, avg(x) FILTER (idx >= n - q) - avg(x) FILTER (idx < q) AS dx, avg(y) FILTER (idx >= n - q) - avg(y) FILTER (idx < q) AS dy FROM f GROUP BY ep),
      d AS (SELECT *, coalesce(sqrt(dx * dx + dy * dy) / 640.0, 0.0) AS d FROM g)
      SELECT ep, false AS saucer_tracked, round(present, 6) AS cup_present_end, round(d, 6) AS cup_displacement, CASE WHEN present >= 0.5 AND d >= 0.08 THEN 1.0::DOUBLE ELSE 0.0 END AS cup_settled,
        round(CASE WHEN present >= 0.5 THEN least(1.0, d / 0.16) ELSE 0.0 END, 6) AS seg_score, 'cup_settled(fallback)' AS seg_mode FROM d""",
    "mask_centroids": f"""WITH {FRAMES} SELECT ep, kind, count(*) FILTER (p > 0.9) AS area, round(avg(idx) FILTER (p > 0.9), 6) AS centroid_x, round(avg(k) FILTER (p > 0.9), 6) AS centroid_y FROM frames GROUP BY 1, 2""",
    "hold_runs": f"WITH {FRAMES}, {LOW_RUNS} SELECT ep, run_start, run_end, run_length, CAST(k_max AS BIGINT) AS k_max FROM runs WHERE run_length >= 3",
    "longest_run": f"WITH {FRAMES}, {LOW_RUNS} SELECT ep, run_start, run_end, run_length FROM (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY run_length DESC, run_start) AS rn FROM runs) WHERE rn = 1",
    "settled_frames": f"WITH {FRAMES} SELECT a.ep, count(*) FILTER (abs(a.p - b.p) < 0.05) AS n_settled FROM frames a LEFT JOIN frames b ON a.ep = b.ep AND a.idx = b.idx + 3 GROUP BY a.ep",
    "hold_ends": f"""WITH {FRAMES}, {GRIPPER}, a AS (
        SELECT ep, quantile_cont(CASE WHEN shut THEN obs END, 0.05) AS pool, quantile_cont(obs, 0.05) AS every, avg(CASE WHEN closed THEN 1.0 ELSE 0.0 END) AS closed_fraction, count(*) AS n, bool_or(usable) AS usable FROM g3 GROUP BY ep),
      w AS (SELECT g.ep, median(obs) AS width, count(*) AS held FROM g3 g JOIN holds h ON g.ep = h.ep AND g.idx >= h.s AND g.idx < h.e GROUP BY g.ep),
      e AS (SELECT ep, count(*) AS n_holds, max(e - s) AS longest, count(*) FILTER (ending = 'slip') AS slips, count(*) FILTER (ending = 'release') AS releases, count(*) FILTER (ending = 'ambiguous') AS amb, min(e) FILTER (ending = 'slip') AS first_slip FROM ended GROUP BY ep)
      SELECT a.ep, round(coalesce(pool, every), 6) AS closed_reading_p5, round(closed_fraction, 6) AS closed_fraction, round(coalesce(held, 0)::DOUBLE / n, 6) AS hold_fraction, coalesce(n_holds, 0) AS n_holds,
        round(coalesce(longest, 0) / 20.0, 6) AS longest_hold_s, round(width, 6) AS hold_width_median, coalesce(slips, 0) AS n_slips, coalesce(releases, 0) AS n_releases, coalesce(amb, 0) AS n_ambiguous_ends,
        first_slip AS first_slip_frame, usable AS cmd_gripper_available FROM a LEFT JOIN w ON a.ep = w.ep LEFT JOIN e ON a.ep = e.ep""",
    "both_holding": f"WITH {FRAMES} SELECT ep, round(avg(CASE WHEN p < 0.85 AND k < 60 THEN 1.0 ELSE 0.0 END), 6) AS both_fraction, count(*) FILTER (p < 0.85) AS n_left, count(*) FILTER (k < 60) AS n_right FROM frames GROUP BY ep",
    "bimanual": f"""WITH {FRAMES}, {LEFT}, {RIGHT}, b AS (
        SELECT l.ep, l.idx, l.holding AND r.holding AS two, l.holding OR r.holding AS any_, abs(l.p - l.k / 100.0) AS d FROM lf l JOIN rf r ON l.ep = r.ep AND l.idx = r.idx),
      h AS (SELECT ep, idx, d, idx - row_number() OVER (PARTITION BY ep ORDER BY idx) AS g FROM b WHERE two AND d < 0.3),
      u AS (SELECT ep, min(idx) AS s, count(*) AS n FROM h GROUP BY ep, g),
      v AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY n DESC, s) AS rn, count(*) OVER (PARTITION BY ep) AS runs FROM u),
      w AS (SELECT v.ep, v.n, v.runs, (2 * v.s + v.n) // 2 AS mid, h.d FROM v JOIN h ON v.ep = h.ep AND h.idx = (2 * v.s + v.n) // 2 WHERE rn = 1),
      e AS (SELECT ep, count(*) FILTER (ending = 'slip') AS slips, max(e) AS last FROM (SELECT * FROM le UNION ALL SELECT * FROM re) GROUP BY ep),
      t AS (SELECT ep, avg(CASE WHEN two THEN 1.0 ELSE 0.0 END) AS share, min(d) AS least, bool_or(any_) AS any_hold FROM b GROUP BY ep)
      SELECT t.ep, round(share, 6) AS both_holding_fraction, round(coalesce(n, 0) / 20.0, 6) AS longest_handover_s, coalesce(runs, 0) AS n_handover_candidates, CAST(mid AS BIGINT) AS handover_frame, n IS NOT NULL AS handover_detected,
        round(least, 6) AS min_hand_distance_m, round(w.d, 6) AS hand_distance_at_handover_m, any_hold, coalesce(slips, 0) AS total_slips, last AS last_hold_end_frame FROM t LEFT JOIN w ON t.ep = w.ep LEFT JOIN e ON t.ep = e.ep""",
    "nan_fields": f"""WITH {FRAMES}, {LEFT}, {RIGHT}, a AS (SELECT 'left' AS arm, ep, obs, cmd FROM l0 UNION ALL SELECT 'right', ep, obs, cmd FROM r0),
      m AS (SELECT DISTINCT ep, arm || '.' || field AS f FROM a, (VALUES ('obs_gripper'), ('cmd_gripper'), ('obs_ee_pose'), ('cmd_ee_pose')) v(field) WHERE (field = 'cmd_gripper' AND cmd IS NULL) OR (field LIKE '%pose' AND obs < 0.01))
      SELECT e.ep, coalesce(string_agg(f, ',' ORDER BY f), '') AS nan_fields FROM (SELECT DISTINCT ep FROM frames) e LEFT JOIN m ON e.ep = m.ep GROUP BY e.ep""",
    "arm_motion": f"""WITH {FRAMES}, s AS (SELECT ep, idx, value, p AS x, k / 100.0 AS y, lag(p) OVER w AS x0, lag(k / 100.0) OVER w AS y0, lead(p) OVER w AS x1, lead(k / 100.0) OVER w AS y1, count(*) OVER (PARTITION BY ep) AS n FROM frames WINDOW w AS (PARTITION BY ep ORDER BY idx)),
      g AS (SELECT *, sqrt((x - x0) ** 2 + (y - y0) ** 2) AS step, CASE WHEN n = 1 THEN NULL WHEN x0 IS NULL THEN sqrt((x1 - x) ** 2 + (y1 - y) ** 2) WHEN x1 IS NULL THEN sqrt((x - x0) ** 2 + (y - y0) ** 2) ELSE sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) / 2 END AS grad FROM s)
      SELECT ep, round(avg(grad) * 20, 6) AS ee_speed_mean, round(max(grad) * 20, 6) AS ee_speed_max, round(coalesce(sum(step), 0), 6) AS ee_path_length_m, round(avg(value / 1000), 6) AS track_err_mean, round(max(value / 1000), 6) AS track_err_max FROM g GROUP BY ep""",
    "motion_states": f"""WITH {COUNTED}, {SEG}, m AS (SELECT ep, cx, cy, coalesce(abs(cx - lag(cx) OVER w) / 0.5 < 200, true) AS still, last_value(bx IGNORE NULLS) OVER u AS bx, last_value(by_ IGNORE NULLS) OVER u AS by_
        FROM boxes WINDOW w AS (PARTITION BY ep ORDER BY idx), u AS (PARTITION BY ep ORDER BY idx ROWS UNBOUNDED PRECEDING)),
      i AS (SELECT ep, still, CASE WHEN bx IS NULL THEN NULL WHEN cx BETWEEN bx - 37.5 AND bx + 37.5 AND cy BETWEEN by_ - 37.5 AND by_ + 37.5 THEN 1.0 ELSE 0.0 END AS inside FROM m)
      SELECT ep, count(*) FILTER (still) AS n_still, CAST(sum(inside) AS DOUBLE) AS n_inside, count(inside) AS n_known FROM i GROUP BY ep""",
    "prefix_traces": f"WITH {FRAMES} SELECT ep, idx, count(*) OVER w AS n, round(sum(p) OVER w, 6) AS total FROM frames WINDOW w AS (PARTITION BY ep ORDER BY idx ROWS UNBOUNDED PRECEDING)",
    "first_top_tokens": f"""WITH {FRAMES}, h AS (SELECT kind, ep, string_agg(CAST(k AS VARCHAR), ',' ORDER BY idx) AS tokens FROM frames WHERE k > 95 GROUP BY 1, 2), f AS (SELECT kind, min(ep) AS ep FROM h GROUP BY 1)
      SELECT h.kind AS dataset, 'm' AS model, CAST(h.ep AS BIGINT) AS episode, tokens FROM h JOIN f ON h.kind = f.kind AND h.ep = f.ep""",
    "veto_list": "SELECT count(*) AS n, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS episodes FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal <= 0",
    "seg_only_prevalence": f"""WITH {ORDER_SIGNAL} SELECT c_mktsegment AS dataset, count(*) AS n, count(*) FILTER (seg_score >= 0.5) AS n_success, count(*) FILTER (seg_score < 0.5) AS n_failure, round(avg(CASE WHEN seg_score < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS failure_share
      FROM seg JOIN customer ON ep = c_custkey GROUP BY 1""",
    "verdict_headline": f"""WITH {FRAMES}, {MODELS}, {ORDER_SIGNAL}, v AS (SELECT ep, avg(score) AS m FROM models GROUP BY ep),
      j AS (SELECT m, seg_score, CASE WHEN m IS NULL THEN seg_score WHEN seg_score IS NULL THEN m ELSE (m + seg_score) / 2 END >= 0.5 AS ok FROM v FULL JOIN seg ON v.ep = seg.ep)
      SELECT count(*) AS episodes, count(m) AS with_models, count(*) FILTER (ok) AS n_success, count(*) FILTER (NOT ok) AS n_failure, round(count(*) FILTER (NOT ok) / count(ok)::DOUBLE, 6) AS failure_share,
        count(*) FILTER (m IS NOT NULL AND seg_score IS NOT NULL) AS full_n, count(*) FILTER (m IS NOT NULL AND seg_score IS NOT NULL AND ok) AS full_success, count(*) FILTER (m IS NOT NULL AND seg_score IS NOT NULL AND NOT ok) AS full_failure FROM j""",
    "scores_by_label": f"WITH {DOCS} SELECT source, label, count(*) AS n, round(avg(n_chars), 6) AS mean, min(n_chars) AS least, max(n_chars) AS most FROM docs GROUP BY 1, 2",
    "sampled_scan": f"""WITH {FRAMES}, s AS (SELECT ep, idx, p, row_number() OVER (PARTITION BY ep ORDER BY idx) - 1 AS sample FROM frames WHERE idx % 5 = 0)
      SELECT s.ep, idx, round(p, 6) AS p, sample, count(*) OVER (PARTITION BY s.ep) AS n_sampled, c_mktsegment FROM s LEFT JOIN customer ON s.ep = c_custkey WHERE sample < 12""",
    "handover": f"""WITH {FRAMES}, h AS (SELECT ep, idx, idx - row_number() OVER (PARTITION BY ep ORDER BY idx) AS r FROM frames WHERE p < 0.85 AND k < 60 AND abs(value - k) < 250),
      u AS (SELECT ep, min(idx) AS s, max(idx) + 1 AS e FROM h GROUP BY ep, r), v AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY e - s DESC, s) AS rn, count(*) OVER (PARTITION BY ep) AS n FROM u)
      SELECT ep, n AS n_handovers, e - s AS longest, (s + e) // 2 AS frame FROM v WHERE rn = 1""",
    "p5_median": """SELECT l_suppkey, round(coalesce(quantile_cont(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END, 0.05), quantile_cont(l_extendedprice, 0.05)), 6) AS p5, round(median(l_quantity), 6) AS median_quantity FROM lineitem GROUP BY 1""",
    "gradient_speed": f"""WITH {FRAMES}, g AS (SELECT a.ep, abs(CASE WHEN b.p IS NULL THEN c.p - a.p WHEN c.p IS NULL THEN a.p - b.p ELSE (c.p - b.p) / 2 END) AS g
        FROM frames a LEFT JOIN frames b ON a.ep = b.ep AND b.idx = a.idx - 1 LEFT JOIN frames c ON a.ep = c.ep AND c.idx = a.idx + 1)
      SELECT ep, round(avg(g) * 30.0, 6) AS speed_mean, round(max(g) * 30.0, 6) AS speed_max FROM g GROUP BY ep""",
    "path_length": """WITH s AS (SELECT label, sqrt(list_sum(list_transform(list_zip(e, lag(e) OVER (PARTITION BY label ORDER BY vec_id)), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
        FROM (SELECT label, vec_id, list_transform(embedding[1:3], lambda x: x::DOUBLE) AS e FROM embeddings))
      SELECT CAST(label AS BIGINT) AS label, round(coalesce(sum(d), 0), 6) AS path, round(max(d), 6) AS longest_step, count(*) AS n FROM s GROUP BY 1""",
    "tracking_error": """WITH s AS (SELECT label, sqrt(pow(embedding[1]::DOUBLE - embedding[33]::DOUBLE, 2) + pow(embedding[2]::DOUBLE - embedding[34]::DOUBLE, 2) + pow(embedding[3]::DOUBLE - embedding[35]::DOUBLE, 2)) AS d FROM embeddings)
      SELECT CAST(label AS BIGINT) AS label, round(avg(d), 6) AS err_mean, round(max(d), 6) AS err_max FROM s GROUP BY 1""",
    "camera_frame": """SELECT vec_id, round((embedding[2]::DOUBLE + 0.25) - 0.5 * (embedding[3]::DOUBLE - 1) / 4, 6) AS x, round((embedding[1]::DOUBLE - 0.5) / -2, 6) AS y, round((embedding[3]::DOUBLE - 1) / 4, 6) AS z FROM embeddings""",
    "nan_missing": """SELECT l_returnflag, round(avg(nullif(l_tax, 0)), 6) AS tax_mean, round(min(nullif(l_tax, 0)), 6) AS tax_min, round(max(nullif(l_tax, 0)), 6) AS tax_max, round(avg(l_discount), 6) AS discount_mean,
      CASE WHEN count(*) FILTER (l_tax = 0) > 0 THEN 'tax' ELSE '' END AS nan_fields FROM lineitem GROUP BY 1""",
    "interp_resample": f"""WITH {FRAMES}, {SOURCES}, a AS (SELECT c.ep, c.idx, s.idx AS i0, s.p AS p0 FROM c ASOF LEFT JOIN s ON c.ep = s.ep AND c.idx >= s.idx),
      b AS (SELECT a.*, s.idx AS i1, s.p AS p1 FROM a ASOF LEFT JOIN s ON a.ep = s.ep AND a.idx <= s.idx)
      SELECT ep, idx, round(CASE WHEN i0 IS NULL THEN p1 WHEN i1 IS NULL THEN p0 WHEN i0 = i1 THEN p0 ELSE p0 + (p1 - p0) * (idx - i0) / (i1 - i0) END, 6) AS p FROM b""",
    "held_asof": f"""WITH {FRAMES}, {SOURCES}, f AS (SELECT ep, arg_min(p, idx) AS p0 FROM s GROUP BY ep)
      SELECT c.ep, c.idx, round(coalesce(s.p, f.p0), 6) AS p FROM c ASOF LEFT JOIN s ON c.ep = s.ep AND c.idx >= s.idx LEFT JOIN f ON c.ep = f.ep""",
    "forward_window": f"""WITH {FRAMES}, e AS (SELECT ep, idx FROM frames WHERE kind = 'error'), m AS (SELECT ep, max(idx) AS last FROM e GROUP BY ep)
      SELECT f.ep, count(*) FILTER (EXISTS (SELECT 1 FROM e WHERE e.ep = f.ep AND e.idx BETWEEN f.idx AND f.idx + 4)) AS n_soon, count(*) FILTER (m.last IS NULL OR m.last < f.idx) AS n_never
      FROM frames f LEFT JOIN m ON f.ep = m.ep GROUP BY f.ep""",
    "even_pick": f"""WITH {COUNTED} SELECT ep, idx, CAST(k AS BIGINT) AS k FROM counted WHERE idx % greatest(1, n // 8) = 0 AND idx // greatest(1, n // 8) < 8""",
    "prefer_populated": f"""WITH {FRAMES}, a AS (SELECT ep, max(k) > 96 AS hits FROM frames GROUP BY ep) SELECT f.ep, count(*) AS n, CAST(min(k) AS BIGINT) AS k_min FROM frames f JOIN a ON f.ep = a.ep WHERE NOT hits OR k > 96 GROUP BY f.ep""",
    "progress_axis": f"WITH {COUNTED} SELECT ep, idx, round(coalesce(idx::DOUBLE / nullif(n - 1, 0), 0.0), 6) AS progress FROM counted",
    "rest_transitions": f"""WITH {FRAMES}, {ATTEMPTS} SELECT ep, rest_start, rest_end, "on", next_start, next_on, CASE WHEN "on" THEN 'return' ELSE 'attempt' END AS kind FROM moves WHERE next_start IS NOT NULL""",
    "attempts": f"""WITH {FRAMES}, {ATTEMPTS}, t AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY rest_start) AS attempt FROM moves WHERE next_start IS NOT NULL AND NOT "on")
      SELECT ep, attempt, rest_end - 1 AS start_at, next_start AS settle_at, round((next_start - rest_end + 1) * 0.5, 6) AS carry_s, round(next_seg, 6) AS seg, round(next_vlm, 6) AS vlm,
        CASE WHEN (CASE WHEN next_seg IS NULL THEN next_vlm ELSE (next_seg + next_vlm) / 2 END) >= 0.5 THEN 'success' ELSE 'failure' END AS tag, rest_end - 1 AS start_pos, next_start AS settle_pos FROM t""",
    "role_changes": """SELECT a.role AS before, b.role, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) a
      JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) b ON a.conv_id = b.conv_id AND b.rn = a.rn + 1 WHERE a.role <> b.role GROUP BY 1, 2""",
    "group_to_sequence": """SELECT conv_id, count(*) AS n, string_agg(role, '>' ORDER BY turn) AS roles, round(30.0 / greatest(1, CASE WHEN count(*) > 1 THEN list(turn ORDER BY turn)[2] - min(turn) ELSE 30 END), 6) AS fps FROM conversations GROUP BY conv_id""",
    "ragged_pad": """WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations),
      m AS (SELECT *, max(len(w)) OVER (PARTITION BY conv_id) AS width FROM w)
      SELECT conv_id, max(width) AS width, string_agg(array_to_string(list_transform(range(1, width + 1), lambda i: coalesce(w[i], '_')), ' '), '|' ORDER BY turn) AS rows FROM m WHERE width > 0 GROUP BY conv_id""",
    "skip_completed": """SELECT o_orderkey, o_custkey FROM orders o WHERE NOT (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O'))""",
    "missing_models": f"WITH {FRAMES} SELECT DISTINCT ep, kind AS model FROM frames EXCEPT SELECT ep, kind FROM frames WHERE p > 0.75",
    "preset_filters": """SELECT 'brass' AS preset, p_partkey, p_brand FROM part WHERE regexp_matches(p_type, 'BRASS|STEEL|COPPER') AND regexp_full_match(p_brand, 'Brand#[123][123]')
      UNION ALL SELECT 'large', p_partkey, p_brand FROM part WHERE p_size > 40 AND p_brand = 'Brand#11'""",
    "prefix_limit": "SELECT c_name, CAST(c_custkey AS BIGINT) AS c_custkey FROM customer WHERE c_name LIKE 'Customer#0000001%' ORDER BY c_name LIMIT 20",
    "prompt_words": """SELECT doc_id, len(list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> '')) AS n_prompts,
      len(list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: contains(lower(x), 'the ') OR contains(lower(x), 'der '))) > 0 AS has_word FROM documents""",
    "sidecar_offsets": """SELECT source, doc_id, n_chars AS nbytes, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM documents""",
    "json_extract": """SELECT event_type, CAST(sum(k) AS BIGINT) AS k_sum, CAST(max(k) AS BIGINT) AS k_max, count(k) AS n FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) GROUP BY 1""",
    "run_counters": f"""WITH {FRAMES} SELECT count(DISTINCT ep) AS episodes, count(*) AS frames, count(*) FILTER (kind = 'error') AS skipped, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM frames""",
    "null_skipping_mean": """SELECT o_orderkey, round(CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice * 0.75 WHEN o_orderkey % 2 = 0 THEN o_totalprice WHEN o_orderkey % 3 = 0 THEN o_totalprice / 2 END, 6) AS m FROM orders""",
}
