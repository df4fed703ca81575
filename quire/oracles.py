"""DuckDB SQL for the queries, over the same tables."""

from __future__ import annotations

V_DET = """v_det AS (
  SELECT (l_orderkey // 16)::BIGINT AS page_id,
         row_number() OVER (PARTITION BY l_orderkey // 16 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS det_idx,
         (l_partkey % 400)::DOUBLE AS x, ((l_suppkey * 37) % 600)::DOUBLE AS y,
         (10 + l_quantity)::DOUBLE AS width, (10 + (l_partkey * 7) % 60)::DOUBLE AS height,
         ((l_partkey * 13 + l_suppkey) % 97) / 97.0::DOUBLE AS score
  FROM lineitem)"""

V_TRUTH = """v_truth AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY det_idx) - 1 AS ref_idx, x + 2 AS x,
         y + CASE WHEN det_idx % 9 = 0 THEN 5000.0::DOUBLE ELSE 1.0::DOUBLE END AS y, width, height,
         'line ' || (det_idx % 7) || ' of the page' AS text
  FROM v_det WHERE det_idx % 3 = 0)"""

V_PRED = """v_pred AS (
  SELECT page_id, det_idx AS pred_idx, x, y, width, height,
         CASE WHEN det_idx % 13 = 5 THEN '  ' ELSE 'line ' || (det_idx % 5) || ' of the page' END AS text,
         score AS recognition_score, det_idx % 11 <> 0 AS ended_with_eos, det_idx * 7 % 101 AS reading_order
  FROM v_det)"""

# DuckDB's levenshtein counts bytes: texts are coded with one byte for each distinct character, of which the tables have
# fewer than 128.
V_TEXT = """v_chars AS (
  SELECT DISTINCT unnest(string_split(coalesce(text, '') || 'cèнe~', '')) AS ch FROM documents),
v_code AS (
  SELECT string_agg(ch, '' ORDER BY k) AS wide, string_agg(chr(k), '' ORDER BY k) AS narrow
  FROM (SELECT ch, row_number() OVER (ORDER BY ch)::INTEGER AS k FROM v_chars)),
v_text AS (
  SELECT doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), wide, narrow) AS s, n_chars FROM documents CROSS JOIN v_code)"""

V_PAIR = V_TEXT + """,
v_pair AS (
  SELECT * FROM (SELECT doc_id, s AS a, lead(s) OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) AS b FROM v_text) WHERE b IS NOT NULL)"""

V_CAND = V_TEXT + """,
v_line AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS line_idx FROM v_text),
v_read AS (
  SELECT doc_id, line_idx, ord, CASE ord WHEN 0 THEN line WHEN 1 THEN translate(line, 'eéио', 'cèнe') ELSE line || '~' END AS text
  FROM v_line CROSS JOIN (SELECT unnest(range(3)) AS ord)),
v_cand AS (
  SELECT doc_id, line_idx, doc_id * 1000000 + line_idx AS line_id, ord, text, translate(text, wide, narrow) AS s,
         (n % 89) / 89.0::DOUBLE AS recognition_score, (n % 47) / 47.0::DOUBLE AS minimum_token_score,
         (n % 31) / 10.0::DOUBLE AS mean_token_margin,
         CASE WHEN n % 5 <> 0 THEN (n % 23) / 23.0::DOUBLE END AS eos_score, n % 4 <> 0 AS ended_with_eos,
         CASE WHEN ord % 2 = 0 THEN 'original' ELSE 'padded' END AS preprocessing,
         (10 + n % 300)::DOUBLE AS width, (5 + ord * 7)::DOUBLE AS height
  FROM (SELECT *, length(text) + doc_id AS n FROM v_read) CROSS JOIN v_code),
v_util AS (
  SELECT *, recognition_score * 0.65::DOUBLE + minimum_token_score * 0.2::DOUBLE
            + (1 - exp(-greatest(0.0::DOUBLE, mean_token_margin))) * 0.15::DOUBLE
            - CASE WHEN ended_with_eos THEN 0 ELSE 0.12::DOUBLE END - CASE WHEN text <> '' THEN 0 ELSE 0.08::DOUBLE END
            - CASE WHEN coalesce(eos_score, CASE WHEN ended_with_eos THEN 1 ELSE 0 END) < 0.2 THEN 0.04::DOUBLE ELSE 0 END AS u
  FROM v_cand)"""


def inter(a: str, b: str) -> str:
    side = lambda p, s: f"greatest(0.0::DOUBLE, least({a}.{p} + {a}.{s}, {b}.{p} + {b}.{s}) - greatest({a}.{p}, {b}.{p}))"
    return f"({side('x', 'width')} * {side('y', 'height')})"


def area(a: str) -> str:
    return f"(greatest(0.0::DOUBLE, {a}.width) * greatest(0.0::DOUBLE, {a}.height))"


def iou(a: str, b: str) -> str:
    union = f"({area(a)} + {area(b)} - {inter(a, b)})"
    return f"(CASE WHEN {union} > 0 THEN {inter(a, b)} / {union} ELSE 0.0::DOUBLE END)"


def smaller(a: str, b: str) -> str:
    least = f"least({area(a)}, {area(b)})"
    return f"(CASE WHEN {least} > 0 THEN {inter(a, b)} / {least} ELSE 0.0::DOUBLE END)"


PAIRS = f"WITH {V_DET} SELECT a.page_id, a.det_idx AS a_idx, b.det_idx AS b_idx, round({{m}}, 6) AS overlap FROM v_det a JOIN v_det b ON a.page_id = b.page_id AND a.det_idx < b.det_idx WHERE {{m}} >= {{t}}"

# greedy matching: the pairs in order, and a step per pair
MATCH = f"""{V_DET}, {V_TRUTH}, {V_PRED},
pairs AS (
  SELECT p.page_id, p.pred_idx, t.ref_idx, {iou("p", "t")} AS iou FROM v_pred p JOIN v_truth t USING (page_id) WHERE {iou("p", "t")} >= 0.1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY iou DESC, pred_idx, ref_idx) AS rn FROM pairs),
greedy AS (
  SELECT page_id, 0::BIGINT AS rn, []::BIGINT[] AS ps, []::BIGINT[] AS rs, false AS taken FROM (SELECT DISTINCT page_id FROM ranked)
  UNION ALL
  SELECT r.page_id, r.rn,
         CASE WHEN NOT list_contains(g.ps, r.pred_idx) AND NOT list_contains(g.rs, r.ref_idx) THEN list_append(g.ps, r.pred_idx) ELSE g.ps END,
         CASE WHEN NOT list_contains(g.ps, r.pred_idx) AND NOT list_contains(g.rs, r.ref_idx) THEN list_append(g.rs, r.ref_idx) ELSE g.rs END,
         NOT list_contains(g.ps, r.pred_idx) AND NOT list_contains(g.rs, r.ref_idx)
  FROM greedy g JOIN ranked r ON r.page_id = g.page_id AND r.rn = g.rn + 1),
matched AS (SELECT r.page_id, r.pred_idx, r.ref_idx, r.iou FROM greedy g JOIN ranked r USING (page_id, rn) WHERE g.taken)"""

COUNTS = """counts AS (
  SELECT page_id, sum(p)::BIGINT AS predicted, sum(t)::BIGINT AS reference, sum(m)::BIGINT AS true_positive FROM (
    SELECT page_id, 1 AS p, 0 AS t, 0 AS m FROM v_pred UNION ALL SELECT page_id, 0, 1, 0 FROM v_truth UNION ALL SELECT page_id, 0, 0, 1 FROM matched)
  GROUP BY page_id),
prf AS (
  SELECT *, CASE WHEN reference > 0 THEN true_positive / reference::DOUBLE ELSE 0 END AS recall,
         CASE WHEN predicted > 0 THEN true_positive / predicted::DOUBLE ELSE 0 END AS precision FROM counts)"""
PRF = "page_id, predicted, reference, true_positive, round(recall, 6) AS recall, round(precision, 6) AS precision, round(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END, 6) AS f1"

ORDERED = """ordered AS (
  SELECT m.page_id, m.ref_idx, row_number() OVER (PARTITION BY m.page_id ORDER BY p.reading_order, m.pred_idx) AS o FROM matched m JOIN v_pred p USING (page_id, pred_idx)),
concordant AS (
  SELECT a.page_id, sum(CASE WHEN a.ref_idx < b.ref_idx THEN 1 ELSE 0 END)::DOUBLE AS good, count(*) AS n FROM ordered a JOIN ordered b ON a.page_id = b.page_id AND a.o < b.o GROUP BY a.page_id),
accuracy AS (
  SELECT o.page_id, CASE WHEN c.n IS NULL THEN 1.0::DOUBLE ELSE c.good / c.n END AS order_accuracy FROM (SELECT DISTINCT page_id FROM ordered) o LEFT JOIN concordant c USING (page_id))"""


def clamp(v: str, lo: str, hi: str) -> str:
    return f"least({hi}, greatest({lo}, {v}))"


CLEAR = f"""{V_DET},
near AS (
  SELECT a.page_id, a.det_idx,
         CASE WHEN a.height > a.width THEN a.x - (b.x + b.width) ELSE a.y - (b.y + b.height) END AS before,
         CASE WHEN a.height > a.width THEN b.x - (a.x + a.width) ELSE b.y - (a.y + a.height) END AS after
  FROM v_det a JOIN v_det b USING (page_id)
  WHERE CASE WHEN a.height > a.width THEN least(a.y + a.height, b.y + b.height) > greatest(a.y, b.y) ELSE least(a.x + a.width, b.x + b.width) > greatest(a.x, b.x) END),
limits AS (
  SELECT page_id, det_idx, min(before) FILTER (before >= 0) AS before, min(after) FILTER (after >= 0) AS after FROM near GROUP BY page_id, det_idx),
clear AS (SELECT v.*, l.before, l.after FROM v_det v LEFT JOIN limits l USING (page_id, det_idx))"""

EXPANDED = f"""{CLEAR},
sized AS (
  SELECT *, height > width AS v, greatest(height, width) * 0.04::DOUBLE AS lp,
         least(least(height, width) * 0.08::DOUBLE, coalesce(before / 2, 1e300)) AS bp, least(least(height, width) * 0.08::DOUBLE, coalesce(after / 2, 1e300)) AS ap FROM clear),
padded AS (
  SELECT page_id, det_idx, x - CASE WHEN v THEN bp ELSE lp END AS px, y - CASE WHEN v THEN lp ELSE bp END AS py,
         width + CASE WHEN v THEN bp ELSE lp END + CASE WHEN v THEN ap ELSE lp END AS pw, height + CASE WHEN v THEN lp ELSE bp END + CASE WHEN v THEN lp ELSE ap END AS ph FROM sized),
corner AS (SELECT *, {clamp("px", "0", "440")} AS x1, {clamp("py", "0", "640")} AS y1 FROM padded),
expanded AS (
  SELECT page_id, det_idx, x1 AS x, y1 AS y, {clamp("px + pw", "x1", "440")} - x1 AS width, {clamp("py + ph", "y1", "640")} - y1 AS height FROM corner)"""


def whole(x: str, y: str, w: str, h: str, iw: str, ih: str, source: str, keep: str) -> str:
    return f"""SELECT {keep}, x1 AS x, y1 AS y, {clamp(f"ceil({x} + {w})", "x1", iw)} - x1 AS width, {clamp(f"ceil({y} + {h})", "y1", ih)} - y1 AS height
  FROM (SELECT *, {clamp(f"floor({x})", "0", iw)} AS x1, {clamp(f"floor({y})", "0", ih)} AS y1 FROM {source})"""


def laid(source: str) -> str:
    """Writing mode, oriented measures and blocks of a set of boxes."""
    return f"""{V_DET},
boxes AS ({source}),
modes AS (SELECT page_id, count(*) AS n, count(*) FILTER (height > width * 1.2) >= ceil(count(*) / 2.0) AS v FROM boxes GROUP BY page_id),
turned AS (
  SELECT b.page_id, b.det_idx, m.v, m.n, CASE WHEN v THEN x + width / 2 ELSE y + height / 2 END AS t, CASE WHEN v THEN y + height / 2 ELSE x + width / 2 END AS l,
         CASE WHEN v THEN y ELSE x END AS s, CASE WHEN v THEN height ELSE width END AS sp, CASE WHEN v THEN width ELSE height END AS ac
  FROM boxes b JOIN modes m USING (page_id)),
spans AS (SELECT *, min(sp) OVER (PARTITION BY page_id) AS lo, max(sp) OVER (PARTITION BY page_id) AS hi FROM turned),
cuts AS (
  SELECT *, CASE WHEN n < 4 OR lo <= 0 OR hi / lo < 1.8 THEN 0
                 WHEN s - lag(s + sp) OVER (PARTITION BY page_id ORDER BY l - sp / 2, det_idx) >= greatest(6.0, lo * 0.04::DOUBLE) THEN 1 ELSE 0 END AS cut FROM spans),
blocks AS (SELECT *, sum(cut) OVER (PARTITION BY page_id ORDER BY l - sp / 2, det_idx) AS block FROM cuts)"""


def order_sql(source: str) -> str:
    return f"""WITH RECURSIVE {laid(source)},
thresholds AS (SELECT page_id, greatest(4.0::DOUBLE, list_sort(list(ac))[len(list(ac)) // 2 + 1] * 0.65::DOUBLE) AS thr FROM blocks GROUP BY page_id),
items AS (SELECT b.*, thr, row_number() OVER (PARTITION BY page_id, block ORDER BY t, l, det_idx) AS rn FROM blocks b JOIN thresholds USING (page_id)),
walk AS (
  SELECT page_id, block, 0::BIGINT AS rn, []::STRUCT(total DOUBLE, n BIGINT)[] AS bands, 0::BIGINT AS at FROM (SELECT DISTINCT page_id, block FROM items)
  UNION ALL
  SELECT page_id, block, rn, CASE WHEN hit IS NULL THEN list_append(bands, {{'total': t, 'n': 1::BIGINT}})
           ELSE list_transform(bands, lambda b, i: CASE WHEN i = hit THEN {{'total': b.total + t, 'n': b.n + 1}} ELSE b END) END,
         coalesce(hit, len(bands) + 1)
  FROM (SELECT w.page_id, w.block, i.rn, w.bands, i.t,
               list_min(list_filter(list_transform(w.bands, lambda b, k: CASE WHEN abs(b.total / b.n - i.t) <= i.thr THEN k END), lambda k: k IS NOT NULL)) AS hit
        FROM walk w JOIN items i ON i.page_id = w.page_id AND i.block = w.block AND i.rn = w.rn + 1)),
last AS (SELECT page_id, block, arg_max(bands, rn) AS bands FROM walk GROUP BY page_id, block)
SELECT i.page_id, i.det_idx, row_number() OVER (PARTITION BY i.page_id ORDER BY i.block,
         CASE WHEN i.v THEN -(z.bands[w.at].total / z.bands[w.at].n) ELSE z.bands[w.at].total / z.bands[w.at].n END, w.at, i.l, i.det_idx) - 1 AS reading_order
FROM items i JOIN walk w ON w.page_id = i.page_id AND w.block = i.block AND w.rn = i.rn JOIN last z ON z.page_id = i.page_id AND z.block = i.block"""


LOGITS = """positions AS (
  SELECT vec_id, unnest(range(8)) AS position, embedding FROM embeddings),
classes AS (
  SELECT vec_id, position, unnest(range(8)) AS class, embedding FROM positions),
logits AS (SELECT vec_id, position, class, embedding[position * 8 + class + 1]::DOUBLE * {scale} AS v FROM classes),
tops AS (SELECT *, max(v) OVER (PARTITION BY vec_id, position) AS top FROM logits),
soft AS (SELECT vec_id, position, class, v - top - ln(greatest(sum(exp(v - top)) OVER (PARTITION BY vec_id, position), 1e-12)) AS lp FROM tops)"""

CLUSTERS = f"""{V_CAND},
walk AS (
  SELECT line_id, -1::BIGINT AS ord, []::STRUCT(texts VARCHAR[], ords BIGINT[])[] AS cl FROM (SELECT DISTINCT line_id FROM v_util)
  UNION ALL
  SELECT line_id, ord, CASE WHEN hit IS NULL THEN list_append(cl, {{'texts': [s], 'ords': [ord]}})
           ELSE list_transform(cl, lambda c, i: CASE WHEN i = hit THEN {{'texts': list_append(c.texts, s), 'ords': list_append(c.ords, ord)}} ELSE c END) END
  FROM (SELECT w.line_id, v.ord, v.s, w.cl,
               list_min(list_filter(list_transform(w.cl, lambda c, k: CASE WHEN len(list_filter(c.texts, lambda o:
                 CASE WHEN greatest(length(o), length(v.s)) <= 1 THEN o = v.s
                      ELSE levenshtein(o, v.s) <= greatest(1, floor(greatest(length(o), length(v.s)) * 0.25)) END)) > 0 THEN k END), lambda k: k IS NOT NULL)) AS hit
        FROM walk w JOIN v_util v ON v.line_id = w.line_id AND v.ord = w.ord + 1)),
final AS (SELECT line_id, arg_max(cl, ord) AS cl FROM walk GROUP BY line_id),
members AS (
  SELECT line_id, ci, unnest(c.ords) AS ord FROM (SELECT line_id, unnest(cl) AS c, unnest(range(1, len(cl) + 1)) AS ci FROM final)),
joined AS (SELECT m.ci, v.* FROM members m JOIN v_util v USING (line_id, ord)),
best AS (
  SELECT line_id, ci, count(DISTINCT preprocessing) AS kinds, count(*) AS n,
         arg_min(ord, [-round(u, 8), CASE WHEN preprocessing = 'original' THEN 0 ELSE 1 END, ord]) AS ord, max(u) AS u FROM joined GROUP BY line_id, ci),
won AS (
  SELECT * FROM (SELECT *, max(kinds) OVER (PARTITION BY line_id) AS most, sum(n) OVER (PARTITION BY line_id) AS total,
                        row_number() OVER (PARTITION BY line_id ORDER BY kinds DESC, n DESC, u DESC, ci) AS place FROM best) WHERE place = 1),
chosen AS (
  SELECT w.line_id, w.ord, v.text, w.total - 1 AS n_alternatives, NOT (total > 1 AND most >= 2) AND total > 1 AS uncertain,
         CASE WHEN total > 1 AND most >= 2 THEN 'consensus'
              WHEN v.preprocessing = 'original' AND EXISTS (SELECT 1 FROM v_util o WHERE o.line_id = w.line_id AND o.ord <> w.ord AND abs(o.u - v.u) <= 1e-9) THEN 'original-tie'
              ELSE 'score' END AS reason
  FROM won w JOIN v_util v USING (line_id, ord))"""


def joined_piece(a: str, b: str) -> str:
    """Text of two pieces at their best overlap (null if there is none), as a scalar subquery."""
    distance = f"(levenshtein(right({a}, n), left({b}, n)) / n::DOUBLE)"
    best = f"(SELECT n FROM (SELECT unnest(range(1, least(24, length({a}), length({b})) + 1)) AS n) WHERE {distance} <= CASE WHEN n = 1 THEN 0 ELSE 0.34 END ORDER BY round({distance}, 9), n DESC LIMIT 1)"
    return f"(CASE WHEN {best} IS NULL AND {a} <> '' AND {b} <> '' THEN NULL ELSE {a} || substr({b}, coalesce({best}, 0)::BIGINT + 1) END)"


METRIC = "(o_totalprice * {i} % 1000 / 1000)"
NAMES = ("cer", "exact_rate", "recall", "precision", "f1", "order_accuracy", "empty_rate", "error_detection_rate")
SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

ORACLES: dict[str, str] = {
    "box_iou_pairs": PAIRS.format(m=iou("a", "b"), t=0.1),
    "box_overlap_smaller": PAIRS.format(m=smaller("a", "b"), t=0.5),
    "detection_filter": f"""WITH {V_DET},
raw AS (SELECT page_id, det_idx, score, (x - 20) * 2 AS x1, (y - 20) * 2 AS y1, (x - 20 + width) * 2 AS x2, (y - 20 + height) * 2 AS y2 FROM v_det WHERE score > 0.24),
inside AS (
  SELECT *, greatest(1.0::DOUBLE, (y2 - y1) * 0.02::DOUBLE) AS pad FROM raw
  WHERE x2 > x1 AND y2 > y1 AND (x1 + x2) / 2 >= 0 AND (y1 + y2) / 2 >= 0 AND (x1 + x2) / 2 < 780 AND (y1 + y2) / 2 < 1100),
cut AS (
  SELECT *, {clamp("x1", "0", "780")} AS x, {clamp("y1 - pad", "0", "1100")} AS y, {clamp("x2", "0", "780")} - {clamp("x1", "0", "780")} AS width,
         {clamp("y2 + pad", "0", "1100")} - {clamp("y1 - pad", "0", "1100")} AS height FROM inside)
SELECT page_id, det_idx, round(score, 6) AS score, round(x, 6) AS x, round(y, 6) AS y, round(width, 6) AS width, round(height, 6) AS height FROM cut
WHERE width >= 4 AND height >= 4 AND width * height / ((x2 - x1) * (y2 - y1 + 2 * pad)) >= 0.65""",
    "global_nms": f"""WITH RECURSIVE {V_DET},
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, det_idx) AS rn FROM v_det),
blockers AS (
  SELECT o.page_id, o.rn, list(k.rn) FILTER (k.rn IS NOT NULL) AS by FROM ranked o LEFT JOIN ranked k
    ON k.page_id = o.page_id AND k.rn < o.rn AND ({iou("o", "k")} >= 0.5 OR {smaller("o", "k")} >= 0.9) GROUP BY o.page_id, o.rn),
walk AS (
  SELECT page_id, 0::BIGINT AS rn, []::BIGINT[] AS kept, false AS keep FROM (SELECT DISTINCT page_id FROM ranked)
  UNION ALL
  SELECT b.page_id, b.rn, CASE WHEN list_has_any(w.kept, coalesce(b.by, [])) THEN w.kept ELSE list_append(w.kept, b.rn) END, NOT list_has_any(w.kept, coalesce(b.by, []))
  FROM walk w JOIN blockers b ON b.page_id = w.page_id AND b.rn = w.rn + 1)
SELECT page_id, det_idx, x, y, width, height, round(score, 6) AS score, row_number() OVER (PARTITION BY page_id ORDER BY rn) - 1 AS rank
FROM walk JOIN ranked USING (page_id, rn) WHERE keep""",
    "orientation_vote": f"""WITH {V_DET}, votes AS (SELECT page_id, count(*) FILTER (height >= width * 1.5) AS n_vertical, count(*) FILTER (width >= height * 1.5) AS n_horizontal FROM v_det GROUP BY page_id)
SELECT *, CASE WHEN n_vertical >= n_horizontal THEN 'vertical' ELSE 'horizontal' END AS orientation FROM votes""",
    "writing_mode_vote": f"""WITH {V_DET}, votes AS (SELECT page_id, count(*) AS n, count(*) FILTER (height > width * 1.2) AS n_vertical FROM v_det GROUP BY page_id)
SELECT *, CASE WHEN n_vertical >= ceil(n / 2.0) THEN 'vertical' ELSE 'horizontal' END AS mode FROM votes""",
    "crop_bounds": f"""WITH {V_DET}, s AS (SELECT page_id, det_idx, x * 1.37::DOUBLE AS a, y * 1.21::DOUBLE AS b, width * 1.13::DOUBLE AS c, height * 0.91::DOUBLE AS d FROM v_det)
{whole("a", "b", "c", "d", "500", "650", "s", "page_id, det_idx")}""",
    "crop_clearance": f"WITH {CLEAR} SELECT page_id, det_idx, round(before, 6) AS before, round(after, 6) AS after FROM clear",
    "crop_expand": f"WITH {EXPANDED} SELECT page_id, det_idx, round(x, 6) AS x, round(y, 6) AS y, round(width, 6) AS width, round(height, 6) AS height FROM expanded",
    "crop_url": f"""WITH {EXPANDED},
inner_ AS ({whole("x", "y", "width", "height", "440", "640", "expanded", "page_id, det_idx")}),
scaled AS (SELECT page_id, det_idx, x * 2 AS a, y * 2.5::DOUBLE AS b, width * 2 AS c, height * 2.5::DOUBLE AS d FROM inner_),
outer_ AS ({whole("a", "b", "c", "d", "880", "1600", "scaled", "page_id, det_idx")})
SELECT page_id, det_idx, 'https://images.example/' || page_id || '/' || x::BIGINT || ',' || y::BIGINT || ',' || width::BIGINT || ',' || height::BIGINT || '/!1024,1024/0/default.jpg' AS url FROM outer_""",
    "percent_crop_url": f"""WITH {V_DET},
placed AS (SELECT *, {clamp("floor(x / 4 / 100 * 1234 + 0.5)", "0", "1233")} AS px, {clamp("floor(y / 6 / 100 * 987 + 0.5)", "0", "986")} AS py FROM v_det)
SELECT page_id, det_idx, 'https://images.example/p/' || px::BIGINT || ',' || py::BIGINT || ',' || ({clamp("floor(width / 4 / 100 * 1234 + 0.5)", "1", "1234 - px")})::BIGINT || ','
       || ({clamp("floor(height / 6 / 100 * 987 + 0.5)", "1", "987 - py")})::BIGINT || '/!512,512/0/default.jpg' AS url FROM placed""",
    "layout_blocks": f"WITH {laid('SELECT * REPLACE (width / 8 AS width, height / 8 AS height) FROM v_det')} SELECT page_id, det_idx, block::BIGINT AS block FROM blocks",
    "reading_order": order_sql("SELECT * FROM v_det"),
    "reading_order_sparse": order_sql("SELECT * REPLACE (width / 8 AS width, height / 8 AS height) FROM v_det"),
    "tiles_topk": f"""WITH {V_DET},
regions AS (SELECT *, CASE WHEN page_id % 2 = 0 THEN 420.0::DOUBLE ELSE 900.0::DOUBLE END AS w, 640.0::DOUBLE AS h FROM v_det),
grid AS (SELECT DISTINCT page_id, w, h, CASE WHEN h > w * 1.15 THEN 3 ELSE 2 END AS rows_, CASE WHEN h > w * 1.15 THEN 1 ELSE 2 END AS cols FROM regions),
r AS (SELECT *, unnest(range(rows_)) AS r FROM grid), rc AS (SELECT *, unnest(range(cols)) AS c FROM r),
raw AS (
  SELECT *, c * (w / cols) - CASE WHEN c > 0 THEN w / cols * 0.15::DOUBLE ELSE 0 END AS x0, r * (h / rows_) - CASE WHEN r > 0 THEN h / rows_ * 0.15::DOUBLE ELSE 0 END AS y0,
         w / cols * (1 + CASE WHEN c > 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN c < cols - 1 THEN 0.15::DOUBLE ELSE 0 END) AS w0,
         h / rows_ * (1 + CASE WHEN r > 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN r < rows_ - 1 THEN 0.15::DOUBLE ELSE 0 END) AS h0 FROM rc),
tile AS (
  SELECT page_id, r || '-' || c AS tile_id, x, y, greatest(x, least(w, x0 + w0)) - x AS width, greatest(y, least(h, y0 + h0)) - y AS height
  FROM (SELECT *, {clamp("x0", "0", "w")} AS x, {clamp("y0", "0", "h")} AS y FROM raw)),
scored AS (
  SELECT t.page_id, t.tile_id, any_value(t.x) AS x, any_value(t.y) AS y, any_value(t.width) AS width, any_value(t.height) AS height, sum({inter("t", "g")}) AS coverage
  FROM tile t JOIN regions g USING (page_id) GROUP BY t.page_id, t.tile_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY round(coverage, 6) DESC, tile_id) AS rank FROM scored WHERE coverage > 0)
SELECT page_id, tile_id, round(x, 6) AS x, round(y, 6) AS y, round(width, 6) AS width, round(height, 6) AS height, round(coverage, 6) AS coverage, rank FROM ranked WHERE rank <= 2""",
    "tile_restore": f"""WITH {V_DET}, c AS (SELECT *, {clamp("200 + x", "0", "420")} AS x1, {clamp("300 + y", "0", "640")} AS y1 FROM v_det)
SELECT page_id, det_idx, x1 AS x, y1 AS y, greatest(x1, least(420, 200 + x + width)) - x1 AS width, greatest(y1, least(640, 300 + y + height)) - y1 AS height FROM c""",
    "paper_score": f"""WITH {V_DET}, {V_TRUTH}, paper AS (SELECT page_id, x, y, width * 3 AS width, height * 3 AS height FROM v_truth)
SELECT b.page_id, b.det_idx, round(CASE WHEN b.page_id % 5 = 0 OR count(p.x) = 0 THEN 0.5 ELSE least(1.0, max({inter("b", "p")} / {area("b")})) END, 6)::DOUBLE AS paper_score
FROM v_det b LEFT JOIN paper p USING (page_id) GROUP BY b.page_id, b.det_idx""",
    "line_windows": f"""WITH {V_DET},
lines AS (SELECT page_id, det_idx, x, y, width * 8 AS width, height / 2 AS height FROM v_det),
s AS (SELECT *, height > width AS v, greatest(width, height) AS lg, greatest(1.0, least(width, height)) AS sh FROM lines),
n AS (SELECT *, CASE WHEN lg / sh < 8 THEN 1 ELSE least(4, greatest(2, ceil(lg / (sh * 4))::BIGINT)) END AS cnt FROM s),
w AS (SELECT *, unnest(range(cnt)) AS index, lg / (cnt - (cnt - 1) * 0.2::DOUBLE) AS wl FROM n),
p AS (
  SELECT *, CASE WHEN v THEN x ELSE x + least(lg - wl, index * wl * 0.8::DOUBLE) END AS nx, CASE WHEN v THEN y + least(lg - wl, index * wl * 0.8::DOUBLE) ELSE y END AS ny,
         CASE WHEN v THEN width ELSE wl END AS nw, CASE WHEN v THEN wl ELSE height END AS nh FROM w),
q AS (SELECT *, {clamp("nx", "0", "640")} AS x1, {clamp("ny", "0", "600")} AS y1 FROM p)
SELECT page_id, det_idx, index, round(CASE WHEN cnt = 1 THEN x ELSE x1 END, 6) AS x, round(CASE WHEN cnt = 1 THEN y ELSE y1 END, 6) AS y,
       round(CASE WHEN cnt = 1 THEN width ELSE least(640, greatest(x1, nx + nw)) - x1 END, 6) AS width,
       round(CASE WHEN cnt = 1 THEN height ELSE least(600, greatest(y1, ny + nh)) - y1 END, 6) AS height FROM q""",
    "ink_gap": """WITH samples AS (SELECT vec_id, label, unnest(range(64)) AS i, embedding FROM embeddings),
marked AS (SELECT vec_id, i, NOT (i >= 14 + vec_id % 20 AND i <= 14 + vec_id % 20 + 8 + label) AND abs(embedding[i + 1])::DOUBLE + 0.08::DOUBLE >= 0.08 AS active FROM samples),
islands AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS island FROM marked WHERE NOT active),
runs AS (SELECT vec_id, min(i) AS start, max(i) + 1 AS "end" FROM islands GROUP BY vec_id, island),
fit AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY "end" - start DESC, start) AS k FROM runs
  WHERE "end" - start >= 8 AND start >= 12 AND 64 - "end" >= 12 AND least(start, 64 - "end") / greatest(start, 64 - "end")::DOUBLE <= 0.55)
SELECT vec_id, start, "end" FROM fit WHERE k = 1""",
    "log_softmax": f"WITH {LOGITS.format(scale='1')} SELECT vec_id, position, class, round(lp, 6) AS log_p FROM soft",
    "decode_scores": f"""WITH {LOGITS.format(scale="20")},
spots AS (
  SELECT vec_id, position, arg_min(class, [-lp, class]) AS best, max(lp) AS top, list_sort(list(lp), 'DESC')[2] AS second,
         greatest(1e-12, least(1.0::DOUBLE, exp(max(lp)))) AS p, greatest(1e-12, least(1.0::DOUBLE, exp(max(lp) FILTER (class = 0)))) AS eos FROM soft GROUP BY vec_id, position),
ends AS (SELECT vec_id, min(position) FILTER (best = 0) AS e FROM spots GROUP BY vec_id),
used AS (SELECT s.*, e.e, best <> 0 AS token FROM spots s JOIN ends e USING (vec_id) WHERE e.e IS NULL OR position <= e.e),
sums AS (
  SELECT vec_id, any_value(e) IS NOT NULL AS ended_with_eos, coalesce(string_agg(substr('ABCDEFG', best::BIGINT, 1), '' ORDER BY position) FILTER (token), '') AS text,
         sum(-ln(p)) AS nll, count(*) AS n, arg_max(eos, position) AS eos_score, min(p) FILTER (token) AS least_p, avg(greatest(0.0, top - second)) FILTER (token) AS margin FROM used GROUP BY vec_id)
SELECT vec_id, text, round(CASE WHEN ended_with_eos THEN exp(-nll / n) ELSE exp(-(nll - ln(eos_score)) / (n + 1)) END, 6) AS recognition_score,
       round(coalesce(least_p, eos_score), 6) AS minimum_token_score, round(coalesce(margin, 0), 6) AS mean_token_margin, round(eos_score, 6) AS eos_score, ended_with_eos FROM sums""",
    "low_confidence": f"""WITH {V_CAND} SELECT doc_id, line_idx, ord, regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') = '' OR NOT ended_with_eos OR recognition_score < 0.58 OR minimum_token_score < 0.28
 OR mean_token_margin < 0.35 OR (greatest(width, height) / greatest(1.0, least(width, height)) >= 8 AND length(text) < 2) AS low FROM v_cand""",
    "candidate_utility": f"WITH {V_CAND} SELECT doc_id, line_idx, ord, round(u, 6) AS utility FROM v_util",
    "candidate_top_score": f"WITH {V_CAND} SELECT doc_id, line_idx, ord, text FROM v_cand QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY recognition_score DESC, ord) = 1",
    "candidate_consensus": f"WITH RECURSIVE {CLUSTERS} SELECT line_id // 1000000 AS doc_id, line_id % 1000000 AS line_idx, ord, text, n_alternatives::BIGINT AS n_alternatives, uncertain, reason FROM chosen",
    "strategy_compare": f"""WITH RECURSIVE {CLUSTERS},
tops AS (SELECT line_id, text FROM v_cand QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY recognition_score DESC, ord) = 1)
SELECT line_id // 1000000 AS doc_id, line_id % 1000000 AS line_idx, c.text AS consensus_text, t.text AS score_text, c.text <> t.text AS differs FROM chosen c JOIN tops t USING (line_id)""",
    "edit_distance": f"WITH {V_PAIR} SELECT doc_id, levenshtein(a, b)::BIGINT AS distance FROM v_pair",
    "edit_distance_norm": f"WITH {V_PAIR} SELECT doc_id, round(CASE WHEN greatest(length(a), length(b)) > 0 THEN levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE ELSE 0 END, 6) AS distance FROM v_pair",
    "cer": f"WITH {V_PAIR} SELECT doc_id, round(CASE WHEN length(a) > 0 THEN levenshtein(a, b) / length(a)::DOUBLE WHEN length(b) > 0 THEN 1 ELSE 0 END, 6) AS cer FROM v_pair",
    "segment_merge": f"""WITH {V_TEXT},
pieces AS (
  SELECT doc_id, substr(s, 1, k + 5) AS p1, substr(s, k + 1, k + 5) AS p2, substr(s, 2 * k + 1) AS p3
  FROM (SELECT *, length(s) // 3 AS k FROM v_text)),
two AS (SELECT doc_id, {joined_piece("p1", "p2")} AS m, p3 FROM pieces),
three AS (SELECT doc_id, {joined_piece("m", "p3")} AS merged FROM two)
SELECT doc_id, translate(merged, narrow, wide) AS merged FROM three CROSS JOIN v_code""",
    "line_search": f"""WITH lines AS (SELECT conv_id, turn, regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') AS line FROM conversations)
SELECT conv_id, turn, instr(line, 'tion') - 1 AS position, length(line) AS n_chars FROM lines WHERE contains(line, 'tion')""",
    "empty_rate": f"""WITH lines AS (SELECT conv_id, CASE WHEN turn % 5 = 4 THEN ' ' || chr(9) || chr(12288) ELSE text END AS text FROM conversations)
SELECT conv_id, round(avg(CASE WHEN regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') = '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS empty_rate FROM lines GROUP BY conv_id""",
    "dict_normalize": """SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, 'tion', 'sch'),
 'é', 'e'), 'è', 'e'), 'ê', 'e'), 'à', 'a'), 'ä', 'a'), 'ó', 'o'), 'ö', 'o'), 'n', 'ñ'), 'ü', 'u'), 'ú', 'u'), 'x', 'q'), 'q', 'k') AS text FROM documents""",
    "dict_search": f"""WITH entries(entry_idx, terms) AS (VALUES (0::BIGINT, ['e', 'é', 'è', 'ê']), (1, ['a', 'à', 'ä']), (2, ['sch', 'tion']), (3, ['o', 'ó', 'ö']), (4, ['ñ', 'n']), (5, ['u', 'ü', 'ú']), (6, ['q', 'x']), (7, ['k', 'q'])),
terms AS (SELECT entry_idx, unnest(terms) AS term FROM entries),
docs AS (SELECT doc_id, regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') AS t FROM documents),
forms AS (SELECT doc_id, t FROM docs UNION SELECT doc_id, nfc_normalize(t) FROM docs)
SELECT doc_id, entry_idx, min(instr(t, term) - 1) AS position FROM forms JOIN terms ON contains(t, term) WHERE t <> '' GROUP BY doc_id, entry_idx
UNION ALL SELECT doc_id, entry_idx, -1 FROM docs CROSS JOIN entries WHERE t = ''""",
    "region_match": f"WITH RECURSIVE {MATCH} SELECT page_id, pred_idx, ref_idx, round(iou, 6) AS iou FROM matched",
    "detection_prf": f"WITH RECURSIVE {MATCH}, {COUNTS} SELECT {PRF} FROM prf",
    "unmatched_pred": f"WITH RECURSIVE {MATCH} SELECT page_id, pred_idx FROM v_pred ANTI JOIN matched USING (page_id, pred_idx)",
    "missed_truth": f"WITH RECURSIVE {MATCH} SELECT page_id, ref_idx FROM v_truth ANTI JOIN matched USING (page_id, ref_idx)",
    "order_accuracy": f"WITH RECURSIVE {MATCH}, {ORDERED} SELECT page_id, round(order_accuracy, 6) AS order_accuracy FROM accuracy",
    "page_metrics": f"""WITH RECURSIVE {MATCH}, {COUNTS}, {ORDERED},
compared AS (
  SELECT t.page_id, length(t.text) AS chars, levenshtein(t.text, coalesce(p.text, '')) AS edits, (t.text = coalesce(p.text, ''))::INT AS exact_, 1 AS line
  FROM v_truth t LEFT JOIN matched m USING (page_id, ref_idx) LEFT JOIN v_pred p ON p.page_id = t.page_id AND p.pred_idx = m.pred_idx
  UNION ALL SELECT page_id, 0, length(text), 0, 0 FROM v_pred ANTI JOIN matched USING (page_id, pred_idx)),
texts AS (SELECT page_id, sum(chars)::BIGINT AS chars, sum(edits)::BIGINT AS edits, sum(exact_) AS ex, sum(line) AS ln FROM compared GROUP BY page_id),
empties AS (SELECT page_id, avg(CASE WHEN trim(text) = '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS empty_rate FROM v_pred GROUP BY page_id),
errors AS (
  SELECT p.page_id, 1 AS e, (p.recognition_score < 0.58 OR NOT p.ended_with_eos)::INT AS l FROM v_pred p LEFT JOIN matched m USING (page_id, pred_idx)
    LEFT JOIN v_truth t ON t.page_id = p.page_id AND t.ref_idx = m.ref_idx WHERE t.text IS NULL OR t.text <> p.text
  UNION ALL SELECT page_id, 1, 0 FROM v_truth ANTI JOIN matched USING (page_id, ref_idx)),
rates AS (SELECT page_id, sum(l) / sum(e)::DOUBLE AS rate FROM errors GROUP BY page_id)
SELECT {PRF}, round(CASE WHEN chars > 0 THEN edits / chars::DOUBLE WHEN edits > 0 THEN 1 ELSE 0 END, 6) AS cer, round(CASE WHEN ln > 0 THEN ex / ln::DOUBLE ELSE 0 END, 6) AS exact_rate,
       chars AS reference_characters, edits AS edit_distance, round(coalesce(order_accuracy, 0), 6) AS order_accuracy, round(coalesce(empty_rate, 0), 6) AS empty_rate,
       round(coalesce(rate, 0), 6) AS error_detection_rate
FROM prf LEFT JOIN texts USING (page_id) LEFT JOIN accuracy USING (page_id) LEFT JOIN empties USING (page_id) LEFT JOIN rates USING (page_id)""",
    "screen_averages": f"""WITH {V_DET} SELECT page_id, floor(avg(CASE WHEN det_idx % 4 <> 0 THEN score ELSE score / 2 END) * 100 + 0.5)::BIGINT AS recognition_percent,
 floor(avg(score / 2) * 100 + 0.5)::BIGINT AS detection_percent FROM v_det GROUP BY page_id""",
    "json_props": "SELECT event_id, event_type, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(TRY_CAST(json_extract(props, '$.k') AS BIGINT) >= 0, false) AS valid FROM events",
    "run_determinism": """WITH a AS (SELECT o_orderkey AS canvas_id, o_custkey AS payload FROM orders WHERE o_orderkey % 3 <> 1),
b AS (SELECT o_orderkey AS canvas_id, o_custkey + (o_orderkey % 5 = 0)::INT AS payload FROM orders WHERE o_orderkey % 3 <> 2),
j AS (SELECT coalesce(a.canvas_id, b.canvas_id) AS canvas_id, CASE WHEN a.canvas_id IS NULL THEN 'missing in first' WHEN b.canvas_id IS NULL THEN 'missing in second'
 WHEN a.payload IS DISTINCT FROM b.payload THEN 'differs' END AS why FROM a FULL JOIN b ON a.canvas_id = b.canvas_id)
SELECT * FROM j WHERE why IS NOT NULL""",
    "baseline_delta": "SELECT o_orderkey AS canvas_id, "
    + ", ".join(f"round(((o_orderkey + {i}) % 50) / 50::DOUBLE - {METRIC.format(i=i + 1)}, 6) AS {n}" for i, n in enumerate(NAMES))
    + " FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0",
    "cache_latest": "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) = 1",
    "cache_key_hash": """WITH chars AS (SELECT doc_id, list_transform(list_filter(string_split(coalesce(text, ''), ''), lambda c: c <> ''), lambda c: unicode(c)::BIGINT) AS cs FROM documents),
units AS (SELECT doc_id, flatten(list_transform(cs, lambda c: CASE WHEN c > 65535 THEN [55296 + (c - 65536) // 1024, 56320 + c % 1024] ELSE [c] END)) AS us FROM chars)
SELECT doc_id, lpad(lower(hex(list_reduce(list_prepend(2166136261::BIGINT, us), lambda h, c: (xor(h, c) * 16777619) & 4294967295))), 8, '0') AS hash FROM units""",
    "upper_median": "SELECT l_orderkey, round(list_sort(list(l_quantity))[count(*) // 2 + 1], 6) AS median FROM lineitem GROUP BY l_orderkey",
    "floor_percentile": "SELECT l_orderkey, "
    + ", ".join(f"round(list_sort(list(l_extendedprice))[floor((count(*) - 1) * {p}::DOUBLE)::BIGINT + 1], 6) AS p{int(p * 100)}" for p in (0.05, 0.82, 0.95))
    + " FROM lineitem GROUP BY l_orderkey",
    "manifest_pages": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT 'https://m.example/biblio/' || o_custkey || '/manifest' AS source_url, i AS canvas_index, 'canvas/' || o_orderkey AS canvas_id, 'https://s.example/' || o_orderkey AS image_service_id,
       CASE WHEN o_orderkey % 4 <> 0 THEN 'page ' || o_orderkey ELSE (i + 1)::VARCHAR END AS label, 'https://s.example/' || o_orderkey || '/full/1200,/0/default.jpg' AS image,
       (o_orderkey % 1000)::DOUBLE AS width FROM o WHERE o_orderkey % 6 <> 0""",
    "manifests": """WITH u AS (SELECT 'https://m.example/biblio/' || o_custkey || '/manifest' AS url, o_custkey, count(*) FILTER (o_orderkey % 6 <> 0) AS n_pages FROM orders GROUP BY o_custkey)
SELECT url AS source_url, url, '無題のIIIF資料' AS title, 'm.example' AS attribution, o_custkey::VARCHAR AS record_id, n_pages, 'right-to-left' AS viewing_direction,
       CASE WHEN n_pages = 0 THEN 'no pages' END AS error FROM u""",
    "ground_truth_lines": f"""WITH {V_DET}, {V_TRUTH}
SELECT page_id::VARCHAR AS canvas_id, ref_idx, text, x, y, width, height FROM v_truth WHERE page_id NOT IN (SELECT page_id FROM v_truth WHERE ref_idx = page_id % 60)""",
    "nfkc": "SELECT doc_id, nfc_normalize(text) AS text FROM documents",
    "csv_lines": f"""WITH {V_DET}, {V_PRED}
SELECT page_id::VARCHAR AS "canvasId", pred_idx AS "lineIndex", repeat(',', 10) || page_id || ',' || pred_idx || ',,,"a ""q"", ' || text || '",,,,,,' || ended_with_eos || repeat(',', 13) AS line FROM v_pred""",
    "merge_adjacent": f"""WITH RECURSIVE {V_DET},
votes AS (SELECT page_id, count(*) FILTER (height >= width * 1.5) >= count(*) FILTER (width >= height * 1.5) AS v FROM v_det GROUP BY page_id),
items AS (
  SELECT page_id, v, {{'x': x, 'y': y, 'width': width, 'height': height, 'score': score}} AS b,
         row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN v THEN y ELSE x END, CASE WHEN v THEN x ELSE y END, det_idx) AS k
  FROM v_det JOIN votes USING (page_id)),
walk AS (
  SELECT page_id, v, 1::BIGINT AS k, b AS cur, []::STRUCT(x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE, score DOUBLE)[] AS open FROM items WHERE k = 1
  UNION ALL
  SELECT s.page_id, s.v, CASE WHEN hit IS NULL THEN s.k + 1 ELSE s.k END,
         CASE WHEN hit IS NULL THEN i.b ELSE {{'x': least(o.x, s.cur.x), 'y': least(o.y, s.cur.y), 'width': greatest(o.x + o.width, s.cur.x + s.cur.width) - least(o.x, s.cur.x),
           'height': greatest(o.y + o.height, s.cur.y + s.cur.height) - least(o.y, s.cur.y), 'score': greatest(o.score, s.cur.score)}} END,
         CASE WHEN hit IS NULL THEN list_append(s.open, s.cur) ELSE list_filter(s.open, lambda b, j: j <> hit) END
  FROM (SELECT *, open[hit] AS o FROM (
          SELECT *, list_min(list_filter(list_transform(open, lambda b, j: CASE WHEN
            least(CASE WHEN v THEN b.width ELSE b.height END, CASE WHEN v THEN cur.width ELSE cur.height END) > 0
            AND greatest(0, CASE WHEN v THEN least(b.x + b.width, cur.x + cur.width) - greatest(b.x, cur.x) ELSE least(b.y + b.height, cur.y + cur.height) - greatest(b.y, cur.y) END)
                / least(CASE WHEN v THEN b.width ELSE b.height END, CASE WHEN v THEN cur.width ELSE cur.height END) >= 0.65
            AND greatest(0, CASE WHEN v THEN greatest(b.y, cur.y) - least(b.y + b.height, cur.y + cur.height) ELSE greatest(b.x, cur.x) - least(b.x + b.width, cur.x + cur.width) END)
                <= greatest(CASE WHEN v THEN b.width ELSE b.height END, CASE WHEN v THEN cur.width ELSE cur.height END) * 1.2::DOUBLE
            THEN j END), lambda j: j IS NOT NULL)) AS hit FROM walk WHERE cur IS NOT NULL)) s
  LEFT JOIN items i ON i.page_id = s.page_id AND i.k = s.k + 1),
ends AS (SELECT page_id, open FROM walk WHERE cur IS NULL),
flat AS (SELECT page_id, unnest(range(len(open))) AS merged_idx, unnest(open) AS b FROM ends)
SELECT page_id, merged_idx, b.x AS x, b.y AS y, b.width AS width, b.height AS height, round(b.score, 6) AS score, NULL::DOUBLE AS paper_score FROM flat""",
}

_METRICS = ORACLES["page_metrics"]
ORACLES["benchmark_records"] = f"""WITH {V_DET}, {V_PRED},
found AS (SELECT page_id, count(*) AS n FROM v_det GROUP BY page_id), own AS (SELECT page_id, count(*) AS n FROM v_pred GROUP BY page_id), m AS ({_METRICS})
SELECT f.page_id, 2::BIGINT AS "schemaVersion", 'unknown' AS "modelRevision", 'test' AS browser, 'balanced' AS profile, CASE WHEN f.page_id % 2 = 0 THEN 880.0 ELSE 440.0 END::DOUBLE AS image_width,
       coalesce(own.n, 0)::BIGINT AS n_lines, m.predicted, m.reference, m.cer, m.order_accuracy, m.empty_rate
FROM found f LEFT JOIN own USING (page_id) LEFT JOIN m ON m.page_id = f.page_id AND f.page_id % 3 <> 0"""
ORACLES["csv_numbers"] = """SELECT l_orderkey AS "canvasId", l_linenumber AS "lineIndex",
       repeat(',', 10) || l_orderkey || ',' || l_linenumber || ',,,,' || regexp_replace(l_quantity::DOUBLE::VARCHAR, '[.]0$', '') || ',' || regexp_replace((l_linenumber / 8)::DOUBLE::VARCHAR, '[.]0$', '') || repeat(',', 17) AS line FROM lineitem"""
