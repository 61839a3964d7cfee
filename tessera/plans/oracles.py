"""DuckDB SQL for the engine's queries, written on its own: other forms of the same definitions."""

from __future__ import annotations

from ..operators import bridge, demand, emerging, fusion, growth, shared

LINES = """lines AS (
  SELECT p_brand AS channel, p_type AS topic, l_partkey AS video, l_orderkey AS orderkey, l_quantity AS qty, l_returnflag AS flag,
         l_shipdate::DATE AS day, date_trunc('week', l_shipdate)::DATE AS week, date_trunc('month', l_shipdate)::DATE AS month
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
COMMENTS = LINES + """, comments AS (SELECT lines.*, o_custkey AS commenter FROM lines JOIN orders ON orderkey = o_orderkey)"""
VIDEOS = f"""videos AS (
  SELECT channel, video, min(day) AS published, sum(qty) AS views, count(*) FILTER (flag = 'R') AS likes, count(*) AS n,
         sum(qty) / greatest(1, date_diff('day', min(day), DATE '{growth.AS_OF}')) AS x FROM lines GROUP BY ALL)"""
INDICATORS = f"""subs AS (SELECT channel, count(DISTINCT commenter) AS subs FROM comments GROUP BY 1),
indicators AS (SELECT channel, video, views / nullif(subs, 0) AS views_per_sub, x AS views_per_day,
  1000.0::DOUBLE * likes / nullif(views, 0) AS likes_per_1000, 1000.0::DOUBLE * n / nullif(views, 0) AS comments_per_1000 FROM videos JOIN subs USING (channel))"""
SHARES = """counts AS (SELECT channel, topic, sum(qty) AS n FROM lines GROUP BY 1, 2),
norms AS (SELECT channel, sum(n) AS total, sqrt(sum(n * n)) AS norm FROM counts GROUP BY 1),
sims AS (SELECT a.channel AS a, b.channel AS b, sum(a.n * b.n) / (max(na.norm) * max(nb.norm)) AS s
  FROM counts a JOIN counts b ON a.topic = b.topic AND a.channel <> b.channel JOIN norms na ON na.channel = a.channel JOIN norms nb ON nb.channel = b.channel GROUP BY 1, 2)"""
MEANS = "means AS (SELECT channel, avg(x) AS mean, count(*) AS n FROM videos GROUP BY 1)"
NEAR = f"near AS (SELECT a, b, s FROM sims QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(s, 8) DESC, b) <= {growth.NEIGHBOURS})"
POOLED = """pooled AS (SELECT a AS channel, sum(s * n * mean) / sum(s * n) AS pooled, sum(s) * sum(s) / sum(s * s) AS n_eff
  FROM (SELECT * FROM near UNION ALL SELECT channel, channel, 1.0 FROM means) JOIN means ON b = channel GROUP BY 1)"""
PEERS = "peers AS (SELECT a AS channel, sum(s * n * mean) / sum(s * n) AS pooled FROM near JOIN means ON b = channel GROUP BY 1)"
ENTROPY = "CASE WHEN {0} > 0 THEN -{0} * log2({0}) ELSE 0 END"
GAPS = f"""d AS (SELECT channel, topic, sum(qty) / sum(sum(qty)) OVER (PARTITION BY channel) AS p FROM lines GROUP BY 1, 2),
u AS (SELECT p_brand AS channel, p_type AS topic, count(*) / sum(count(*)) OVER (PARTITION BY p_brand) AS q FROM part GROUP BY 1, 2),
gaps AS (SELECT channel, topic, coalesce(p, 0) AS p, coalesce(q, 0) AS q, (coalesce(p, 0) + coalesce(q, 0)) / 2 AS m FROM d FULL JOIN u USING (channel, topic)),
parts AS (SELECT channel, topic, p - q AS gap, {ENTROPY.format("m")} - ({ENTROPY.format("p")} + {ENTROPY.format("q")}) / 2 AS part FROM gaps)"""
BETAS = growth.BETA
SHAP = "filled AS (SELECT channel, video, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in BETAS) + " FROM indicators), shap AS (SELECT channel, video, " + ", ".join(f"{b}::DOUBLE * ({c} - avg({c}) OVER ()) AS {c}" for c, b in BETAS.items()) + ", " + " + ".join(f"{b}::DOUBLE * avg({c}) OVER ()" for c, b in BETAS.items()) + " AS base FROM filled)"
OPPORTUNITY = f"""tops AS (SELECT channel, arg_max(k, (v, k)) AS top_feature FROM (
  {" UNION ALL ".join(f"SELECT channel, '{c}' AS k, round(avg(abs({c})), 8) AS v FROM shap GROUP BY 1" for c in BETAS)}) GROUP BY 1),
opportunity AS (SELECT channel, (pooled - mean) / mean AS score, n_eff / (n_eff + {growth.KAPPA}) AS confidence, top_feature FROM means JOIN pooled USING (channel) JOIN tops USING (channel))"""
ALPHA = bridge.ALPHA
PPR = f"""aud AS (SELECT channel, commenter, count(*)::DOUBLE AS w FROM comments GROUP BY 1, 2),
hop AS (SELECT o.channel AS src, b.channel AS dst, sum(o.w / os.t * b.w / bs.t) AS p FROM aud o JOIN aud b USING (commenter)
  JOIN (SELECT channel, sum(w) AS t FROM aud GROUP BY 1) os ON os.channel = o.channel JOIN (SELECT commenter, sum(w) AS t FROM aud GROUP BY 1) bs ON bs.commenter = o.commenter GROUP BY 1, 2),
walk AS (SELECT 0 AS i, channel, CASE WHEN channel = '{bridge.TARGET}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM (SELECT DISTINCT channel FROM aud)
  UNION ALL SELECT any_value(i) + 1, dst, {ALPHA} * sum(r * p) + CASE WHEN dst = '{bridge.TARGET}' THEN {1 - ALPHA} ELSE 0 END FROM walk JOIN hop ON src = channel WHERE i < {bridge.STEPS} GROUP BY dst),
ppr AS (SELECT channel, r FROM walk WHERE i = {bridge.STEPS})"""
BRIDGES = f"""common AS (SELECT channel, count(*) AS n FROM aud WHERE channel <> '{bridge.TARGET}' AND commenter IN (SELECT commenter FROM aud WHERE channel = '{bridge.TARGET}') GROUP BY 1),
bridges AS (SELECT channel, r / max(r) OVER () AS ppr, coalesce(s, 0) AS topic_similarity, coalesce(n / (n + {bridge.KAPPA}), 0) AS confidence FROM ppr
  LEFT JOIN (SELECT b AS channel, s FROM sims WHERE a = '{bridge.TARGET}') USING (channel) LEFT JOIN common USING (channel) WHERE channel <> '{bridge.TARGET}'),
scored AS (SELECT *, confidence * ({bridge.LAMBDA} * ppr + {1 - bridge.LAMBDA} * topic_similarity) AS score FROM bridges)"""


def dense(step: str) -> str:
    return f"""grid AS (SELECT topic, unnest(generate_series((SELECT min({step}) FROM lines)::TIMESTAMP, (SELECT max({step}) FROM lines)::TIMESTAMP, INTERVAL 1 {step}))::DATE AS t FROM (SELECT DISTINCT topic FROM lines)),
dense AS (SELECT topic, t, coalesce(n, 0) AS n, coalesce(total, 0)::BIGINT AS total FROM grid LEFT JOIN (SELECT topic, {step} AS t, count(*) AS n FROM lines GROUP BY ALL) USING (topic, t)
  LEFT JOIN (SELECT {step} AS t, count(*) AS total FROM lines GROUP BY ALL) USING (t))"""


RATES = """rates AS (SELECT channel, topic, ln((n + 0.5) / (total - n + 0.5)) AS y, 1 / (n + 0.5) + 1 / (total - n + 0.5) AS s2
  FROM (SELECT channel, topic, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY channel)::DOUBLE AS total FROM lines GROUP BY 1, 2)),
mus AS (SELECT topic, sum(y / s2) / sum(1 / s2) AS mu FROM rates GROUP BY 1),
moments AS (SELECT topic, max(mu) AS mu, greatest(0, coalesce((sum((y - mu) * (y - mu) / s2) - (count(*) - 1)) / nullif(sum(1 / s2) - sum(1 / (s2 * s2)) / sum(1 / s2), 0), 0)) AS tau2 FROM rates JOIN mus USING (topic) GROUP BY 1)"""
SERIES = """obs AS (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY t) AS i, ln((n + 0.5::DOUBLE) / (total - n + 0.5::DOUBLE)) AS y,
  1 / (n + 0.5::DOUBLE) + 1 / (total - n + 0.5::DOUBLE) AS r FROM dense)"""
KALMAN = f"""state AS (SELECT topic, 0::BIGINT AS i, mu::DOUBLE AS m, {emerging.V0}::DOUBLE AS p FROM moments
  UNION ALL SELECT s.topic, o.i, s.m + (s.p + {emerging.Q}) / (s.p + {emerging.Q} + o.r) * (o.y - s.m), (s.p + {emerging.Q}) * o.r / (s.p + {emerging.Q} + o.r) FROM state s JOIN obs o ON o.topic = s.topic AND o.i = s.i + 1),
last AS (SELECT topic, m, p, r FROM state JOIN obs USING (topic, i) QUALIFY row_number() OVER (PARTITION BY topic ORDER BY i DESC) = 1)"""
BOCPD = f"""run AS (SELECT topic, 0::BIGINT AS i, 0::BIGINT AS k, 1.0::DOUBLE AS w, mu::DOUBLE AS m, {emerging.V0}::DOUBLE AS v FROM moments
  UNION ALL (
  WITH joint AS (SELECT s.topic, o.i, s.k, s.m, s.v, o.y, o.r, s.w * exp(-(o.y - s.m) * (o.y - s.m) / (2 * (s.v + o.r))) / sqrt(2 * pi() * (s.v + o.r)) AS j FROM run s JOIN obs o ON o.topic = s.topic AND o.i = s.i + 1),
  grown AS (SELECT topic, i, k + 1 AS k, {1 - emerging.HAZARD} * j / sum(j) OVER (PARTITION BY topic) AS w, (m * r + y * v) / (v + r) AS m, v * r / (v + r) AS v FROM joint)
  SELECT topic, i, least(k, {emerging.LONGEST}) AS k, sum(w) AS w, CASE WHEN sum(w) > 0 THEN sum(w * m) / sum(w) ELSE min_by(m, grown.k) END AS m,
    CASE WHEN sum(w) > 0 THEN sum(w * v) / sum(w) ELSE min_by(v, grown.k) END AS v FROM grown GROUP BY topic, i, least(grown.k, {emerging.LONGEST})
  UNION ALL SELECT topic, any_value(i), 0, {emerging.HAZARD}, any_value(mu), {emerging.V0} FROM joint JOIN moments USING (topic) GROUP BY topic)),
final AS (SELECT * FROM run QUALIFY i = max(i) OVER (PARTITION BY topic)),
short AS (SELECT topic, sum(w) FILTER (k <= {emerging.SHORT}) / sum(w) AS changepoint_p, sum(CASE WHEN w > 0 THEN -w * ln(w) ELSE 0 END) AS entropy FROM final GROUP BY 1)"""
RISE = "rise AS (SELECT topic, avg(y) FILTER (b BETWEEN 0 AND 2) - avg(y) FILTER (b BETWEEN 3 AND 5) AS rise FROM (SELECT topic, y, max(i) OVER (PARTITION BY topic) - i AS b FROM obs) GROUP BY 1)"
VOTES = """votes AS (SELECT doc_id, CASE WHEN length(text) >= 1500 THEN 1 WHEN length(text) < 200 THEN 0 ELSE -1 END AS v1, CASE WHEN contains(text, ' | ') THEN 0 ELSE -1 END AS v2,
  CASE WHEN contains(text, '***') OR contains(text, '!!') THEN 0 ELSE -1 END AS v3, CASE WHEN contains(text, '.' || chr(10)) THEN 1 ELSE -1 END AS v4 FROM documents),
tally AS (SELECT doc_id, list_count(list_filter([v1, v2, v3, v4], lambda x: CASE WHEN x = 1 THEN true END)) AS yes, list_count(list_filter([v1, v2, v3, v4], lambda x: CASE WHEN x = 0 THEN true END)) AS no FROM votes),
weak AS (SELECT doc_id, CASE WHEN yes > no THEN 1 WHEN no > yes THEN 0 ELSE -1 END::INT AS label, (yes + no)::BIGINT AS n_votes FROM tally)"""
FUSION = f"""gapscore AS (SELECT channel, sum(part) AS score, count(*) / (count(*) + 2.0::DOUBLE) AS confidence FROM parts GROUP BY 1),
comp AS (SELECT channel, 'opportunity' AS component, {fusion.WEIGHTS["opportunity"]}::DOUBLE AS w, percent_rank() OVER (ORDER BY round(score, 8)) AS norm, confidence FROM opportunity
  UNION ALL SELECT channel, 'gap', {fusion.WEIGHTS["gap"]}::DOUBLE, percent_rank() OVER (ORDER BY round(score, 8)), confidence FROM gapscore
  UNION ALL SELECT channel, 'bridge', {fusion.WEIGHTS["bridge"]}::DOUBLE, percent_rank() OVER (ORDER BY round(score, 8)), confidence FROM scored),
contrib AS (SELECT channel, component, round(w * confidence * norm / nullif(sum(w * confidence) OVER (PARTITION BY channel), 0), 8) AS part FROM comp)"""
GROWTH = f"{COMMENTS}, {VIDEOS}, {INDICATORS}, {SHARES}, {MEANS}, {NEAR}, {POOLED}, {SHAP}, {OPPORTUNITY}"
ALL = f"WITH RECURSIVE {GROWTH}, {GAPS}, {PPR}, {BRIDGES}, {FUSION}"
DEMO = f"DATE '{growth.CUT}'"
LIST = ", ".join(f"'{c}'" for c in shared.CHANNELS)
TANGLISH = ", ".join(f"'{w}'" for w in demand.TANGLISH)


def orphans(name: str, child: str, key: str, parent: str, to: str) -> str:
    return f"SELECT '{name}' AS reference, count(*) FILTER (NOT EXISTS (SELECT 1 FROM {parent} WHERE {to} = {key})) AS n_orphans, count(*) FILTER ({key} IS NULL) AS n_null FROM {child}"


ORACLES = {
    "snapshot_latest": """SELECT l_partkey AS video, date_trunc('week', l_shipdate)::DATE AS snapshot_week, l_shipdate::DATE AS observed_on, l_orderkey AS orderkey, l_linenumber::BIGINT AS linenumber, l_suppkey AS suppkey, l_quantity AS quantity, l_extendedprice AS price
        FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, date_trunc('week', l_shipdate) ORDER BY l_shipdate::DATE DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1""",
    "commenter_hash": f"SELECT c_mktsegment AS segment, count(DISTINCT sha256('{shared.FIXTURE_SALT}' || c_custkey)) AS n_commenters, sum(('0x' || substr(sha256('{shared.FIXTURE_SALT}' || c_custkey), 1, 8))::BIGINT)::BIGINT AS check_sum FROM customer GROUP BY 1",
    "retention_30d": f"SELECT event_id, event_type, round(value, 8) AS value FROM events WHERE date_diff('microsecond', ts, TIMESTAMP '{shared.AS_OF}') < {shared.KEEP_DAYS} * 86400000000",
    "channel_semi": f"SELECT p_brand AS channel, p_partkey AS video, p_type AS topic FROM part WHERE p_brand IN ({LIST})",
    "orphan_check": " UNION ALL ".join(orphans(*x) for x in (("lineitem-orders", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem-part", "lineitem", "l_partkey", "part", "p_partkey"), ("orders-customer", "orders", "o_custkey", "customer", "c_custkey"), ("labels-documents", "labels", "labels.doc_id", "documents", "documents.doc_id"))),
    "indicators": f"WITH {COMMENTS}, {VIDEOS}, {INDICATORS} SELECT channel, video, round(views_per_sub, 8) AS views_per_sub, round(views_per_day, 8) AS views_per_day, round(likes_per_1000, 8) AS likes_per_1000, round(comments_per_1000, 8) AS comments_per_1000 FROM indicators",
    "channel_relative": f"WITH {LINES}, {VIDEOS}, b AS (SELECT a.channel, a.video, a.x, (SELECT avg(e.x) FROM videos e WHERE e.channel = a.channel AND (e.published, e.video) < (a.published, a.video)) AS baseline FROM videos a) SELECT channel, video, round(baseline, 8) AS baseline, round(x / baseline, 8) AS relative FROM b",
    "label_above_baseline": f"WITH {LINES}, {VIDEOS}, b AS (SELECT channel, video, x, avg(x) OVER (PARTITION BY channel ORDER BY published, video ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline FROM videos) SELECT channel, video, x > baseline AS above FROM b",
    "label_top_quartile": f"WITH {LINES}, {VIDEOS}, bars AS (SELECT channel, quantile_cont(x, 0.75) AS bar FROM videos WHERE published < {DEMO} GROUP BY 1) SELECT channel, video, x >= bar AS top, round(bar, 8) AS threshold FROM videos LEFT JOIN bars USING (channel)",
    "time_split": f"WITH {LINES}, {VIDEOS} SELECT cut, count(*) FILTER (published < cut) AS n_train, count(*) FILTER (published >= cut) AS n_test, max(published) FILTER (published < cut) AS last_train, min(published) FILTER (published >= cut) AS first_test FROM videos, (VALUES {', '.join(f'(DATE {c!r})' for c in growth.FOLDS)}) f(cut) GROUP BY 1",
    "channel_similarity": f"WITH {LINES}, {SHARES} SELECT a, b, round(s, 8) AS similarity FROM sims WHERE a < b",
    "pooled_mean": f"WITH {LINES}, {VIDEOS}, {SHARES}, {MEANS}, {NEAR}, {POOLED} SELECT channel, round(pooled, 8) AS pooled FROM pooled",
    "confidence_level": f"WITH {LINES}, {VIDEOS}, {SHARES}, {MEANS}, {NEAR}, {POOLED}, c AS (SELECT channel, n_eff / (n_eff + {growth.KAPPA}) AS c FROM pooled) SELECT channel, round(c, 8) AS confidence, CASE WHEN c >= 0.7 THEN 'high' WHEN c >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM c",
    "underperformers": f"WITH {LINES}, {VIDEOS}, {SHARES}, {MEANS}, {NEAR}, {PEERS} SELECT channel, round(mean, 8) AS own, round(pooled, 8) AS peers, round(mean - pooled, 8) AS gap FROM means JOIN peers USING (channel) WHERE round(mean, 8) < round(pooled, 8)",
    "linear_shap": f"WITH {COMMENTS}, {VIDEOS}, {INDICATORS}, {SHAP} SELECT video, {', '.join(f'round({c}, 8) AS phi_{c}' for c in BETAS)}, round(base, 8) AS base, round(base + {' + '.join(BETAS)}, 8) AS prediction FROM shap",
    "opportunity_view": f"WITH {GROWTH} SELECT channel, round(score, 8) AS score, round(confidence, 8) AS confidence, top_feature FROM opportunity",
    "clean_text": """WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://[^\\s]+', ' ', 'g'), '<[^<>]*>', ' ', 'g'), '@[a-z0-9_.]+', ' ', 'g'), '[ \\n\\r\\t]+', ' ', 'g')) AS t FROM documents)
        SELECT md5(t) AS text_md5, length(t)::BIGINT AS n_chars, min(doc_id) AS doc_id FROM c WHERE t <> '' GROUP BY t""",
    "language_route": f"""WITH c AS (SELECT length(regexp_replace(text, '[^\\p{{L}}\\p{{M}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\\x{{0D80}}-\\x{{0DFF}}]', '', 'g')) AS sinhala, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin,
        regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\x{{200D}}]+') AS ws FROM documents)
        SELECT CASE WHEN letters = 0 THEN 'other' WHEN sinhala * 2 >= letters THEN 'sinhala' WHEN len(list_filter(ws, lambda w: w IN ({TANGLISH}))) * 10 >= len(ws) THEN 'tanglish' WHEN latin * 10 >= letters * 9 THEN 'english' ELSE 'other' END AS route, count(*) AS n FROM c GROUP BY 1""",
    "weak_majority_vote": f"WITH {VOTES} SELECT doc_id, label, n_votes FROM weak",
    "cohen_kappa": f"""WITH {VOTES}, x AS (SELECT label AS a, quality AS b FROM weak JOIN labels USING (doc_id) WHERE label >= 0), o AS (SELECT count(*) AS n, avg((a = b)::INT) AS po, avg(a) AS pa, avg(b) AS pb FROM x)
        SELECT n, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 8) AS kappa FROM o""",
    "pseudo_labels": f"WITH {VOTES} SELECT doc_id, coalesce(quality, nullif(label, -1)) AS label, CASE WHEN quality IS NOT NULL THEN 'teacher' WHEN label >= 0 THEN 'weak' ELSE 'none' END AS origin FROM weak LEFT JOIN labels USING (doc_id)",
    "demand_dist": f"WITH {LINES}, {GAPS} SELECT channel, topic, round(p, 8) AS share FROM d",
    "supply_dist": f"WITH {LINES}, {GAPS} SELECT channel, topic, round(q, 8) AS share FROM u",
    "demand_supply_jsd": f"WITH {LINES}, {GAPS} SELECT channel, round(sum(part), 8) AS jsd FROM parts GROUP BY 1",
    "jsd_contrib": f"WITH {LINES}, {GAPS} SELECT channel, topic, round(part, 8) AS part, round(gap, 8) AS gap FROM parts",
    "jsd_monthly_delta": f"""WITH {LINES}, u AS (SELECT p_brand AS channel, p_type AS topic, count(*) / sum(count(*)) OVER (PARTITION BY p_brand) AS q FROM part GROUP BY 1, 2),
        d AS (SELECT channel, month, topic, sum(qty) / sum(sum(qty)) OVER (PARTITION BY channel, month) AS p FROM lines GROUP BY 1, 2, 3), g AS (SELECT DISTINCT channel, month FROM lines),
        x AS (SELECT channel, month, coalesce(p, 0) AS p, coalesce(q, 0) AS q, (coalesce(p, 0) + coalesce(q, 0)) / 2 AS m FROM d FULL JOIN (SELECT * FROM u JOIN g USING (channel)) USING (channel, month, topic)),
        j AS (SELECT channel, month, sum({ENTROPY.format("m")} - ({ENTROPY.format("p")} + {ENTROPY.format("q")}) / 2) AS jsd FROM x GROUP BY 1, 2)
        SELECT channel, month, round(jsd, 8) AS jsd, round(jsd - lag(jsd) OVER (PARTITION BY channel ORDER BY month), 8) AS change FROM j""",
    "w1_ordered": f"WITH {LINES}, {GAPS}, c AS (SELECT a.channel, a.topic, abs(sum(b.gap)) AS d FROM parts a JOIN parts b ON b.channel = a.channel AND b.topic <= a.topic GROUP BY 1, 2) SELECT channel, round(sum(d), 8) AS w1 FROM c GROUP BY 1",
    "unmet_topk": f"WITH {LINES}, {GAPS}, r AS (SELECT channel, topic, gap, row_number() OVER (PARTITION BY channel ORDER BY round(gap, 8) DESC, topic) AS rank FROM parts WHERE round(gap, 8) > 0) SELECT channel, topic, rank, round(gap, 8) AS gap FROM r WHERE rank <= 2",
    "demand_gap_view": f"WITH {LINES}, {GAPS}, t AS (SELECT channel, topic FROM parts WHERE round(gap, 8) > 0 QUALIFY row_number() OVER (PARTITION BY channel ORDER BY round(gap, 8) DESC, topic) = 1) SELECT channel, round(sum(part), 8) AS jsd, max(t.topic) AS top_topic FROM parts LEFT JOIN t USING (channel) GROUP BY 1",
    "ctfidf_topterms": """WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), tf AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL),
        x AS (SELECT lang, term, n / sum(n) OVER (PARTITION BY lang) * ln(1 + (SELECT sum(n) / count(DISTINCT lang) FROM tf) / sum(n) OVER (PARTITION BY term)) AS score FROM tf)
        SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY round(score, 8) DESC, term) AS rank, round(score, 8) AS score FROM x QUALIFY rank <= 10""",
    "graph_edges": f"""WITH {COMMENTS}, v AS (SELECT DISTINCT channel, video, topic FROM lines)
        SELECT 'commented' AS edge_type, count(DISTINCT (commenter, video)) AS n_edges, count(*)::DOUBLE AS weight, count(DISTINCT commenter) AS n_src, count(DISTINCT video) AS n_dst FROM comments
        UNION ALL SELECT 'uploaded', count(*), count(*)::DOUBLE, count(DISTINCT video), count(DISTINCT channel) FROM v
        UNION ALL SELECT 'covers', count(DISTINCT (channel, topic)), count(*)::DOUBLE, count(DISTINCT channel), count(DISTINCT topic) FROM v""",
    "ppr_topk": f"WITH RECURSIVE {COMMENTS}, {PPR} SELECT '{bridge.TARGET}' AS target, channel, row_number() OVER (ORDER BY round(r, 8) DESC, channel) AS rank, round(r, 8) AS r FROM ppr QUALIFY rank <= {bridge.TOP}",
    "shared_audience_conf": f"WITH {COMMENTS}, a AS (SELECT DISTINCT channel, commenter FROM comments) SELECT '{bridge.TARGET}' AS target, o.channel, count(*) AS n_shared, round(count(*) / (count(*) + {bridge.KAPPA}), 8) AS confidence FROM a t JOIN a o USING (commenter) WHERE t.channel = '{bridge.TARGET}' AND o.channel <> t.channel GROUP BY 2",
    "bridge_score": f"WITH RECURSIVE {COMMENTS}, {SHARES}, {PPR}, {BRIDGES} SELECT channel, round(ppr, 8) AS ppr, round(topic_similarity, 8) AS topic_similarity, round(confidence, 8) AS confidence, round(score, 8) AS score FROM scored",
    "bridge_rank": f"""WITH RECURSIVE {COMMENTS}, {SHARES}, {PPR}, {BRIDGES}, top AS (SELECT channel, score, row_number() OVER (ORDER BY round(score, 8) DESC, channel) AS rank FROM scored QUALIFY rank <= 5),
        sh AS (SELECT channel, topic, n / total AS p FROM counts JOIN norms USING (channel)), m AS (SELECT t.channel, t.rank, t.score, s.topic, row_number() OVER (PARTITION BY t.channel ORDER BY round(least(s.p, o.p), 8) DESC, s.topic) AS k
          FROM top t JOIN sh s ON s.channel = t.channel JOIN sh o ON o.topic = s.topic AND o.channel = '{bridge.TARGET}')
        SELECT channel, rank, round(score, 8) AS score, string_agg(topic, ',' ORDER BY k) AS shared_topics FROM m WHERE k <= 2 GROUP BY 1, 2, 3""",
    "modularity": f"""WITH {COMMENTS}, a AS (SELECT DISTINCT channel, commenter FROM comments), g AS (SELECT x.channel AS a, y.channel AS b, count(*) AS w FROM a x JOIN a y ON x.commenter = y.commenter AND x.channel <> y.channel GROUP BY 1, 2),
        deg AS (SELECT a, sum(w) AS k FROM g GROUP BY 1), m AS (SELECT sum(w)::DOUBLE AS m2 FROM g)
        SELECT round((SELECT sum(w) FROM g WHERE right(a, 1) = right(b, 1)) / m2 - (SELECT sum(x.k * y.k) FROM deg x, deg y WHERE right(x.a, 1) = right(y.a, 1)) / (m2 * m2), 8) AS modularity FROM m""",
    "prevalence_dense": f"WITH {LINES}, {dense('week')} SELECT topic, t AS week, n, total, round(n / nullif(total, 0), 8) AS share FROM dense",
    "hier_pool": f"WITH {LINES}, {RATES} SELECT channel, topic, round(s2 / (s2 + tau2), 8) AS weight, round(s2 / (s2 + tau2) * mu + (1 - s2 / (s2 + tau2)) * y, 8) AS pooled FROM rates JOIN moments USING (topic)",
    "kalman_level": f"WITH RECURSIVE {LINES}, {RATES}, {dense('month')}, {SERIES}, {KALMAN} SELECT topic, round(m, 8) AS level, round(p, 8) AS state_var FROM last",
    "forecast_var": f"WITH RECURSIVE {LINES}, {RATES}, {dense('month')}, {SERIES}, {KALMAN} SELECT topic, round(p + {emerging.Q} + r, 8) AS forecast_var FROM last",
    "bocpd_shortrun": f"WITH RECURSIVE {LINES}, {RATES}, {dense('month')}, {SERIES}, {BOCPD} SELECT topic, round(changepoint_p, 8) AS changepoint_p, round(entropy, 8) AS entropy FROM short",
    "emerging_flag": f"WITH RECURSIVE {LINES}, {RATES}, {dense('month')}, {SERIES}, {BOCPD}, {RISE} SELECT topic, round(changepoint_p, 8) AS changepoint_p, round(rise, 8) AS rise, round(changepoint_p, 8) >= {emerging.THETA} AND round(rise, 8) > 0 AS emerging FROM short JOIN rise USING (topic)",
    "alert_view": f"WITH RECURSIVE {LINES}, {RATES}, {dense('month')}, {SERIES}, {KALMAN}, {BOCPD}, {RISE} SELECT topic, round(changepoint_p, 8) AS changepoint_p, round(changepoint_p, 8) >= {emerging.THETA} AND round(rise, 8) > 0 AS emerging, round(p + {emerging.Q} + r, 8) AS forecast_var FROM short JOIN rise USING (topic) JOIN last USING (topic)",
    "fusion_score": f"{ALL} SELECT channel, round(sum(w * confidence * norm) / nullif(sum(w * confidence), 0), 8) AS score, round(sum(w * confidence) / sum(w) * (count(*) / {len(fusion.WEIGHTS)}), 8) AS confidence FROM comp GROUP BY 1",
    "fusion_contributions": f"{ALL} SELECT channel, component, part FROM contrib",
    "recommend_topk": f"""{ALL}, r AS (SELECT channel, component, row_number() OVER (PARTITION BY channel ORDER BY part DESC, component) AS rank FROM contrib)
        SELECT channel, rank, channel || ': ' || CASE component WHEN 'opportunity' THEN 'follow what similar channels do better' WHEN 'gap' THEN 'make content for unmet demand' ELSE 'address the audience of bridge channels' END AS recommendation FROM r WHERE rank <= 2""",
    "demand_gap_weekly": f"""WITH {LINES}, u AS (SELECT p_brand AS channel, p_type AS topic, count(*) / sum(count(*)) OVER (PARTITION BY p_brand) AS q FROM part GROUP BY 1, 2),
        d AS (SELECT channel, week, topic, sum(qty) / sum(sum(qty)) OVER (PARTITION BY channel, week) AS p FROM lines GROUP BY 1, 2, 3), g AS (SELECT channel, week, count(*) AS n FROM lines GROUP BY 1, 2),
        x AS (SELECT channel, week, topic, coalesce(p, 0) AS p, coalesce(q, 0) AS q, (coalesce(p, 0) + coalesce(q, 0)) / 2 AS m FROM d FULL JOIN (SELECT u.*, week FROM u JOIN g USING (channel)) USING (channel, week, topic)),
        j AS (SELECT channel, week, sum({ENTROPY.format("m")} - ({ENTROPY.format("p")} + {ENTROPY.format("q")}) / 2) AS jsd FROM x GROUP BY 1, 2),
        t AS (SELECT channel, week, topic FROM x WHERE round(p - q, 8) > 0 QUALIFY row_number() OVER (PARTITION BY channel, week ORDER BY round(p - q, 8) DESC, topic) = 1)
        SELECT channel, week, round(jsd, 8) AS score, round(n / (n + {demand.KAPPA}), 8) AS confidence, coalesce('unmet: ' || topic, 'met') AS explanation FROM j JOIN g USING (channel, week) LEFT JOIN t USING (channel, week)""",
    "bridge_weekly": f"""WITH RECURSIVE {COMMENTS}, aud AS (SELECT week, channel, commenter, count(*)::DOUBLE AS w FROM comments GROUP BY ALL),
        ct AS (SELECT week, channel, sum(w) AS t FROM aud GROUP BY ALL), ut AS (SELECT week, commenter, sum(w) AS t FROM aud GROUP BY ALL),
        hop AS (SELECT o.week, o.channel AS src, b.channel AS dst, sum(o.w / ct.t * b.w / ut.t) AS p FROM aud o JOIN aud b USING (week, commenter) JOIN ct ON ct.week = o.week AND ct.channel = o.channel JOIN ut ON ut.week = o.week AND ut.commenter = o.commenter GROUP BY ALL),
        walk AS (SELECT 0 AS i, week, channel AS target, channel, 1.0::DOUBLE AS r FROM ct
          UNION ALL SELECT any_value(i) + 1, walk.week, target, dst, {ALPHA} * sum(r * p) + CASE WHEN dst = target THEN {1 - ALPHA} ELSE 0 END FROM walk JOIN hop ON hop.week = walk.week AND src = channel WHERE i < {bridge.STEPS} GROUP BY walk.week, target, dst),
        top AS (SELECT week, target, channel, r / max(r) OVER (PARTITION BY week, target) AS ppr FROM walk WHERE i = {bridge.STEPS} AND channel <> target),
        common AS (SELECT a.week, a.channel AS target, b.channel, count(DISTINCT a.commenter) AS n FROM aud a JOIN aud b USING (week, commenter) WHERE a.channel <> b.channel GROUP BY ALL),
        q AS (SELECT week, channel, topic, sum(qty)::DOUBLE AS q FROM lines GROUP BY ALL), norm AS (SELECT week, channel, sqrt(sum(q * q)) AS norm FROM q GROUP BY ALL),
        near AS (SELECT a.week, a.channel AS target, b.channel, sum(a.q * b.q) / (any_value(na.norm) * any_value(nb.norm)) AS s, first(a.topic ORDER BY round(least(a.q, b.q), 8) DESC, a.topic) AS topic
          FROM q a JOIN q b ON a.week = b.week AND a.topic = b.topic AND a.channel <> b.channel JOIN norm na ON na.week = a.week AND na.channel = a.channel JOIN norm nb ON nb.week = b.week AND nb.channel = b.channel GROUP BY 1, 2, 3),
        x AS (SELECT target, channel, week, ppr, coalesce(s, 0) AS s, coalesce(n, 0) AS n, topic FROM top LEFT JOIN common USING (week, target, channel) LEFT JOIN near USING (week, target, channel))
        SELECT target, channel, week, round(n / (n + {bridge.KAPPA}) * ({bridge.LAMBDA} * ppr + {1 - bridge.LAMBDA} * s), 8) AS score, round(n / (n + {bridge.KAPPA}), 8) AS confidence, n || ' shared commenters; ' || coalesce(topic, 'no shared topic') AS explanation FROM x""",
}
ORACLES["jsd_weekly_delta"] = ORACLES["jsd_monthly_delta"].replace(LINES, "@").replace("month", "week").replace("@", LINES)

#: The same by channel and topic: `topic` is both, with a tab between them, and the totals are the channel's.
WEEKLY = f"""{RATES.replace("moments AS", "by_topic AS")}, keys AS (SELECT DISTINCT channel, topic AS own, channel || chr(9) || topic AS topic FROM lines),
moments AS (SELECT keys.topic, mu, tau2 FROM keys JOIN by_topic ON own = by_topic.topic),
counted AS (SELECT channel, topic AS own, week, count(*) AS n FROM lines GROUP BY ALL), totals AS (SELECT channel, week, sum(n)::BIGINT AS total FROM counted GROUP BY ALL),
grid AS (SELECT *, unnest(generate_series((SELECT min(week) FROM lines)::TIMESTAMP, (SELECT max(week) FROM lines)::TIMESTAMP, INTERVAL 1 week))::DATE AS t FROM keys),
dense AS (SELECT grid.topic, t, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM grid LEFT JOIN counted ON counted.channel = grid.channel AND counted.own = grid.own AND counted.week = t
  LEFT JOIN totals ON totals.channel = grid.channel AND totals.week = t)"""
BOTH = "split_part(topic, chr(9), 1) AS channel, split_part(topic, chr(9), 2) AS topic"
ORACLES |= {
    "prevalence_weekly": f"WITH {LINES}, {WEEKLY} SELECT {BOTH}, t AS week, n, total, round(n / nullif(total, 0), 8) AS share FROM dense",
    **{
        f"{name}_weekly": ORACLES[name].replace(f"{RATES}, {dense('month')}", WEEKLY).replace("SELECT topic, round", f"SELECT {BOTH}, round")
        for name in ("kalman_level", "forecast_var", "bocpd_shortrun", "emerging_flag", "alert_view")
    },
}
