"""The core's queries as SQL."""

from __future__ import annotations

from kinweave.plans.adapters import REC_PARTS_SQL, TRANSITIONS_SQL

_CENSUS, _PREDICTED = "updated_icelandic_census_data", "rule_based_predictions"


def _uniqueness() -> str:
    cols = ("nafn", "fornafn", "eftirnafn")
    counts = ", ".join(f"c{k} AS (SELECT {c} AS v, count(*) AS n FROM rec GROUP BY 1), s{k} AS (SELECT v, 100.0::DOUBLE - (n - (SELECT min(n) FROM c{k}))::DOUBLE / NULLIF((SELECT max(n) - min(n) FROM c{k}), 0)::DOUBLE * 100.0::DOUBLE AS s FROM c{k})" for k, c in enumerate(cols))
    joins = " ".join(f"JOIN s{k} ON s{k}.v IS NOT DISTINCT FROM r.{c}" for k, c in enumerate(cols))
    return f"{counts}, u0 AS (SELECT r.*, round_even((s0.s + s1.s + s2.s) / 3.0::DOUBLE, 1) AS raw FROM rec r {joins}), uu AS (SELECT *, (raw - (SELECT min(raw) FROM u0)) / NULLIF((SELECT max(raw) - min(raw) FROM u0), 0) AS u FROM u0)"


_NAME = " + ".join(f"levenshtein(a.{c}, b.{c})" for c in ("nafn", "fornafn", "millinafn", "eftirnafn", "aettarnafn"))
_PLACE = "CASE WHEN a.bi_baer IS NOT DISTINCT FROM b.bi_baer THEN 0 WHEN a.bi_sokn IS NOT DISTINCT FROM b.bi_sokn THEN 5 WHEN a.bi_hreppur IS NOT DISTINCT FROM b.bi_hreppur THEN 10 WHEN a.bi_sysla IS NOT DISTINCT FROM b.bi_sysla THEN 15 ELSE 20 END"
_EARLY, _LATE = "CASE WHEN a.manntal < b.manntal THEN a.hjuskapur ELSE b.hjuskapur END", "CASE WHEN a.manntal < b.manntal THEN b.hjuskapur ELSE a.hjuskapur END"
_MARITAL = f"CASE WHEN coalesce(a.hjuskapur = b.hjuskapur, false) OR a.manntal = b.manntal THEN 0 WHEN {_LATE} = 'O' THEN 10 WHEN {_EARLY} IN ('S', 'L', 'E') AND {_LATE} IN ('S', 'L', 'E', 'G') THEN 5 ELSE 0 END"
_CAPS = "levenshtein(a.fornafn, b.fornafn) <= 2 AND levenshtein(a.millinafn, b.millinafn) <= 8 AND levenshtein(a.eftirnafn, b.eftirnafn) <= 4"
_NEAR = "a.kyn = b.kyn AND abs(a.faedingarar - b.faedingarar) <= 2"


def _edges(weights: str = "1, 1, 1, 1, 1") -> str:
    wn, wa, wl, wm, ws = weights.split(", ")
    return f"""WITH {REC_PARTS_SQL}, {TRANSITIONS_SQL}, {_uniqueness()},
t0 AS (SELECT a.id AS seed_id, a.u AS seed_u, b.id AS match_id, b.manntal, {_NAME} AS name, abs(a.faedingarar - b.faedingarar) AS age, {_PLACE} AS location, {_MARITAL} AS marital, coalesce(t.score, 0.0) AS stada
 FROM uu a JOIN uu b ON {_NEAR} LEFT JOIN tr t ON t.from_group = a.stada_group AND t.to_group = b.stada_group WHERE {_CAPS}),
e AS (SELECT *, CAST(name * {wn} + age * {wa} + location * {wl} + marital * {wm} + stada * {ws} AS DOUBLE) AS score FROM t0),
best AS (SELECT *, min(score) OVER (PARTITION BY seed_id, manntal) AS best FROM e),
ok AS (SELECT * FROM best WHERE score < 10 AND best < seed_u * 10 AND score < seed_u * 10 + 20),
one AS (SELECT match_id, min(seed_id) AS id_individual, arg_min(score, seed_id) AS score FROM ok GROUP BY match_id)
"""


_JUDGED = f"""WITH c AS (SELECT id, min(nafn) AS nafn, min(bi_einstaklingur) AS person, min(faedingarar) AS born, min(bi_baer) AS place FROM {_CENSUS} GROUP BY id),
k AS (SELECT * FROM c WHERE person <> 0 AND place IS NOT NULL),
n AS (SELECT {{'id': id, 'nafn': nafn, 'person': person, 'born': born}} AS a, unnest([lead({{'id': id, 'nafn': nafn, 'person': person, 'born': born}}, 1) OVER w, lead({{'id': id, 'nafn': nafn, 'person': person, 'born': born}}, 2) OVER w]) AS b FROM k WINDOW w AS (PARTITION BY place ORDER BY nafn NULLS FIRST, id)),
j AS (SELECT a.id AS id_1, b.id AS id_2, CAST(a.person = b.person AS INTEGER) AS label, coalesce(CAST(a.nafn = b.nafn AS INTEGER), 0) AS predicted, coalesce(round(1.0::DOUBLE / (1.0 + abs(a.born - b.born)), 6), 0.0::DOUBLE) AS score FROM n WHERE b IS NOT NULL)
"""
_ROC = _JUDGED + """, g AS (SELECT score AS threshold, sum(label) AS p, sum(1 - label) AS n FROM j GROUP BY 1),
r AS (SELECT threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, (SELECT sum(p) FROM g) AS ap, (SELECT sum(n) FROM g) AS an FROM g WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))
"""
_PERSONS = f"WITH p AS (SELECT DISTINCT id, bi_einstaklingur AS person FROM {_CENSUS} WHERE bi_einstaklingur <> 0)"
_HEX = "substr(md5(CAST({} AS VARCHAR) || ':42'), 1, 8)"
_TWO = _PERSONS + """, r AS (SELECT id, person, row_number() OVER (PARTITION BY person ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) AS k FROM p),
pos AS (SELECT a.id AS id_1, b.id AS id_2, a.person AS cluster_1, a.person AS cluster_2, 1 AS label FROM r a JOIN r b ON a.person = b.person AND a.k = 1 AND b.k = 2),
h AS (SELECT cluster_1 AS c, id_1 AS id, md5(CAST(cluster_1 AS VARCHAR) || ':42') AS h FROM pos),
nx AS (SELECT c, id, coalesce(lead(c) OVER w, first(c) OVER (ORDER BY h, c)) AS c2, coalesce(lead(id) OVER w, first(id) OVER (ORDER BY h, c)) AS id2 FROM h WINDOW w AS (ORDER BY h, c)),
neg AS (SELECT id AS id_1, id2 AS id_2, c AS cluster_1, c2 AS cluster_2, 0 AS label FROM nx WHERE c <> c2)
"""


def _both(c: str, same: str, other: str) -> str:
    return f"CASE WHEN a.{c} = b.{c} THEN '{same}' WHEN a.{c} <> b.{c} THEN '{other}' END"


_SAID = ", ".join([
    "'differ_in_' || CAST(abs(CAST(a.manntal AS DOUBLE) - CAST(b.manntal AS DOUBLE)) AS VARCHAR) || '_years'", _both("nafn", "same_name", "different_name"), _both("fornafn", "same_first_name", "different_first_name"),
    _both("eftirnafn", "same_last_name", "different_last_name"), _both("faedingarar", "same_birth_year", "different_birth_year"), _both("kyn", "same_gender", "different_gender"), "'stada_is_' || a.stada", "'stada_is_' || b.stada",
    _both("hjuskapur", "same_marital_status", "different_marital_status"), _both("bi_baer", "same_residence_ID", "different_residence_ID"), "'cleaned_status_is_' || a.cleaned_status", "'cleaned_status_is_' || b.cleaned_status",
])
_STATED = f"""WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY skrad_at NULLS FIRST, hjuskapur NULLS FIRST) AS rn FROM {_CENSUS} WHERE bi_baer IS NOT NULL) WHERE rn = 1),
x AS (SELECT id, lead(id) OVER (PARTITION BY bi_baer ORDER BY id) AS id2 FROM f),
s AS (SELECT a.id AS id_1, b.id AS id_2, list_sort(list_distinct([{_SAID}])) AS said, coalesce(a.bi_einstaklingur = b.bi_einstaklingur, false) AS same FROM x JOIN f a ON a.id = x.id JOIN f b ON b.id = x.id2)
"""
_TRUTH = """WITH t AS (SELECT p_partkey, (p_partkey % 5) / 4.0::DOUBLE AS f1, least(greatest((p_size % 10) / 10.0::DOUBLE, 0.01), 0.99) AS c1, (p_partkey % 3) / 2.0::DOUBLE AS f2, least(greatest((p_size % 7) / 7.0::DOUBLE, 0.01), 0.99) AS c2 FROM part),
w AS (SELECT *, c1 / (1 - c1) AS w1, c2 / (1 - c2) AS w2 FROM t),
r AS (SELECT p_partkey, (f1 * w1 + f2 * w2) / (w1 + w2) AS f, least(greatest((w1 + w2) / (w1 + w2 + 1), 0.01), 0.99) AS c FROM w)
SELECT p_partkey, round(f, 6) AS f, round(c, 6) AS c, round(c * (f - 0.5) + 0.5, 6) AS e FROM r"""


_FIELD = '"(?:[^"]|"")*"|[^",]*'
_WHOLE = " OR ".join(f"(v[{k}] IS NOT NULL AND NOT regexp_full_match(v[{k}], '[0-9]+(\\.0)?'))" for k in (1, 2, 12, 13, 14, 15, 16))
_REJECTS = f"""WITH l AS (SELECT line_no, CASE WHEN ends_with(c0, chr(13)) THEN left(c0, -1) ELSE coalesce(c0, '') END AS x FROM cleaned_einstaklingar),
s AS (SELECT *, regexp_full_match(x, '(?s)(?:{_FIELD})(?:,(?:{_FIELD}))*') AS sound FROM l),
f AS (SELECT *, regexp_extract_all(CASE WHEN sound THEN x || ',' ELSE '' END, '(?s)(?:{_FIELD}),') AS parts FROM s),
t AS (SELECT line_no, sound, len(parts) AS n, list_transform(parts, lambda p: trim(CASE WHEN p[1] = '"' THEN replace(p[2:length(p) - 2], '""', '"') ELSE p[1:length(p) - 1] END, ' ')) AS raw FROM f),
c AS (SELECT line_no, sound, n, list_transform(raw, lambda p: CASE WHEN p IN ('', 'NaN') THEN NULL ELSE p END) AS v FROM t),
r AS (SELECT line_no, CASE WHEN NOT sound THEN 'bad_quoting' WHEN n < 18 THEN 'too_few_columns' WHEN n > 18 THEN 'too_many_columns' WHEN v[1] IS NULL OR v[2] IS NULL OR {_WHOLE}
 OR coalesce(TRY_CAST(v[2] AS DOUBLE) NOT IN (1835, 1840, 1845, 1850, 1855, 1860, 1870, 1880, 1890, 1901, 1910), true)
 OR (v[8] IS NOT NULL AND (NOT regexp_full_match(v[8], '[0-9]+(\\.[0-9]+)?') OR coalesce(TRY_CAST(v[8] AS DOUBLE) NOT BETWEEN 1600 AND 1920, true)))
 OR (v[9] IS NOT NULL AND v[9] NOT IN ('Karl', 'Kona')) OR (v[11] IS NOT NULL AND v[11] NOT IN ('Ó', 'G', 'E', 'S', 'L')) THEN 'bad_value' END AS reason FROM c)
SELECT line_no, reason FROM r WHERE reason IS NOT NULL"""


def sql() -> dict[str, str]:
    judged, persons = _JUDGED, _PERSONS
    return {
        "p6_found": _REJECTS,
        "link_min_seed": _edges() + "SELECT match_id, id_individual, round(score, 6) AS score FROM one",
        "link_one_seed": _edges() + "SELECT match_id, manntal, round(score, 6) AS score, name = 0 AS same_name FROM e WHERE seed_id = 7",
        "uniqueness_score": f"WITH {REC_PARTS_SQL}, {_uniqueness()} SELECT id, round(u, 6) AS uniqueness_score FROM uu",
        "value_extremes": f"WITH e AS (SELECT unnest([{{'f': 'nafn', 'v': nafn}}, {{'f': 'fornafn', 'v': fornafn}}, {{'f': 'eftirnafn', 'v': eftirnafn}}, {{'f': 'kyn', 'v': kyn}}, {{'f': 'stada', 'v': stada}}]) AS s FROM {_CENSUS}), n AS (SELECT s.f AS field, s.v AS v, count(*) AS n FROM e WHERE s.v IS NOT NULL GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY field) AS hi, min(n) OVER (PARTITION BY field) AS lo FROM n) SELECT field, hi AS max_n, lo AS min_n, count(*) FILTER (WHERE n = hi) AS max_ties, count(*) FILTER (WHERE n = lo) AS min_ties, min(v) FILTER (WHERE n = hi) AS max_value, min(v) FILTER (WHERE n = lo) AS min_value FROM m GROUP BY field, hi, lo",
        "name_value_counts": f"SELECT fornafn AS value, count(*) AS n FROM {_CENSUS} WHERE fornafn IS NOT NULL GROUP BY 1",
        "column_ends": f"SELECT max(score) AS max_score, min(score) AS min_score, quantile_cont(score, 0.5) AS median_score, count(DISTINCT id_individual) AS n_individuals, count(*) AS n_rows FROM {_PREDICTED}",
        "nearest_neighbours": """
WITH d AS (SELECT q.vec_id AS id, p.vec_id AS other, p.label, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS d FROM embeddings q JOIN embeddings p ON q.vec_id <> p.vec_id WHERE q.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS n FROM d),
c AS (SELECT id, label, count(*) AS n FROM t WHERE n <= 5 GROUP BY id, label)
SELECT id, CAST(arg_max(label, n * 1000000 - label) AS INTEGER) AS predicted FROM c GROUP BY id""",
        "block_pairs": f"WITH {REC_PARTS_SQL} SELECT a.id, count(*) AS n_candidates FROM rec a JOIN rec b ON {_NEAR} GROUP BY a.id",
        "edit_caps": f"WITH {REC_PARTS_SQL} SELECT a.id, count(*) AS n_candidates FROM rec a JOIN rec b ON {_NEAR} WHERE {_CAPS} GROUP BY a.id",
        "distance_terms": _edges() + "SELECT seed_id, CAST(sum(name) AS DOUBLE) AS name, CAST(sum(age) AS DOUBLE) AS age, CAST(sum(location) AS DOUBLE) AS location, CAST(sum(marital) AS DOUBLE) AS marital, round(CAST(sum(stada) AS DOUBLE), 6) AS stada FROM e GROUP BY seed_id",
        "weighted_score": _edges("2, 1, 1, 1, 0.5") + "SELECT seed_id, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score FROM e GROUP BY seed_id",
        "accept_flags": _edges() + "SELECT seed_id, manntal, count(*) AS n_accepted, round(min(score), 6) AS best FROM ok GROUP BY seed_id, manntal",
        "unassigned_rows": _edges() + "SELECT id, nafn FROM rec WHERE id NOT IN (SELECT match_id FROM one)",
        "cluster_sizes_offset": f"SELECT id_individual, count(*) AS n FROM {_PREDICTED} WHERE id_individual IS NOT NULL GROUP BY 1 ORDER BY n DESC, id_individual LIMIT 1 OFFSET 1000",
        "cluster_history": f"SELECT id_individual, array_to_string(list_sort(list(DISTINCT manntal)), ',') AS years, count(*) AS n FROM {_PREDICTED} WHERE id_individual IS NOT NULL GROUP BY 1",
        "enrich_location_left": f"WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bi_baer, manntal ORDER BY id) AS k FROM manntol_baeir) WHERE k = 1) SELECT c.id, l.bi_hreppur, l.bi_sokn, l.bi_sysla FROM {_CENSUS} c LEFT JOIN l ON l.bi_baer IS NOT DISTINCT FROM c.bi_baer AND l.manntal IS NOT DISTINCT FROM c.manntal",
        "downcast_fill": f"SELECT id, coalesce(nafn, '') AS nafn, coalesce(millinafn, '') AS millinafn, coalesce(faedingarar, 0) AS faedingarar, CAST(coalesce(bi_hreppur, 0) AS INTEGER) AS bi_hreppur, CAST(coalesce(bi_sokn, 0) AS INTEGER) AS bi_sokn FROM {_PREDICTED}",
        "self_reference": f"SELECT DISTINCT id, manntal, nafn FROM {_CENSUS} WHERE id = bi_einstaklingur",
        "singleton_split": persons + " SELECT person, id, count(*) OVER (PARTITION BY person) = 1 AS single FROM p",
        "cluster_split_80_20": persons + f" SELECT id, person, CASE WHEN {_HEX.format('person')} <= 'cccccccc' THEN 'train' ELSE 'test' END AS split FROM p",
        "split_60_20_20": persons + f" SELECT id, person, CASE WHEN {_HEX.format('person')} <= '99999999' THEN 'train' WHEN {_HEX.format('person')} <= 'cccccccc' THEN 'test' ELSE 'compare' END AS split FROM p",
        "sample_fraction": persons + f" SELECT id, person FROM p WHERE {_HEX.format('id')} < '80000000'",
        "sample_n": persons + " SELECT DISTINCT id FROM (SELECT DISTINCT id FROM p ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id LIMIT 100)",
        "oversample_min20": persons + " SELECT person, greatest(count(*), 20) AS n, count(*) AS n_ids FROM p GROUP BY person",
        "positive_pairs": _TWO + "SELECT * FROM pos",
        "negative_pairs": _TWO + "SELECT * FROM neg",
        "pair_sanity": _TWO + ", a AS (SELECT * FROM pos UNION ALL SELECT * FROM neg), s AS (SELECT label, cluster_1 AS c FROM a UNION ALL SELECT label, cluster_2 FROM a) SELECT label, (SELECT count(*) FROM a WHERE a.label = s.label) AS n_pairs, count(DISTINCT c) AS n_clusters FROM s GROUP BY label",
        "all_pairs_small": "SELECT a.n_nationkey AS id_1, b.n_nationkey AS id_2 FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey",
        "neighbour_pairs": f"WITH r AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT DISTINCT id FROM {_CENSUS})) SELECT a.id AS id_1, b.id AS id_2, CAST(b.k - a.k AS INTEGER) AS step FROM r a JOIN (SELECT 0 AS d UNION ALL SELECT 1 UNION ALL SELECT 2) s ON true JOIN r b ON b.k = a.k + s.d",
        "pair_counts": persons + ", n AS (SELECT person, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY 1), t AS (SELECT sum(n * (n - 1) / 2) AS pos, sum(n) AS r FROM n) SELECT pos AS positive, r * (r - 1) / 2 AS all_pairs, r * (r - 1) / 2 - pos AS negative FROM t",
        "cluster_histogram": persons + ", n AS (SELECT person, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY 1), e AS (SELECT n, min(n) OVER () AS lo, max(n) OVER () AS hi FROM n) SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((n - lo) / (hi - lo) * 30), 29) END AS INTEGER) AS bin, count(*) AS n FROM e GROUP BY 1",
        "accuracy": judged + "SELECT round(avg(CAST(label = predicted AS DOUBLE)), 6) AS accuracy FROM j",
        "confusion": judged + "SELECT label, count(*) FILTER (WHERE predicted = 0) AS n_0, count(*) FILTER (WHERE predicted = 1) AS n_1 FROM j GROUP BY label",
        "adjusted_rand": judged + ", t AS (SELECT label, predicted, CAST(count(*) AS DOUBLE) AS n FROM j GROUP BY 1, 2), v AS (SELECT sum(n * n) AS s, sum(n) AS t, (SELECT sum(m * m) FROM (SELECT sum(n) AS m FROM t GROUP BY label)) AS a, (SELECT sum(m * m) FROM (SELECT sum(n) AS m FROM t GROUP BY predicted)) AS b FROM t), q AS (SELECT s - t AS tp, b - s AS fp, a - s AS fn, t * t - a - b + s AS tn FROM v) SELECT round(CASE WHEN fp = 0 AND fn = 0 THEN 1.0 ELSE 2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END, 6) AS adjusted_rand FROM q",
        "roc_points": _ROC + "SELECT threshold, tp, fp, round(tp / ap::DOUBLE, 6) AS tpr, round(fp / an::DOUBLE, 6) AS fpr FROM r",
        "auc": judged + ", g AS (SELECT score AS s, CAST(sum(label) AS DOUBLE) AS p, CAST(sum(1 - label) AS DOUBLE) AS n FROM j GROUP BY 1), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM b",
        "youden": _ROC + ", y AS (SELECT threshold, round(tp / ap::DOUBLE - fp / an::DOUBLE, 12) AS j FROM r) SELECT threshold, round(j, 6) AS youden FROM y ORDER BY j DESC, threshold DESC LIMIT 1",
        "per_row_correct": judged + "SELECT id, count(*) AS n_pairs, CAST(sum(ok) AS BIGINT) AS n_correct FROM (SELECT unnest([id_1, id_2]) AS id, CAST(label = predicted AS INTEGER) AS ok FROM j) GROUP BY id",
        "chunk_metrics": judged + "SELECT CAST(floor(id_1 / 1000.0) AS BIGINT) AS chunk, round(avg(CAST(label = predicted AS DOUBLE)), 6) AS accuracy, count(*) AS n FROM j GROUP BY 1",
        "match_adjacency": judged + "SELECT id, array_to_string(list_sort(list(DISTINCT m)), ',') AS matches FROM (SELECT id_1 AS id, id_2 AS m FROM j WHERE predicted = 1 UNION ALL SELECT id_2, id_1 FROM j WHERE predicted = 1) GROUP BY id",
        "majority_vote": "SELECT o_orderkey AS id, CAST(round_even((CAST((o_custkey + o_orderkey * 1) % 7 < 3 AS INTEGER) + CAST((o_custkey + o_orderkey * 2) % 7 < 3 AS INTEGER) + CAST((o_custkey + o_orderkey * 3) % 7 < 3 AS INTEGER) + CAST((o_custkey + o_orderkey * 4) % 7 < 3 AS INTEGER) + CAST((o_custkey + o_orderkey * 5) % 7 < 3 AS INTEGER) + CAST((o_custkey + o_orderkey * 6) % 7 < 3 AS INTEGER)) / 6.0::DOUBLE, 0) AS INTEGER) AS vote FROM orders",
        "statements": _STATED + "SELECT id_1, id_2, array_to_string(said, '|') AS statements, CAST(same AS INTEGER) AS label FROM s",
        "truth_revision": _TRUTH,
        "pattern_match": _STATED + "SELECT d.id_1, round(len(list_intersect(d.said, p.said))::DOUBLE / greatest(len(d.said), len(p.said), 1), 6) AS likeness FROM s d JOIN s p ON p.id_2 = d.id_1",
        "one_hot": "SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{m}' AS INTEGER) AS c_mktsegment_{m}" for m in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer",
        "label_encode": "SELECT p_partkey, dense_rank() OVER (ORDER BY p_name) - 1 AS code FROM part",
        "standardize": "SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS o_totalprice FROM orders",
        "clean_tokens": f"SELECT word, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(nafn, '[^a-zA-ZáéíóúýðæöþÁÉÍÓÚÝÐÆÖÞ ]', '', 'g'), ' ')) AS word FROM {_CENSUS}) WHERE word <> '' GROUP BY word",
        "euclid_pairs": "WITH n AS (SELECT vec_id, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(a, b), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) ** 2))), 4) AS distance FROM n WHERE b IS NOT NULL",
        "contrastive_loss": "WITH n AS (SELECT vec_id, label, embedding AS a, lead(embedding) OVER w AS b, lead(label) OVER w AS l2 FROM embeddings WINDOW w AS (PARTITION BY vec_id // 10 ORDER BY vec_id)), d AS (SELECT vec_id, label = l2 AS same, sqrt(list_sum(list_transform(list_zip(a, b), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) ** 2))) AS d FROM n WHERE b IS NOT NULL) SELECT vec_id, round(CASE WHEN same THEN d * d ELSE greatest(0, 1 - d) ** 2 END, 4) AS loss FROM d",
        "argmax_vectors": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS at FROM embeddings",
    }
