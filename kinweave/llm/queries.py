"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.llm.canonical import map_to_canon
from kinweave.llm.crosslink import link_tables
from kinweave.llm.groups import match_groups
from kinweave.llm.mixing import mix_sources
from kinweave.llm.packing import pack_texts
from kinweave.llm.spans import shared_spans
from kinweave.llm.splits import grouped_splits
from kinweave.llm.terms import term_frequencies
from kinweave.llm.variants import name_variants
from kinweave.runtime import table

CENSUS = "updated_icelandic_census_data"
NAME_FIELDS = ["fornafn", "eftirnafn", "nafn"]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return match_groups(table(spark, root, "classified_results_with_ensemble"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return term_frequencies(table(spark, root, CENSUS), NAME_FIELDS)


def p3_pairs(spark: SparkSession, root: str, report: float = 0.0) -> DataFrame:
    names = (CENSUS, "rule_based_predictions", "gaelunofn", "manntol_baeir")
    return link_tables(*[table(spark, root, n) for n in names], report=report)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return p3_pairs(spark, root, 0.5).select("id_census", "id_second")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return name_variants(table(spark, root, CENSUS), table(spark, root, "gaelunofn"), table(spark, root, "manntol_baeir"))


def p5_splits(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, CENSUS).select("id", "manntal", F.nullif("bi_einstaklingur", F.lit(0)).alias("bi_einstaklingur"), "skrad_at")
    return grouped_splits(rows, ["id", "bi_einstaklingur"])


def p5_shares(spark: SparkSession, root: str) -> DataFrame:
    """Rows and share of each split, and how many ids and persons in it stand in another one too."""
    out = p5_splits(spark, root)
    ends = out.select(F.explode(F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).cast("long").alias("value")) for c in ("id", "bi_einstaklingur")])).alias("m"), "split").where("m.value is not null")
    torn = ends.groupBy("m.by", "m.value").agg(F.min("split").alias("x"), F.max("split").alias("y")).where("x <> y")
    torn = torn.select(F.explode(F.array("x", "y")).alias("split")).groupBy("split").agg(F.count("*").alias("torn"))
    sizes = out.groupBy("split").agg(F.count("*").alias("n_rows"))
    total = sizes.agg(F.sum("n_rows").alias("_all"))
    return sizes.join(F.broadcast(torn), "split", "left").crossJoin(F.broadcast(total)).select("split", "n_rows", F.round(F.col("n_rows") / F.col("_all"), 6).alias("share"), F.coalesce("torn", F.lit(0)).alias("torn"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return map_to_canon(table(spark, root, CENSUS), table(spark, root, "stada_listi"))


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    return pack_texts(table(spark, root, "documents"))


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    """How full the containers are."""
    each = p8_containers(spark, root).groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return each.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), F.round(F.avg("n") / 1024, 6).alias("mean_fill"))


def p9_mixture(spark: SparkSession, root: str) -> DataFrame:
    return mix_sources(table(spark, root, "documents"), table(spark, root, "mix_targets"))[0]


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return mix_sources(table(spark, root, "documents"), table(spark, root, "mix_targets"))[1]


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return shared_spans(table(spark, root, "documents"))


def p10_shares(spark: SparkSession, root: str) -> DataFrame:
    """How much of each text is shared elsewhere: characters and share of each document's texts."""
    shared = p10_found(spark, root).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"))
    sizes = table(spark, root, "documents").where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.max(F.char_length("text")).alias("n_chars"))
    both = sizes.join(shared, "doc_id", "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)).cast("long"))
    return both.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "n_shared", F.round(F.when(F.col("n_chars") > 0, F.col("n_shared") / F.col("n_chars")).otherwise(0.0), 6).alias("share"))


def queries() -> dict:
    return {"p10_found": p10_found, "p10_shares": p10_shares, "p5_shares": p5_shares, "p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_pairs": p3_pairs, "p4_found": p4_found, "p5_splits": p5_splits, "p7_found": p7_found, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_mixture": p9_mixture, "p9_shares": p9_shares}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""
WITH v AS (SELECT id, unnest([{{'f': 'fornafn', 'x': fornafn}}, {{'f': 'eftirnafn', 'x': eftirnafn}}, {{'f': 'nafn', 'x': nafn}}]) AS s FROM {CENSUS}),
t AS (SELECT id, s.f AS field, unnest(regexp_split_to_array(lower(nfc_normalize(s.x)), '[\\s,\\x{{a0}}]+')) AS term FROM v WHERE s.x IS NOT NULL AND s.x NOT IN ('', 'NaN')),
c AS (SELECT field, term, count(*) AS n_occur, count(DISTINCT id) AS n_records FROM t WHERE term <> '' GROUP BY ALL)
SELECT field, term, n_occur, n_records, CASE WHEN n_records <= 2 THEN 'rare' WHEN n_records * 100 > (SELECT count(DISTINCT id) FROM {CENSUS}) THEN 'common' ELSE 'usable' END AS mark FROM c""",
        "p10_found": """
WITH w AS (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS p FROM documents WHERE length(text) >= 200 AND doc_id IS NOT NULL),
x AS (SELECT doc_id, p, substr(text, p + 1, 200) AS s FROM w),
sh AS (SELECT s FROM x GROUP BY s HAVING min(doc_id) <> max(doc_id)),
h AS (SELECT DISTINCT doc_id, p FROM x SEMI JOIN sh USING (s)),
i AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS n FROM h),
g AS (SELECT doc_id, p, sum(n) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM i)
SELECT doc_id, CAST(min(p) AS INTEGER) AS span_start, CAST(max(p) + 200 AS INTEGER) AS span_end FROM g GROUP BY doc_id, k""",
        "p10_shares": """
WITH w AS (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS p FROM documents WHERE length(text) >= 200 AND doc_id IS NOT NULL),
x AS (SELECT doc_id, p, substr(text, p + 1, 200) AS s FROM w),
sh AS (SELECT s FROM x GROUP BY s HAVING min(doc_id) <> max(doc_id)),
h AS (SELECT DISTINCT doc_id, p FROM x SEMI JOIN sh USING (s)),
n AS (SELECT doc_id, least(200, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p, 200)) AS k FROM h),
c AS (SELECT doc_id, CAST(sum(k) AS BIGINT) AS n_shared FROM n GROUP BY doc_id),
d AS (SELECT doc_id, max(length(text)) AS n_chars FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY doc_id)
SELECT doc_id, n_chars, coalesce(n_shared, 0) AS n_shared, round(CASE WHEN n_chars > 0 THEN coalesce(n_shared, 0) / n_chars ELSE 0.0 END, 6) AS share FROM d LEFT JOIN c USING (doc_id)""",
        "p1_found": """
WITH RECURSIVE r AS (SELECT DISTINCT id, run_no, CAST(row_pos AS BIGINT) AS row_pos, ensemble_classification AS x FROM classified_results_with_ensemble),
l AS (SELECT id, run_no, CAST(unnest(regexp_extract_all(regexp_replace(x, '\\.0*', '', 'g'), '[0-9]+')) AS BIGINT) AS pos FROM r),
e AS (SELECT DISTINCT l.id AS a, r.id AS b FROM l JOIN r ON r.run_no = l.run_no AND r.row_pos = l.pos WHERE l.id <> r.id),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w(id, g) USING KEY (id) AS (SELECT DISTINCT id, id FROM r UNION SELECT s.b, min(w.g) FROM w JOIN s ON s.a = w.id JOIN recurring.w AS k ON k.id = s.b WHERE w.g < k.g GROUP BY s.b)
SELECT id, g AS group_id FROM w""",
    }
