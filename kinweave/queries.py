"""Queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kinweave.functions import compare as cmp, evidence as ev
from kinweave.operators import features, linkage, metrics, models, pool, prepare, sampling
from kinweave.plans.adapters import ASCII_MARITAL, PART_NAMES, PART_UNIQUE, REC_PARTS_SQL, TRANSITIONS_SQL, rec_orders, rec_parts, rec_parts_unique, transitions
from kinweave.runtime import small_side, table
from kinweave.sources.rejects import person_records

CENSUS, PREDICTED = "updated_icelandic_census_data", "rule_based_predictions"
#: Labelled pairs that the evidence pool learns from.
POOL_PAIRS = 500
SPLITS = {"train": 0.6, "test": 0.2, "compare": 0.2}


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return person_records(table(spark, root, "cleaned_einstaklingar")).where("reason is not null").select("line_no", "reason")


def p6_rows(spark: SparkSession, root: str) -> DataFrame:
    return person_records(table(spark, root, "cleaned_einstaklingar")).where("reason is null").drop("reason", "csv_error")


# --- rule-based linkage on the part adapter


def _edges(spark: SparkSession, root: str) -> DataFrame:
    """Scored candidate edges of all records."""
    pairs = linkage.capped_candidates(rec_parts_unique(spark, root))
    return linkage.scored(pairs, transitions(spark, root), PART_NAMES, marital=ASCII_MARITAL)


def _linked(spark: SparkSession, root: str, mode: str) -> DataFrame:
    out = linkage.link(rec_parts_unique(spark, root), transitions(spark, root), PART_NAMES, mode, ASCII_MARITAL)
    return out.withColumn("score", F.round("score", 6))


def link_min_seed(spark, root):
    return _linked(spark, root, "first_seed")


def link_intended(spark, root):
    return _linked(spark, root, "greedy_cover")


def link_one_seed(spark, root):
    """All scored candidates of one entry, with the flag of rows that carry its name."""
    r = rec_parts_unique(spark, root)
    p = linkage.capped_candidates(r, r.where("id = 7"))
    e = linkage.scored(p, transitions(spark, root), PART_NAMES, marital=ASCII_MARITAL)
    return e.select("match_id", "manntal", F.round("score", 6).alias("score"), (F.col("name") == 0).alias("same_name"))


def _census_records(spark, root):
    """First deliveries of the census rows, placed in their units, with uniqueness and group of position."""
    c = prepare.first_rows(table(spark, root, CENSUS), ["id"], ["skrad_at"]).withColumn("faedingarar", F.nullif("faedingarar", F.lit(0.0)))
    groups = table(spark, root, "stada_listi").select("cleaned_status", "stada_group").dropDuplicates(["cleaned_status"])
    c = prepare.with_location(c, table(spark, root, "manntol_baeir")).join(small_side(groups), "cleaned_status", "left")
    return prepare.with_uniqueness(c.withColumns({"millinafn": F.lit(""), "aettarnafn": F.lit("")}), PART_UNIQUE)


def link_census(spark, root):
    """The whole linkage on the census rows: every row with the person it is assigned to."""
    out = linkage.link(_census_records(spark, root), table(spark, root, "updated_data"), PART_NAMES)
    return out.withColumn("score", F.round("score", 6))


def uniqueness_score(spark, root):
    return rec_parts_unique(spark, root).select("id", F.round("uniqueness_score", 6).alias("uniqueness_score"))


def value_extremes(spark, root):
    return prepare.value_extremes(table(spark, root, CENSUS), ["nafn", "fornafn", "eftirnafn", "kyn", "stada"])


def name_value_counts(spark, root):
    return prepare.value_counts(table(spark, root, CENSUS), "fornafn")


def column_ends(spark, root):
    c = table(spark, root, PREDICTED)
    return c.agg(F.max("score").alias("max_score"), F.min("score").alias("min_score"), F.percentile("score", F.lit(0.5)).alias("median_score"), F.countDistinct("id_individual").alias("n_individuals"), F.count("*").alias("n_rows"))


def block_pairs(spark, root):
    """How many candidates every record has before the edit caps."""
    return linkage.candidate_counts(rec_parts(spark, root))


def edit_caps(spark, root):
    """How many candidates every record has within the edit caps."""
    return linkage.capped_counts(rec_parts(spark, root))


def distance_terms(spark, root):
    """Sums of the five terms of each seed's candidates: names, age, location, marital status, position."""
    e = _edges(spark, root)
    return e.groupBy("seed_id").agg(*[F.round(F.sum(c), 6).cast("double").alias(c) for c in linkage.TERMS])


def weighted_score(spark, root):
    pairs = linkage.capped_candidates(rec_parts_unique(spark, root))
    e = linkage.scored(pairs, transitions(spark, root), PART_NAMES, {"name": 2.0, "stada": 0.5}, ASCII_MARITAL)
    return e.groupBy("seed_id").agg(F.round(F.max("score"), 6).alias("max_score"), F.round(F.avg("score"), 6).alias("mean_score"))


def accept_flags(spark, root):
    a = linkage.accepted(_edges(spark, root))
    return a.groupBy("seed_id", "manntal").agg(F.count("*").alias("n_accepted"), F.round(F.min("score"), 6).alias("best"))


def unassigned_rows(spark, root):
    r = rec_parts_unique(spark, root)
    a = linkage.first_seed(linkage.accepted(_edges(spark, root)))
    return r.join(a, r.id == a.match_id, "left").where("id_individual is null").select("id", "nafn")


def cluster_sizes_offset(spark, root):
    """The predicted person at offset 1000 by size, of all that have a size."""
    n = table(spark, root, PREDICTED).where("id_individual is not null").groupBy("id_individual").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "id_individual").offset(1000).limit(1)


def cluster_history(spark, root):
    """Years and rows of every predicted person, in order of census."""
    p = table(spark, root, PREDICTED).where("id_individual is not null")
    return p.groupBy("id_individual").agg(F.array_join(F.array_sort(F.collect_set("manntal")), ",").alias("years"), F.count("*").alias("n"))


def enrich_location_left(spark, root):
    out = prepare.with_location(table(spark, root, CENSUS).select("id", "manntal", "bi_baer"), table(spark, root, "manntol_baeir"))
    return out.select("id", "bi_hreppur", "bi_sokn", "bi_sysla")


def downcast_fill(spark, root):
    c = table(spark, root, PREDICTED).select("id", "nafn", "millinafn", "faedingarar", "bi_hreppur", "bi_sokn")
    out = prepare.narrowed(prepare.fill_missing(c, ["nafn", "millinafn"], ["faedingarar", "bi_hreppur", "bi_sokn"]), ["bi_hreppur", "bi_sokn"])
    return out.withColumns({c: F.col(c).cast("int") for c in ("bi_hreppur", "bi_sokn")})


# --- clusters, pairs, splits, samples


def _persons(spark, root):
    return table(spark, root, CENSUS).where("bi_einstaklingur is not null and bi_einstaklingur <> 0").select("id", F.col("bi_einstaklingur").alias("person")).distinct()


def self_reference(spark, root):
    return table(spark, root, CENSUS).where("id = bi_einstaklingur").select("id", "manntal", "nafn").distinct()


def singleton_split(spark, root):
    one, more = sampling.singletons(_persons(spark, root), "person")
    return one.withColumn("single", F.lit(True)).unionByName(more.withColumn("single", F.lit(False)))


def cluster_split_80_20(spark, root):
    return sampling.split_clusters(_persons(spark, root), "person", {"train": 0.8, "test": 0.2})


def split_60_20_20(spark, root):
    return sampling.split_clusters(_persons(spark, root), "person", SPLITS)


def sample_fraction(spark, root):
    return sampling.sample_fraction(_persons(spark, root), "id", 0.5)


def sample_n(spark, root):
    return sampling.sample_rows(_persons(spark, root).select("id").distinct(), "id", 100)


def oversample_min20(spark, root):
    o = sampling.oversampled(_persons(spark, root), "id", "person", 20)
    return o.groupBy("person").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


def positive_pairs(spark, root):
    return sampling.positive_pairs(_persons(spark, root), "id", "person")


def negative_pairs(spark, root):
    return sampling.negative_pairs(_persons(spark, root), "id", "person")


def pair_sanity(spark, root):
    p = _persons(spark, root)
    return metrics.pair_sanity(sampling.positive_pairs(p, "id", "person").unionByName(sampling.negative_pairs(p, "id", "person")))


def all_pairs_small(spark, root):
    return sampling.all_pairs(table(spark, root, "nation"), "n_nationkey")


def neighbour_pairs(spark, root):
    pos = prepare.row_positions(table(spark, root, CENSUS).select("id").distinct(), ["id"])
    return sampling.neighbour_pairs(pos, "id", 3).select("id_1", "id_2", F.col("step").cast("int").alias("step"))


def pair_counts(spark, root):
    return metrics.pair_counts(_persons(spark, root), "person")


def cluster_histogram(spark, root):
    return metrics.cluster_histogram(_persons(spark, root), "person", 30).select("bin", "n")


# --- metrics: neighbours by id, label = one curated person, prediction = one name


def _judged(spark, root):
    """Every curated record with the next two of its place by name and id."""
    c = table(spark, root, CENSUS).groupBy("id").agg(F.min("nafn").alias("nafn"), F.min("bi_einstaklingur").alias("person"), F.min("faedingarar").alias("born"), F.min("bi_baer").alias("place"))
    w = Window.partitionBy("place").orderBy("nafn", "id")
    row = F.struct("id", "nafn", "person", "born")
    near = c.where("person <> 0 and place is not null").select(row.alias("a"), F.array(F.lead(row, 1).over(w), F.lead(row, 2).over(w)).alias("_b"))
    near = near.select("a", F.explode("_b").alias("b")).where("b is not null")
    score = F.coalesce(F.round(1.0 / (1.0 + F.abs(F.col("a.born") - F.col("b.born"))), 6), F.lit(0.0))
    return near.select(
        F.col("a.id").alias("id_1"), F.col("b.id").alias("id_2"), (F.col("a.person") == F.col("b.person")).cast("int").alias("label"),
        F.coalesce((F.col("a.nafn") == F.col("b.nafn")).cast("int"), F.lit(0)).alias("predicted"), score.alias("score"),
    )


def accuracy(spark, root):
    return metrics.accuracy(_judged(spark, root)).select(F.round("accuracy", 6).alias("accuracy"))


def confusion(spark, root):
    return metrics.confusion(_judged(spark, root))


def adjusted_rand(spark, root):
    return metrics.adjusted_rand(_judged(spark, root)).select(F.round("adjusted_rand", 6).alias("adjusted_rand"))


def roc_points(spark, root):
    return metrics.roc_points(_judged(spark, root)).select("threshold", "tp", "fp", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


def auc(spark, root):
    return metrics.auc(_judged(spark, root)).select(F.round("auc", 6).alias("auc"))


def youden(spark, root):
    return metrics.youden(_judged(spark, root)).select("threshold", F.round("youden", 6).alias("youden"))


def per_row_correct(spark, root):
    return metrics.correct_by_row(_judged(spark, root))


def chunk_metrics(spark, root):
    return metrics.chunked(_judged(spark, root), "id_1", 1000).select("chunk", F.round("accuracy", 6).alias("accuracy"), "n")


def match_adjacency(spark, root):
    return metrics.partners(_judged(spark, root).where("predicted = 1")).select("id", cmp.ids_text(F.col("matches")).alias("matches"))


def majority_vote(spark, root):
    """Six votes on each order, from digits of its keys."""
    o = table(spark, root, "orders")
    votes = F.array(*[((F.col("o_custkey") + F.col("o_orderkey") * k) % 7 < 3).cast("int") for k in range(1, 7)])
    return metrics.majority(o.select(F.col("o_orderkey").alias("id"), F.explode(votes).alias("vote")))


# --- evidence


def _stated(spark, root):
    """Neighbouring records of a farm with their statements."""
    c = table(spark, root, CENSUS).where("bi_baer is not null")
    c = prepare.first_rows(c, ["id"], [F.col("skrad_at"), F.col("hjuskapur")])
    w = Window.partitionBy("bi_baer").orderBy("id")
    d = c.select(F.struct(*[x for x in c.columns if x != "skrad_at"]).alias("a"), F.lead(F.struct(*[x for x in c.columns if x != "skrad_at"])).over(w).alias("b")).where("b is not null")
    return d.select(F.col("a.id").alias("id_1"), F.col("b.id").alias("id_2"), ev.statements("a", "b").alias("statements"), ev.same_person("a", "b").alias("same"))


def statements(spark, root):
    return _stated(spark, root).select("id_1", "id_2", F.array_join("statements", "|").alias("statements"), F.col("same").cast("int").alias("label"))


def truth_revision(spark, root):
    p = table(spark, root, "part")
    one = ev.Truth.of((F.col("p_partkey") % 5) / 4.0, (F.col("p_size") % 10) / 10.0)
    two = ev.Truth.of((F.col("p_partkey") % 3) / 2.0, (F.col("p_size") % 7) / 7.0)
    r = one.revised(two)
    return p.select("p_partkey", F.round(r.f, 6).alias("f"), F.round(r.c, 6).alias("c"), F.round(r.expectation(), 6).alias("e"))


def pattern_match(spark, root):
    """Likeness of every pair's statements to those of the pair before it in its farm's order of ids."""
    d = _stated(spark, root).select("id_1", "statements")
    nxt = _stated(spark, root).select(F.col("id_2").alias("id_1"), F.col("statements").alias("theirs"))
    j = d.join(nxt, "id_1")
    return j.select("id_1", F.round(ev.pattern_likeness(F.col("statements"), F.col("theirs")), 6).alias("likeness"))


def pool_train(spark, root, pairs: int = POOL_PAIRS):
    """The pool learnt from the first labelled pairs by id, `pairs` at most: learning is one sequence."""
    first = _stated(spark, root).orderBy("id_1", "id_2").limit(pairs)
    return pool.trained_pool(first, ["id_1", "id_2"])


def evidence_score_frozen(spark, root):
    scored = pool.frozen_scores(_stated(spark, root), pool_train(spark, root))
    return scored.select("id_1", "id_2", "same", F.round("expectation", 6).alias("expectation"))


def evidence_success(spark, root):
    return pool.successes(pool.frozen_scores(_stated(spark, root), pool_train(spark, root)))


def pool_rules(spark, root):
    return pool.rule_lines(pool_train(spark, root))


# --- features and models


def one_hot(spark, root):
    return features.one_hot(table(spark, root, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").drop("c_mktsegment")


def label_encode(spark, root):
    return features.label_encoded(table(spark, root, "part").select("p_partkey", "p_name"), "p_name", "code").select("p_partkey", "code")


def standardize(spark, root):
    d = features.standardised(table(spark, root, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    return d.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


def clean_tokens(spark, root):
    """Words of cleaned names, and their number."""
    w = table(spark, root, CENSUS).where("nafn is not null").select(F.explode(cmp.words(cmp.clean_name(F.col("nafn")))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n"))


def euclid_pairs(spark, root):
    """Distance of each vector to the next one of its label."""
    e = table(spark, root, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    d = e.withColumn("b", F.lead("embedding").over(w)).where("b is not null")
    return d.select("vec_id", F.round(cmp.euclidean(F.col("embedding"), F.col("b")), 4).alias("distance"))


def contrastive_loss(spark, root):
    e = table(spark, root, "embeddings")
    w = Window.orderBy("vec_id").partitionBy(F.expr("vec_id div 10"))
    d = e.withColumn("b", F.lead(F.struct("embedding", "label")).over(w)).where("b is not null")
    dist = cmp.euclidean(F.col("embedding"), F.col("b.embedding"))
    return d.select("vec_id", F.round(cmp.contrastive_loss(dist, (F.col("label") == F.col("b.label")).cast("int"), same_is=1), 4).alias("loss"))


def argmax_vectors(spark, root):
    return table(spark, root, "embeddings").select("vec_id", cmp.argmax(F.col("embedding")).alias("at"))


def _vector_pairs(spark, root):
    e = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label")
    p = sampling.positive_pairs(e, "id", "label").unionByName(sampling.negative_pairs(e, "id", "label"))
    w = Window.partitionBy("label").orderBy("id")
    near = e.select(F.col("id").alias("id_1"), F.lead("id").over(w).alias("id_2"), F.lit(1).alias("label")).where("id_2 is not null")
    far = e.select("id", "label").withColumn("g", F.expr("id div 50"))
    w = Window.partitionBy("g").orderBy("id")
    far = far.select(F.col("id").alias("id_1"), F.lead(F.struct("id", "label")).over(w).alias("b"), F.col("label").alias("l")).where("b is not null and b.label <> l")
    far = far.select("id_1", F.col("b.id").alias("id_2"), F.lit(0).alias("label"))
    pairs = p.select("id_1", "id_2", "label").unionByName(near).unionByName(far).distinct()
    return sampling.split_clusters(models.as_features(features.pair_features(pairs, e)), "id_1", {"train": 0.7, "test": 0.3})


def model_metrics(spark, root):
    d = _vector_pairs(spark, root).persist()
    pick = ("svm", "logistic_regression", "gaussian_nb", "bernoulli_nb", "decision_tree")
    known = models.registry(128)
    return models.evaluate(d.where("split = 'train'"), d.where("split = 'test'"), {k: known[k] for k in pick})


def ensemble_vote(spark, root):
    d = _vector_pairs(spark, root).persist()
    known = models.registry(128)
    return models.vote(d.where("split = 'train'"), d.where("split = 'test'"), {k: known[k] for k in ("logistic_regression", "gaussian_nb", "decision_tree", "svm")})


def nearest_neighbours(spark, root):
    e = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"), "label")
    return models.nearest_vote(e, e.where("id % 20 = 0"), 5)


def pca_ratio(spark, root):
    e = table(spark, root, "embeddings")
    wide = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    out, _ = features.principal_components(wide, [f"x{i}" for i in range(64)])
    return out.select("vec_id", F.size("pca").alias("n_components"))


def embed_names(spark, root):
    d = table(spark, root, PREDICTED).select("id", "nafn").distinct()
    return features.name_embeddings(d, "nafn", size=16)[0].select("id", F.size("embedding").alias("size"))


_NAMES = [n for n in (
    "link_min_seed link_census link_intended link_one_seed uniqueness_score value_extremes name_value_counts column_ends block_pairs edit_caps distance_terms weighted_score accept_flags unassigned_rows "
    "cluster_sizes_offset cluster_history enrich_location_left downcast_fill self_reference singleton_split cluster_split_80_20 split_60_20_20 sample_fraction sample_n oversample_min20 "
    "positive_pairs negative_pairs pair_sanity all_pairs_small neighbour_pairs pair_counts cluster_histogram accuracy confusion adjusted_rand roc_points auc youden per_row_correct chunk_metrics "
    "match_adjacency majority_vote statements truth_revision pattern_match pool_train evidence_score_frozen evidence_success pool_rules one_hot label_encode standardize clean_tokens euclid_pairs "
    "contrastive_loss argmax_vectors model_metrics ensemble_vote nearest_neighbours pca_ratio embed_names p6_found p6_rows").split()]  # fmt: skip


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES}


def oracle_sql() -> dict[str, str]:
    from kinweave.oracle import sql

    return sql()
