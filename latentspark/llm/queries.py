"""Queries of the training-data operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark.functions import answers
from latentspark.llm import clusters, leakage, mix, sample, subjects
from latentspark.llm.sql import SQL
from latentspark.sources import materialise, read_table

__all__ = ["QUERIES", "SQL"]

PROBE_FIELDS = ("imag", "sat", "loy")


def _std(name: str):
    """A construct score in 'std' units; NaN and infinities read as NULL."""
    x = answers.finite(F.col(name))
    return F.when(F.col("score_unit") == "tscore", (x - 50.0) / 10.0).otherwise(x)


def _grid(spark: SparkSession, d: str) -> clusters.GridClusters:
    return clusters.GridClusters(read_table(spark, d, "satisfaction_scores"), {n: _std(n) for n in PROBE_FIELDS}, "score_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    grid = _grid(spark, d)
    probes = read_table(spark, d, "score_probes").select("probe_id", *[answers.finite(F.col(n)).alias(n) for n in PROBE_FIELDS]).dropna()
    named = grid.assign(probes).groupBy("label").agg(F.min("probe_id").alias("probe_id"))
    return grid.assign(grid.points).join(named, "label").select("score_id", "probe_id")


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every clustered record with its cluster, the cluster's size and the most typical members."""
    scores = read_table(spark, d, "satisfaction_scores")
    return clusters.clusters(scores, {n: _std(n) for n in PROBE_FIELDS}, "score_id")


def _category_sample(spark: SparkSession, d: str) -> sample.CategorySample:
    people = sample.unit_categories(read_table(spark, d, "satisfaction"), "satisfaction", answers.gender(F.col("gender")))
    kind = answers.on_scale(F.col("servicetype"), 1, 3).cast("string")
    accounts = sample.unit_categories(read_table(spark, d, "corporate_reputation"), "corporate_reputation", kind)
    return sample.CategorySample(people.unionByName(accounts), read_table(spark, d, "sample_plans"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Categories of which the drawn sample holds every unit and still fewer than needed."""
    return _category_sample(spark, d).drawn().filter("exhausted").select("plan_id", "category")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Needs, drawn rows and shares of every plan category."""
    return _category_sample(spark, d).drawn()


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    """The records drawn for every plan."""
    return _category_sample(spark, d).draw().withColumnRenamed("unit", "obs_id")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", mix.source_key(F.col("source")).alias("source"), "text")
    return materialise(mix.count_tokens(docs, "text"), "tokens")


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "mix_targets").withColumn("source", mix.source_key(F.col("source")))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Targets and budgets of every source of every mix as large as the corpus."""
    return mix.shares(_sized(spark, d), _targets(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose documents, selected as often as allowed, fall short of their share."""
    return p7_reached(spark, d).filter("short").select("mix_id", "source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of every mix with the number of copies."""
    sized = _sized(spark, d)
    return mix.mix(sized, mix.shares(sized, _targets(spark, d)), "doc_id")


def p7_reached(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the selections of p7_mix really have."""
    sized = _sized(spark, d)
    plan = mix.shares(sized, _targets(spark, d))
    return mix.reached(mix.mix(sized, plan, "doc_id"), plan)


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """The leaked items of every document with the overlap of the question and of the answer."""
    docs, items = read_table(spark, d, "documents"), read_table(spark, d, "eval_items")
    return leakage.leaks(docs, items, "doc_id", "text", "item_id", "item_text", "answer")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_leaks(spark, d).select("doc_id", "item_id")


def _shares(spark: SparkSession, d: str, least: float) -> DataFrame:
    docs, labelled = read_table(spark, d, "documents"), read_table(spark, d, "labelled_passages")
    return subjects.subject_shares(docs, labelled, "doc_id", "text", "subject", "lang", "passage", least)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d, subjects.MIN_SHARE).select("doc_id", "subject")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of every subject in every document's prose."""
    return _shares(spark, d, 0.0)


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and prose words of the corpus by subject."""
    shares = _shares(spark, d, 0.0)
    counted = F.count(F.when(F.col("share") >= subjects.MIN_SHARE, 1)).alias("documents")
    words = F.round(F.sum(F.col("share") * F.col("words"))).cast("bigint").alias("prose_words")
    return shares.groupBy("subject").agg(counted, words)


QUERIES = {
    "p3_found": p3_found,
    "p3_clusters": p3_clusters,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p5_sample": p5_sample,
    "p6_found": p6_found,
    "p6_leaks": p6_leaks,
    "p7_found": p7_found,
    "p7_shares": p7_shares,
    "p7_mix": p7_mix,
    "p7_reached": p7_reached,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
    "p8_composition": p8_composition,
}
