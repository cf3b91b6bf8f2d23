"""Samples that match target category shares: systematic sampling with unequal probabilities.

Units are sorted by category and, inside, by a hash; each has the inclusion probability (wanted rows
of its category) / (units of its category). The probabilities are prefix-summed over all units of a
plan, and those where the sum passes an integer plus one random start are taken. Ranks come from
bucketed prefix sums, so a study of any size is never in one task; they are computed once per study
and category, whatever the number of plans. Floors are repaired afterwards: where a category has
fewer than its minimum, further units follow in rank order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.operators.ranks import buckets_for, hash_prefix


def allocate(plans: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per plan category: needed, available, wanted (inclusion mass) and ``ahead``, the mass
    of the categories that sort before it, plus the plan's random start in [0, 1)."""
    share = F.col("sample_rows") * F.col("target_pct") / 100.0
    p = plans.select("plan_id", "tbl", "study_no", "category", "target_pct", "sample_rows", "min_rows").join(sizes, ["tbl", "study_no", "category"], "left")
    p = p.select(
        "plan_id",
        "tbl",
        "study_no",
        "category",
        "target_pct",
        "sample_rows",
        "min_rows",
        share.alias("target_rows"),
        F.greatest(share, F.col("min_rows").cast("double")).alias("needed"),
        F.coalesce("available", F.lit(0)).cast("bigint").alias("available"),
    )
    p = p.withColumn("wanted", F.least(F.col("target_rows"), F.col("available").cast("double")))
    # a plan has one row per category: this self-join is a few rows per plan
    before = p.select("plan_id", F.col("category").alias("_c"), F.col("wanted").alias("_w"))
    ahead = p.select("plan_id", "category").join(before, "plan_id").filter("_c < category")
    ahead = ahead.groupBy("plan_id", "category").agg(F.sum("_w").alias("_ahead"))
    p = p.join(ahead, ["plan_id", "category"], "left")
    start = (F.pmod(F.xxhash64(F.lit("start"), "plan_id"), F.lit(1 << 40)) / float(1 << 40)).alias("start")
    return p.select("*", start).withColumn("ahead", F.coalesce("_ahead", F.lit(0.0))).drop("_ahead")


def _taken(upto, alloc_ahead="ahead"):
    """Integers passed up to a cumulated mass (the plan's start shifts the grid)."""
    return F.floor(F.col(alloc_ahead) + upto + F.col("start") + F.lit(1e-9))


class CategorySample:
    """units: (tbl, study_no, category, unit) with one row per unit; plans: as TESTDATA's sample_plans.

    A NULL category belongs to no plan. Plans without units get an empty sample and a report.
    """

    def __init__(self, units: DataFrame, plans: DataFrame):
        self.units = units.filter(F.col("category").isNotNull()).select("tbl", "study_no", "category", "unit")
        self.sizes = self.units.groupBy("tbl", "study_no", "category").agg(F.count(F.lit(1)).alias("available"))
        self.plans = allocate(plans, self.sizes)

    def report(self) -> DataFrame:
        """One row per plan category with needs, selected rows and shares, and whether it is met.

        The selected number is exact without drawing: integers passed by the category's mass, lifted
        to the minimum where there are units enough."""
        crossed = (_taken(F.col("wanted")) - _taken(F.lit(0.0))).cast("bigint")
        floor = F.least(F.col("min_rows").cast("bigint"), F.col("available"))
        r = self.plans.select(
            "plan_id", "tbl", "study_no", "category", "target_pct", "sample_rows", "min_rows", "needed", "available",
            crossed.alias("crossed"),
            F.greatest(crossed, floor).cast("bigint").alias("selected"),
            (F.col("available") >= F.col("needed")).alias("met"),
        )
        total = r.groupBy("plan_id").agg(F.sum("selected").alias("sample_size"))
        r = r.join(total, "plan_id")
        return r.withColumn("reached_pct", F.coalesce(F.try_divide(100.0 * F.col("selected"), F.col("sample_size")), F.lit(0.0)))

    def places(self) -> DataFrame:
        """(plan_id, tbl, study_no, category, place, how): which unit of its category, counted from 0 in
        hash order, each plan takes: as many rows as all samples have, not as the studies have."""
        r = self.report().select("plan_id", "category", "crossed", "selected")
        p = self.plans.join(r, ["plan_id", "category"]).filter("selected > 0")
        # each plan walks the category from its own place, so that plans of a study differ
        some = F.greatest("available", F.lit(1))
        p = p.withColumns({"turn": F.pmod(F.xxhash64(F.lit("turn"), "plan_id"), some), "step": F.col("wanted") / some, "first": _taken(F.lit(0.0))})
        passed, already = _taken((F.col("rank") + 1) * F.col("step")), _taken(F.col("rank") * F.col("step"))
        # the rank that passes the integer m, found within one of what division gives
        hits = p.filter("crossed > 0").withColumn("m", F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.greatest("crossed", F.lit(1)))))
        near = F.ceil((F.col("m") - F.col("ahead") - F.col("start") - F.lit(1e-9)) / F.greatest("step", F.lit(1e-300))) - 1
        hits = hits.withColumn("rank", F.explode(F.array(near - 1, near, near + 1))).filter((passed >= F.col("m")) & (already < F.col("m")) & F.col("rank").between(0, F.col("available") - 1))
        # the floor: units that are not hit, in rank order; as many ranks as are selected hold enough of them
        rest = p.filter("selected > crossed").withColumn("rank", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("selected") - 1, F.lit(0)))))
        missed = F.col("rank") - (already - F.col("first"))
        rest = rest.filter((passed == already) & (missed < F.col("selected") - F.col("crossed")))
        both = hits.drop("m").withColumn("how", F.lit("systematic")).unionByName(rest.withColumn("how", F.lit("floor")))
        place = F.pmod(F.col("rank") - F.col("turn"), F.greatest("available", F.lit(1))).alias("place")
        return both.select("plan_id", "tbl", "study_no", "category", place, "how")

    def draw(self) -> DataFrame:
        """(plan_id, category, unit, how): the sample; how is 'systematic' or 'floor'."""
        rows = self.units.count()
        ranked = self.units.withColumn("_h", F.xxhash64(F.lit("order"), "unit"))
        ranked = hash_prefix(ranked, ["tbl", "study_no", "category"], "_h", "unit", F.lit(1), buckets_for(rows))
        x = ranked.withColumnRenamed("before", "place").join(self.places(), ["tbl", "study_no", "category", "place"])
        return x.select("plan_id", "category", "unit", "how")

    def drawn(self) -> DataFrame:
        """The report with ``drawn``, the units that the sample really has, and ``exhausted``: whether it
        holds every unit of its category and still fewer than needed."""
        got = self.draw().groupBy("plan_id", "category").agg(F.count(F.lit(1)).alias("drawn"))
        r = self.report().join(got, ["plan_id", "category"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        return r.withColumn("exhausted", (F.col("drawn") == F.col("available")) & (F.col("drawn") < F.col("needed")))


def unit_categories(df: DataFrame, table: str, category) -> DataFrame:
    """One row per obs_id and study: the category answered in any of its rows (the most frequent one,
    the first in order on ties); units without an answer drop out, as do NULL ids."""
    c = df.select("study_no", F.col("obs_id").alias("unit"), category.alias("category"))
    c = c.filter("category IS NOT NULL AND unit IS NOT NULL")
    c = c.groupBy("study_no", "unit", "category").agg(F.count(F.lit(1)).alias("n"))
    top = c.groupBy("study_no", "unit").agg(F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("category"))
    return top.select(F.lit(table).alias("tbl"), "study_no", "category", "unit")
