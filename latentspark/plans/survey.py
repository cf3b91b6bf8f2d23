"""Queries of the data-cleaning operators over the survey tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark.functions import answers
from latentspark.operators import impute, parse, profile
from latentspark.sources import read_table

MAX_CODES = 100_000  # code lists larger than this are not held in memory


def _scales(spark: SparkSession, d: str, table: str) -> list[tuple[str, int, int]]:
    rows = read_table(spark, d, "model_indicators").filter(F.col("tbl") == table).limit(MAX_CODES + 1).collect()
    if len(rows) > MAX_CODES:
        raise ValueError(f"more than {MAX_CODES} indicators of {table}")
    return sorted((r["fld"], r["scale_min"], r["scale_max"]) for r in rows)


def _codes(df: DataFrame, column: str) -> list[str]:
    rows = df.select(F.col(column).cast("string")).filter(F.col(column).isNotNull()).distinct().limit(MAX_CODES + 1).collect()
    if len(rows) > MAX_CODES:
        raise ValueError(f"more than {MAX_CODES} codes in {column}")
    return sorted(r[0] for r in rows)


def satisfaction_fill(spark: SparkSession, d: str) -> impute.FillSpec:
    numbers = [impute.Field(n, lo, hi) for n, lo, hi in _scales(spark, d, "satisfaction")]
    sex = impute.Field("gender", labels=("female", "male", "diverse"), read=answers.gender)
    return impute.FillSpec(
        "row_id",
        (*numbers, sex),
        ("sat1", "gender"),
        {"respondent": ("panel_id",), "copy": ("obs_id",), "wave": ("study_no", "wave")},
        "respondent",
        ("gender",),
    )


def reputation_fill(spark: SparkSession, d: str) -> impute.FillSpec:
    numbers = [impute.Field(n, lo, hi) for n, lo, hi in _scales(spark, d, "corporate_reputation")]
    kind = impute.Field("servicetype", labels=("1", "2", "3"))
    provider = impute.Field("serviceprovider", labels=tuple(_codes(read_table(spark, d, "providers"), "serviceprovider")))
    return impute.FillSpec(
        "row_id",
        (*numbers, kind, provider),
        ("cusl_1", "servicetype"),
        {"account": ("account_id",), "copy": ("obs_id",), "provider": ("serviceprovider", "study_no")},
        "account",
        ("servicetype",),
    )


def p1_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every filled cell of both tables: value, method, confidence and the known fill."""
    parts = []
    for table, spec in (("satisfaction", satisfaction_fill(spark, d)), ("corporate_reputation", reputation_fill(spark, d))):
        parts.append(impute.filled_cells(read_table(spark, d, table), spec).select(F.lit(table).alias("tbl"), "*"))
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_cells(spark, d).select("tbl", "row_id", "fld", "known_fill")


def p1_filled_satisfaction(spark: SparkSession, d: str) -> DataFrame:
    """The satisfaction records with sat1 and gender complete and marked."""
    full = impute.fill_missing(read_table(spark, d, "satisfaction"), satisfaction_fill(spark, d))
    return full.select("row_id", "sat1", "sat1_filled", "gender", "gender_filled")


def p1_filled_reputation(spark: SparkSession, d: str) -> DataFrame:
    """The corporate reputation records with cusl_1 and servicetype complete and marked."""
    full = impute.fill_missing(read_table(spark, d, "corporate_reputation"), reputation_fill(spark, d))
    return full.select("row_id", "cusl_1", "cusl_1_filled", "servicetype", "servicetype_filled")


def p1_heldout(spark: SparkSession, d: str) -> DataFrame:
    """How well the tree fills answered cells that it does not see, beside the commonest answer."""
    parts = []
    for table, spec in (("satisfaction", satisfaction_fill(spark, d)), ("corporate_reputation", reputation_fill(spark, d))):
        parts.append(impute.held_out(read_table(spark, d, table), spec).select(F.lit(table).alias("tbl"), "*"))
    return parts[0].unionByName(parts[1])


def _feed(header: str, sep: str, special: dict[str, parse.Column], scales: list[tuple[str, int, int]]) -> parse.Feed:
    by_name = {n: parse.Column(n, "number", lo, hi) for n, lo, hi in scales} | special
    names = parse.zero_cost_fields(header.rstrip("\r"), sep, parse.splitter(sep)) or []
    return parse.Feed(sep, tuple(by_name.get(n.strip(), parse.Column(n.strip() or "id")) for n in names))


def feeds(spark: SparkSession, d: str) -> dict[str, parse.Feed]:
    """The feeds of raw_lines: columns in the order of each feed's most frequent header line."""
    heads = read_table(spark, d, "raw_lines").filter("line_no = 1").groupBy("feed", "line").count()
    top = heads.groupBy("feed").agg(F.max_by("line", F.struct("count", "line")).alias("line"))
    header = {r["feed"]: r["line"] for r in top.filter(F.col("feed").isin("satisfaction", "corporate_reputation")).collect()}
    providers = frozenset(_codes(read_table(spark, d, "providers"), "serviceprovider"))
    out = {}
    if "satisfaction" in header:
        sex = parse.Column("gender", "word", codes=frozenset(answers.GENDERS))
        out["satisfaction"] = _feed(header["satisfaction"], ",", {"gender": sex}, _scales(spark, d, "satisfaction"))
    if "corporate_reputation" in header:
        special = {
            "serviceprovider": parse.Column("serviceprovider", "code", codes=providers),
            "servicetype": parse.Column("servicetype", "number", 1, 3),
        }
        out["corporate_reputation"] = _feed(header["corporate_reputation"], ";", special, _scales(spark, d, "corporate_reputation"))
    return out


def p2_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Every raw line: loaded with its fields, or rejected with reason and edits."""
    return parse.parse_lines(read_table(spark, d, "raw_lines"), feeds(spark, d))


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The values of every loaded line, as text in column order."""
    return p2_parsed(spark, d).filter("reason IS NULL").select("line_id", "feed", F.concat_ws("\x1f", F.transform("fields", lambda v: F.coalesce(v, F.lit("")))).alias("fields"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_parsed(spark, d).filter("reason IS NOT NULL").select("line_id", "reason")


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    """A profile of each column of each load of corporate_reputation and mobi."""
    cells = None
    for table in ("corporate_reputation", "mobi"):
        one = profile.cell_counts(read_table(spark, d, table), table, "load_no")
        cells = one if cells is None else cells.unionByName(one)
    scales = read_table(spark, d, "model_indicators")
    return profile.profile_columns(cells, scales, read_table(spark, d, "profile_baseline"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """The standard aggregates of p4_profile, without the expressions."""
    p = p4_profile(spark, d)
    share = F.round("missing_share", 9).alias("missing_share")
    return p.select("tbl", "load_no", "fld", "n_rows", "n_missing", share, "distinct_values", "distinct_answers", "min_text", "max_text", "n_pattern", "n_off_scale", "n_valid", F.round("shift", 9).alias("shift"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    wanted = (F.col("tbl") == "corporate_reputation") & F.col("fld").isin("comp_1", "qual_1") | (F.col("tbl") == "mobi") & (F.col("fld") == "cusa1")
    return p4_profile(spark, d).filter(wanted).select("tbl", "fld", "load_no", F.explode("findings").alias("finding"))


QUERIES = {
    "p1_found": p1_found,
    "p1_cells": p1_cells,
    "p1_filled_satisfaction": p1_filled_satisfaction,
    "p1_filled_reputation": p1_filled_reputation,
    "p1_heldout": p1_heldout,
    "p2_found": p2_found,
    "p2_parsed": p2_parsed,
    "p2_loaded": p2_loaded,
    "p4_found": p4_found,
    "p4_profile": p4_profile,
    "p4_counts": p4_counts,
}
