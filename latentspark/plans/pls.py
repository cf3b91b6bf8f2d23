"""Queries of the path-model operators over the survey tables.

The model of the satisfaction table has the six constructs of its indicators; answers off the scale are
missing. Results that are compared with SQL are rounded to DIGITS places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark import diagnostics, extend, groups, predict, resample
from latentspark.functions import answers
from latentspark.model import FittedModel, complete_rows, fit
from latentspark.kernel.results import SCHEMAS
from latentspark.moments import moments
from latentspark.nonmetric import fit_with_gaps
from latentspark.segment import Fimix
from latentspark.sources import read_table, sentinel_to_null
from latentspark.spec import Indicator, Mode, PathModel, Paths, Scale, Scheme
from latentspark.streaming import fit_windows, windowed_moments

DIGITS = 6
# Constructs of the satisfaction table, their number of indicators, and their paths.
SIZES = {"IMAG": 5, "EXPE": 5, "QUAL": 5, "VAL": 4, "SAT": 4, "LOY": 4}
EDGES = (
    ("IMAG", "EXPE"), ("IMAG", "SAT"), ("IMAG", "LOY"), ("EXPE", "QUAL"), ("EXPE", "VAL"),
    ("EXPE", "SAT"), ("QUAL", "VAL"), ("QUAL", "SAT"), ("VAL", "SAT"), ("SAT", "LOY"),
)
INDICATORS = [f"{lv.lower()}{i}" for lv, n in SIZES.items() for i in range(1, n + 1)]
TIGHT = 1e-20  # for fits that SQL iterates to convergence


def r(x) -> F.Column:
    """Rounded, without negative zero."""
    return F.round(x, DIGITS) + F.lit(0.0)


def satisfaction(spark: SparkSession, d: str) -> DataFrame:
    """Ids, gender and the 27 indicators as doubles, NULL where there is no answer."""
    t = read_table(spark, d, "satisfaction")
    scaled = [F.expr(f"cast(case when {c} between 0 and 10 then {c} end as double) as {c}") for c in INDICATORS]
    return t.select("row_id", "panel_id", "study_no", "wave", "survey_ts", answers.gender(F.col("gender")).alias("gender"), *scaled)


def model(mode: Mode = Mode.A, scaled: bool = True, scale: Scale | None = None) -> PathModel:
    m = PathModel.of(Paths(EDGES), scaled, scale)
    for lv, n in SIZES.items():
        m = m.with_block(lv, mode, *[f"{lv.lower()}{i}" for i in range(1, n + 1)])
    return m


def single_items() -> PathModel:
    """IMAG -> SAT -> LOY and IMAG -> LOY with one indicator each."""
    m = PathModel.of(Paths([("IMAG", "SAT"), ("IMAG", "LOY"), ("SAT", "LOY")]))
    return m.with_block("IMAG", Mode.A, "imag1").with_block("SAT", Mode.A, "sat1").with_block("LOY", Mode.A, "loy1")


def two_constructs(mode: Mode = Mode.A) -> PathModel:
    m = PathModel.of(Paths([("SAT", "LOY")]))
    return m.with_block("SAT", mode, *[f"sat{i}" for i in range(1, 5)]).with_block("LOY", Mode.A, *[f"loy{i}" for i in range(1, 5)])


def fitted(spark: SparkSession, d: str, m: PathModel | None = None, scheme: Scheme = Scheme.PATH, tolerance: float = 1e-6, missing: str = "casewise") -> FittedModel:
    return fit(satisfaction(spark, d), m or model(), scheme, tolerance, 1000, missing, ["row_id"])


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded; what is not defined (NaN) as NULL."""
    return df.select(*[F.when(~F.isnan(c), r(F.col(c))).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def table(name: str, m: Callable[[], PathModel] = model, **options) -> Callable[[SparkSession, str], DataFrame]:
    """A query that gives one table of a fit."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(getattr(fitted(spark, d, m(), **options), name)())

    run.__name__ = name
    return run


# ingest and treatment
def sentinel_counts(spark: SparkSession, d: str) -> DataFrame:
    """Missing cells per column of corporate_reputation once -99 reads as NULL."""
    t = sentinel_to_null(read_table(spark, d, "corporate_reputation"))
    names = [c for c in t.columns if c.split("_")[0] in ("comp", "like", "cusl", "cusa", "qual")]
    one = t.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in names])
    return one.unpivot([], names, "fld", "n_missing")


def casewise_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows a casewise fit keeps, gaps filled with the means of these rows."""
    rows = complete_rows(satisfaction(spark, d), model(), "casewise", ["row_id"])
    return rows.select("row_id", *[r(F.col(c)).alias(c) for c in INDICATORS if c[:3] in ("sat", "loy")])


def mean_replaced_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = complete_rows(satisfaction(spark, d), model(), "mean", ["row_id"])
    return rows.select("row_id", *[r(F.col(c)).alias(c) for c in INDICATORS if c[:3] in ("sat", "loy")])


def listwise_count(spark: SparkSession, d: str) -> DataFrame:
    return complete_rows(satisfaction(spark, d), model(), "listwise", ["row_id"]).agg(F.count(F.lit(1)).alias("n"))


def _pairs(spark: SparkSession, d: str, what: str) -> DataFrame:
    m = moments(complete_rows(satisfaction(spark, d), model(), "casewise"), INDICATORS)
    x = m.cov if what == "cov" else m.corr
    rows = [(a, b, float(x[i, j])) for i, a in enumerate(INDICATORS) for j, b in enumerate(INDICATORS) if j <= i]
    return rounded(spark.createDataFrame(rows, f"mv_a string, mv_b string, {what} double"))


def covariances(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, "cov")


def correlations(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, "corr")


def group_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows of groups named by values and by ranges."""
    s = satisfaction(spark, d)
    found = [groups.Group("women", values=("female",)), groups.Group("men", values=("male",))]
    waves = [groups.Group("early", high=3), groups.Group("middle", low=4, high=6), groups.Group("late", low=7)]
    counts = [F.count(F.when(g.predicate(F.col("gender")), 1)).alias(g.name) for g in found]
    counts += [F.count(F.when(g.predicate(F.col("wave")), 1)).alias(g.name) for g in waves]
    return s.agg(*counts).unpivot([], [g.name for g in found + waves], "grp", "n")


def ranks_of_scores(spark: SparkSession, d: str) -> DataFrame:
    """Average ranks of the sat scores of satisfaction_scores."""
    return diagnostics.average_ranks(read_table(spark, d, "satisfaction_scores"), "sat").select("value", "n", "below", "rank")


# single items and two constructs: closed forms and fixpoints that SQL can check
def single_scores(spark: SparkSession, d: str) -> DataFrame:
    f = fitted(spark, d, single_items())
    return rounded(f.scores(["row_id"]).select("row_id", *[F.col(c).alias(c.lower()) for c in ("IMAG", "SAT", "LOY")]))


def single_fit_error(spark: SparkSession, d: str) -> DataFrame:
    """Goodness of fit is undefined for single indicators; the other indices are not."""
    return rounded(fitted(spark, d, single_items()).model_fit().select("srmr", "d_uls"))


def single_specific_indirect(spark: SparkSession, d: str) -> DataFrame:
    x = fitted(spark, d, single_items()).specific_indirect_effects()
    return rounded(x.select("source", "target", F.concat_ws(" -> ", "via").alias("via"), "estimate"))


def single_groups(spark: SparkSession, d: str) -> DataFrame:
    who = [groups.Group("women", values=("female",)), groups.Group("men", values=("male",))]
    return rounded(groups.group_estimates(satisfaction(spark, d), single_items(), "gender", who))


def single_ipma(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diagnostics.ipma(fitted(spark, d, single_items()), "LOY", (0.0, 10.0))[0])


def observed_tetrads(spark: SparkSession, d: str) -> DataFrame:
    x = diagnostics.cta(fitted(spark, d, two_constructs()), "row_id", 50)[0]
    return rounded(x.select("lv", "indicators", "tetrad"))


# whole models
def scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fitted(spark, d).scores(["row_id"]))


def plsc_loadings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fitted(spark, d).plsc_loadings())


def scheme_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths under each of the five inner schemes, from one aggregation; one row without paths, and the
    reason as status, for a scheme that does not converge."""
    from latentspark.kernel.weights import NoConvergence
    from latentspark.model import estimate, prepare

    m = model()
    p = prepare(satisfaction(spark, d), m)
    rows = []
    for scheme in Scheme:
        try:
            rows += [(scheme.value, *x[:3], "ok") for x in estimate(m, p.extended, scheme, 1e-7, 1000).tables.inner_model()]
        except NoConvergence as e:
            rows.append((scheme.value, None, None, None, str(e)))
    return rounded(spark.createDataFrame(rows, "scheme string, source string, target string, estimate double, status string"))


def nonmetric_model() -> PathModel:
    """SAT with ordinal and numeric indicators, the study as a nominal one."""
    m = PathModel.of(Paths([("SAT", "LOY"), ("STUDY", "LOY")]), default_scale=Scale.NUM)
    m = m.with_block("SAT", Mode.A, Indicator("sat1", Scale.ORD), Indicator("sat2", Scale.ORD), "sat3", "sat4")
    return m.with_block("LOY", Mode.A, "loy1", "loy2", "loy3", "loy4").with_block("STUDY", Mode.A, Indicator("study_no", Scale.NOM))


def nonmetric_outer_model(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fit(satisfaction(spark, d), nonmetric_model(), Scheme.CENTROID, 1e-7, 1000, "listwise").outer_model())


def gaps_outer_model(spark: SparkSession, d: str) -> DataFrame:
    """The whole model on numeric scales with gaps left as gaps."""
    t = fit_with_gaps(satisfaction(spark, d), model(scale=Scale.NUM), Scheme.PATH)
    return rounded(spark.createDataFrame(t.outer_model(), SCHEMAS["outer_model"]))


def embedded_higher_order(spark: SparkSession, d: str) -> DataFrame:
    """VALUE with the parts QUAL and VAL inside one model."""
    m = PathModel.of(Paths([("EXPE", "VALUE"), ("VALUE", "SAT")])).with_higher_order("VALUE", Mode.A, ["QUAL", "VAL"])
    for lv in ("EXPE", "QUAL", "VAL", "SAT"):
        m = m.with_block(lv, Mode.A, *[f"{lv.lower()}{i}" for i in range(1, SIZES[lv] + 1)])
    return rounded(fit(satisfaction(spark, d), m, Scheme.PATH).outer_model())


def disjoint_higher_order(spark: SparkSession, d: str) -> DataFrame:
    made = extend.higher_order(fitted(spark, d), "VALUE", ["QUAL", "VAL"], Mode.A, Paths([("EXPE", "VALUE"), ("VALUE", "SAT")]))
    return rounded(made.summary())


def moderation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(extend.moderate(satisfaction(spark, d), model(), "IMAG", "SAT", "LOY", Scheme.PATH).interaction_effect())


def bootstrap_summary(spark: SparkSession, d: str) -> DataFrame:
    return resample.summary(resample.bootstrap(fitted(spark, d), "row_id"), flip=True)


def inference_loadings(spark: SparkSession, d: str) -> DataFrame:
    return resample.inference(resample.bootstrap(fitted(spark, d), "row_id"))["outerLoadings"]


def plsc_specific_indirect(spark: SparkSession, d: str) -> DataFrame:
    x = fitted(spark, d).plsc_specific_indirect_effects()
    return rounded(x.select("source", "target", F.concat_ws(" -> ", "via").alias("via"), "estimate"))


def specific_indirect(spark: SparkSession, d: str) -> DataFrame:
    x = fitted(spark, d).specific_indirect_effects()
    return rounded(x.select("source", "target", F.concat_ws(" -> ", "via").alias("via"), "estimate"))


def group_paths(spark: SparkSession, d: str) -> DataFrame:
    """The paths of the whole model in each group."""
    who = [groups.Group("women", values=("female",)), groups.Group("men", values=("male",))]
    return rounded(groups.group_estimates(satisfaction(spark, d), model(), "gender", who, Scheme.PATH))


def micom_composition(spark: SparkSession, d: str) -> DataFrame:
    """Step 2 of measurement invariance: agreement of the composites' weights."""
    who = [groups.Group("women", values=("female",)), groups.Group("men", values=("male",))]
    return groups.micom(satisfaction(spark, d), model(), "gender", who, "row_id", Scheme.PATH).step2


def micom_levels(spark: SparkSession, d: str) -> DataFrame:
    """Step 3 of measurement invariance: means and variances of the composites."""
    who = [groups.Group("women", values=("female",)), groups.Group("men", values=("male",))]
    return groups.micom(satisfaction(spark, d), model(), "gender", who, "row_id", Scheme.PATH).step3


def report_reliability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diagnostics.report(fitted(spark, d))["reliability"])


def report_paths(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diagnostics.report(fitted(spark, d))["paths"])


def htmt_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fitted(spark, d).htmt_matrix())


def predict_summary(spark: SparkSession, d: str) -> DataFrame:
    """Which of both predictions errs less, per indicator."""
    return predict.predict(fitted(spark, d), "row_id")[1]


def predict_earliest(spark: SparkSession, d: str) -> DataFrame:
    """Errors beside a linear benchmark of the exogenous constructs' indicators."""
    return rounded(predict.predict(fitted(spark, d), "row_id", lm="earliest_antecedents")[0])


def permutation_mga(spark: SparkSession, d: str) -> DataFrame:
    who = [groups.Group("women", values=("female",)), groups.Group("men", values=("male",))]
    return groups.permutation_mga(satisfaction(spark, d), model(), "gender", who, "row_id", Scheme.PATH)


def bootstrap_mga(spark: SparkSession, d: str) -> DataFrame:
    who = [groups.Group("women", values=("female",)), groups.Group("men", values=("male",))]
    return groups.bootstrap_mga(satisfaction(spark, d), model(), "gender", who, "row_id", Scheme.PATH)


def micom(spark: SparkSession, d: str) -> DataFrame:
    who = [groups.Group("women", values=("female",)), groups.Group("men", values=("male",))]
    return groups.micom(satisfaction(spark, d), model(), "gender", who, "row_id", Scheme.PATH).summary


def predict_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(predict.predict(fitted(spark, d), "row_id")[0])


def q_squared(spark: SparkSession, d: str) -> DataFrame:
    return rounded(predict.q_squared(fitted(spark, d), "row_id"))


def tetrad_tests(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.cta(fitted(spark, d), "row_id")[0]


def copula(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.copula(fitted(spark, d), "row_id", "SAT", ["IMAG", "EXPE"])[0]


def ipma_indicators(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diagnostics.ipma(fitted(spark, d), "LOY", (0.0, 10.0))[1])


def fimix_memberships(spark: SparkSession, d: str) -> DataFrame:
    return Fimix(fitted(spark, d), "row_id", 2).memberships()


def fimix_criteria(spark: SparkSession, d: str) -> DataFrame:
    return Fimix(fitted(spark, d), "row_id", 2).fit_criteria()


def windowed_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of the single-item model per half year of survey time."""
    s = satisfaction(spark, d)
    m = single_items()
    w = windowed_moments(s, "survey_ts", [i.name for i in m.indicators], "182 days")
    return rounded(fit_windows(w, m))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        sentinel_counts, casewise_rows, mean_replaced_rows, listwise_count, covariances, correlations, group_sizes, ranks_of_scores,
        single_scores, single_fit_error, single_specific_indirect, single_groups, single_ipma, observed_tetrads,
        scores, plsc_loadings, scheme_paths, nonmetric_outer_model, gaps_outer_model, embedded_higher_order, disjoint_higher_order, moderation,
        group_paths, micom_composition, micom_levels, report_reliability, report_paths, htmt_matrix, predict_summary, predict_earliest, bootstrap_summary, inference_loadings, specific_indirect, plsc_specific_indirect, permutation_mga, bootstrap_mga, micom, predict_metrics, q_squared, tetrad_tests, copula, ipma_indicators,
        fimix_memberships, fimix_criteria, windowed_paths,
    )
}
for _name in (
    "outer_model", "crossloadings", "inner_model", "path_coefficients", "effects", "inner_summary", "reliability", "htmt", "htmt2",
    "fornell_larcker", "f_squared", "vif", "vif_inner", "model_fit", "residuals", "plsc_summary", "plsc_paths", "plsc_correlations", "plsc_effects", "plsc_vif_inner", "plsc_htmt",
    "plsc_model_fit",
):
    QUERIES[_name] = table(_name)
for _name in ("inner_model", "path_coefficients", "effects", "inner_summary", "f_squared", "vif_inner"):
    QUERIES[f"single_{_name}"] = table(_name, single_items)
QUERIES["mode_b_outer_model"] = table("outer_model", lambda: model(Mode.B))
for _scheme in (Scheme.CENTROID, Scheme.FACTORIAL, Scheme.NEWTON):
    QUERIES[f"{_scheme.value}_inner_model"] = table("inner_model", scheme=_scheme)
QUERIES["unscaled_outer_model"] = table("outer_model", lambda: model(scaled=False))
for _name in ("outer_model", "inner_model", "inner_summary", "reliability", "fornell_larcker", "residuals"):
    QUERIES[f"two_{_name}"] = table(_name, two_constructs, tolerance=TIGHT)
