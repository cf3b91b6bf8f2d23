"""DuckDB SQL for path-model queries: closed forms, and fixpoints by recursive queries."""

from __future__ import annotations

from latentspark.plans.fixpoint_sql import Fixpoint
from latentspark.plans.pls import EDGES, INDICATORS, SIZES

_GENDER = (
    "CASE WHEN lower(trim(gender, ' ' || chr(9) || chr(13) || chr(10) || chr(160))) IN ('female', 'f') THEN 'female' "
    "WHEN lower(trim(gender, ' ' || chr(9) || chr(13) || chr(10) || chr(160))) IN ('male', 'm') THEN 'male' "
    "WHEN lower(trim(gender, ' ' || chr(9) || chr(13) || chr(10) || chr(160))) IN ('diverse', 'd') THEN 'diverse' END AS gender"
)
_READ = "SELECT row_id, study_no, wave, survey_ts, " + _GENDER + ", " + ", ".join(f"CASE WHEN {c} BETWEEN 0 AND 10 THEN CAST({c} AS DOUBLE) END AS {c}" for c in INDICATORS) + " FROM satisfaction"


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _block(lv: str) -> list[str]:
    return [f"{lv.lower()}{i}" for i in range(1, SIZES[lv] + 1)]


def _rows(blocks: list[list[str]], casewise: bool = True, where: str = "TRUE") -> str:
    """CTEs a (read), k (kept), m (means), x (without gaps)."""
    names = [n for b in blocks for n in b]
    keep = " AND ".join(f"coalesce({', '.join(b)}) IS NOT NULL" for b in blocks) if casewise else "TRUE"
    means = ", ".join(f"avg({n}) AS {n}" for n in names)
    filled = ", ".join(f"coalesce(k.{n}, m.{n}) AS {n}" for n in names)
    return f"a AS ({_READ}), k AS (SELECT * FROM a WHERE {keep} AND {where}), m AS (SELECT {means} FROM k), x AS (SELECT k.row_id, k.gender, k.survey_ts, {filled} FROM k, m)"


_ALL = [_block(lv) for lv in SIZES]
_PAIRS = [(a, b) for i, a in enumerate(INDICATORS) for b in INDICATORS[: i + 1]]


def _pairs(fn: str, column: str, pairs=_PAIRS) -> str:
    one = ", ".join(f"{fn}({a}, {b}) AS p{i}" for i, (a, b) in enumerate(pairs))
    lists = ", ".join(f"{{'mv_a': '{a}', 'mv_b': '{b}', 'v': p{i}}}" for i, (a, b) in enumerate(pairs))
    return f"q AS (SELECT {one} FROM x), u AS (SELECT unnest([{lists}]) AS s FROM q), {column} AS (SELECT s.mv_a AS mv_a, s.mv_b AS mv_b, s.v AS v FROM u)"


_SENTINELS = [f"{p}_{i}" for p, n in (("comp", 3), ("like", 3), ("cusl", 3)) for i in range(1, n + 1)] + ["cusa", *[f"qual_{i}" for i in range(1, 9)], "qual_global"]
_SAT_LOY = _block("SAT") + _block("LOY")
_SHOWN = ", ".join(f"{_r(c)} AS {c}" for c in _SAT_LOY)

# correlations of imag1 (i), sat1 (s), loy1 (l), and what follows from them
_SINGLE = _rows([["imag1"], ["sat1"], ["loy1"]])
_THREE = """c AS ({select} FROM x {group}), b AS (SELECT *, a AS b_is, (l_i - a * s_l) / (1 - a * a) AS b_il, (s_l - a * l_i) / (1 - a * a) AS b_sl FROM c),
 e AS (SELECT *, a * a AS r2_s, b_il * l_i + b_sl * s_l AS r2_l FROM b)"""
_CORR = "SELECT count(*) AS n, corr(imag1, sat1) AS a, corr(imag1, loy1) AS l_i, corr(sat1, loy1) AS s_l"
_C3 = "WITH " + _SINGLE + ", " + _THREE.format(select=_CORR, group="")


def _ratio(column: str, mean) -> str:
    """Averages of absolute correlations between and within blocks."""
    of = ", ".join(f"('{n}', '{lv}', {k})" for k, lv in enumerate(SIZES) for n in _block(lv))
    return (
        f"WITH {_rows(_ALL)}, {_pairs('corr', 'r')}, o(mv, lv, k) AS (VALUES {of}), "
        f"z AS (SELECT least(a.k, b.k) AS ka, greatest(a.k, b.k) AS kb, {mean('abs(v)')} AS v FROM r JOIN o a ON a.mv = mv_a JOIN o b ON b.mv = mv_b WHERE mv_a <> mv_b GROUP BY ALL), "
        "n AS (SELECT DISTINCT k, lv FROM o) "
        f"SELECT na.lv AS lv_a, nb.lv AS lv_b, {_r('z.v / sqrt(wa.v * wb.v)')} AS {column} FROM z "
        "JOIN z wa ON wa.ka = z.ka AND wa.kb = z.ka JOIN z wb ON wb.ka = z.kb AND wb.kb = z.kb "
        "JOIN n na ON na.k = z.ka JOIN n nb ON nb.k = z.kb WHERE z.ka < z.kb"
    )


def _two(final: str) -> str:
    """Mode A weights of SAT and LOY: the power iteration on their cross-correlations, 200 steps."""
    s, o = _block("SAT"), _block("LOY")
    names = s + o
    pairs = [(a, b) for a in names for b in names]
    corr = ", ".join(f"corr({a}, {b}) AS r_{a}_{b}" for a, b in pairs)
    step_o = [" + ".join(f"w_{a} * r_{a}_{b}" for a in s) for b in o]
    lo = ", ".join(f"({e}) AS v_{b}" for b, e in zip(o, step_o))
    step_s = [" + ".join(f"v_{b} * r_{a}_{b}" for b in o) for a in s]
    so = ", ".join(f"({e}) AS u_{a}" for a, e in zip(s, step_s))
    norm_u = "sqrt(" + " + ".join(f"u_{a} * u_{a}" for a in s) + ")"
    start = ", ".join(f"1.0::DOUBLE AS w_{a}" for a in s)
    r_cols = ", ".join(f"r_{a}_{b}" for a, b in pairs)
    nxt = ", ".join(f"u_{a} / {norm_u} AS w_{a}" for a in s)
    w_all = ", ".join(f"w_{a}" for a in s)
    var_s = " + ".join(f"w_{a} * w_{b} * r_{a}_{b}" for a in s for b in s)
    var_o = " + ".join(f"v_{a} * v_{b} * r_{a}_{b}" for a in o for b in o)
    between = " + ".join(f"w_{a} * v_{b} * r_{a}_{b}" for a in s for b in o)
    load_s = [f"({' + '.join(f'w_{b} * r_{a}_{b}' for b in s)})" for a in s]
    load_o = [f"({' + '.join(f'v_{b} * r_{a}_{b}' for b in o)})" for a in o]
    # the sign of a construct: flipped where most of its loadings are negative
    sum_s, sum_o = " + ".join(f"sign{x}" for x in load_s), " + ".join(f"sign{x}" for x in load_o)
    items = [f"{{'name': '{a}', 'block': 'SAT', 'w': w_{a} / sqrt(vs), 'l': fs * {x} / sqrt(vs)}}" for a, x in zip(s, load_s)]
    items += [f"{{'name': '{a}', 'block': 'LOY', 'w': v_{a} / sqrt(vo), 'l': fo * {x} / sqrt(vo)}}" for a, x in zip(o, load_o)]
    return (
        f"WITH RECURSIVE {_rows([s, o])}, c AS (SELECT count(*) AS n, {corr} FROM x), "
        f"t AS (SELECT 0 AS i, {start}, n, {r_cols} FROM c UNION ALL SELECT i + 1, {nxt}, n, {r_cols} FROM "
        f"(SELECT *, {so} FROM (SELECT *, {lo} FROM t WHERE i < 200))), "
        f"f AS (SELECT *, {lo} FROM t WHERE i = 200), "
        f"g AS (SELECT *, {var_s} AS vs, {var_o} AS vo, {between} AS b, CASE WHEN {sum_s} < 0 THEN -1 ELSE 1 END AS fs, CASE WHEN {sum_o} < 0 THEN -1 ELSE 1 END AS fo FROM f), "
        f"h AS (SELECT n, fs * fo * b / sqrt(vs * vo) AS path, unnest([{', '.join(items)}]) AS s FROM g) {final}"
    )


# the inner weight between two constructs is the sign of their correlation; weights keep the sign of
# the equal start, so SAT starts with ones and LOY follows by the correlation's sign
_TWO_OUTER = _two(
    f"SELECT s.name AS name, s.block AS block, {_r('sqrt(n / (n - 1)) * s.w * CASE WHEN s.block = $$LOY$$ AND path < 0 THEN -1 ELSE 1 END')} AS weight, {_r('s.l')} AS loading, "
    f"{_r('s.l * s.l')} AS communality, {_r('s.l * s.l * CASE WHEN s.block = $$LOY$$ THEN path * path ELSE 0 END')} AS redundancy FROM h"
)
_LADDER = (
    "[{'lv': 'IMAG', 'type': 'Exogenous', 'r2': 0.0, 'k': 0}, {'lv': 'SAT', 'type': 'Endogenous', 'r2': r2_s, 'k': 1}, {'lv': 'LOY', 'type': 'Endogenous', 'r2': r2_l, 'k': 2}]"
)

SQL = {
    "sentinel_counts": " UNION ALL ".join(f"SELECT '{c}' AS fld, count(*) FILTER ({c} IS NULL OR {c} = -99) AS n_missing FROM corporate_reputation" for c in _SENTINELS),
    "casewise_rows": f"WITH {_rows(_ALL)} SELECT row_id, {_SHOWN} FROM x",
    "mean_replaced_rows": f"WITH {_rows(_ALL, False)} SELECT row_id, {_SHOWN} FROM x",
    "listwise_count": f"WITH a AS ({_READ}) SELECT count(*) AS n FROM a WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in INDICATORS),
    "covariances": f"WITH {_rows(_ALL)}, {_pairs('covar_samp', 'r')} SELECT mv_a, mv_b, {_r('v')} AS cov FROM r",
    "correlations": f"WITH {_rows(_ALL)}, {_pairs('corr', 'r')} SELECT mv_a, mv_b, {_r('v')} AS corr FROM r",
    "group_sizes": f"WITH a AS ({_READ}) SELECT 'women' AS grp, count(*) AS n FROM a WHERE gender = 'female' UNION ALL SELECT 'men', count(*) FROM a WHERE gender = 'male' "
    "UNION ALL SELECT 'early', count(*) FROM a WHERE wave <= 3 UNION ALL SELECT 'middle', count(*) FROM a WHERE wave BETWEEN 4 AND 6 UNION ALL SELECT 'late', count(*) FROM a WHERE wave >= 7",
    "ranks_of_scores": "WITH v AS (SELECT sat AS value, count(*) AS n FROM satisfaction_scores WHERE sat IS NOT NULL AND NOT isnan(sat) GROUP BY 1), "
    "b AS (SELECT value, n, CAST(coalesce(sum(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below FROM v) "
    "SELECT value, n, below, below + (n + 1) / 2 AS rank FROM b",
    "htmt": _ratio("htmt", lambda x: f"avg({x})"),
    "htmt2": _ratio("htmt2", lambda x: f"exp(avg(ln({x})))"),
    "observed_tetrads": "WITH " + _rows([_block("SAT"), _block("LOY")]) + " " + " UNION ALL ".join(
        f"SELECT '{lv}' AS lv, '{','.join(b)}' AS indicators, {_r(f'covar_samp({b[0]}, {b[1]}) * covar_samp({b[2]}, {b[3]}) - covar_samp({b[0]}, {b[2]}) * covar_samp({b[1]}, {b[3]})')} AS tetrad FROM x"
        for lv, b in (("SAT", _block("SAT")), ("LOY", _block("LOY")))
    ),
    "single_scores": f"WITH {_SINGLE} SELECT row_id, " + ", ".join(f"{_r(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()')} AS {n}" for c, n in (("imag1", "imag"), ("sat1", "sat"), ("loy1", "loy"))) + " FROM x",
    "single_path_coefficients": _C3 + ", p AS (SELECT unnest([" + ", ".join(
        f"{{'target': '{t}', 'source': '{s}', 'v': {dict([(('SAT', 'IMAG'), 'b_is'), (('LOY', 'IMAG'), 'b_il'), (('LOY', 'SAT'), 'b_sl')]).get((t, s), '0.0::DOUBLE')}}}"
        for t in ("IMAG", "SAT", "LOY") for s in ("IMAG", "SAT", "LOY")
    ) + f"]) AS s FROM e) SELECT s.target AS target, s.source AS source, {_r('s.v')} AS estimate FROM p",
    "single_effects": _C3 + f", p AS (SELECT unnest([{{'source': 'IMAG', 'target': 'SAT', 'd': b_is, 'i': 0.0::DOUBLE}}, {{'source': 'IMAG', 'target': 'LOY', 'd': b_il, 'i': b_is * b_sl}}, {{'source': 'SAT', 'target': 'LOY', 'd': b_sl, 'i': 0.0::DOUBLE}}]) AS s FROM e) "
    f"SELECT s.source AS source, s.target AS target, {_r('s.d')} AS direct, {_r('s.i')} AS indirect, {_r('s.d + s.i')} AS total FROM p",
    "single_specific_indirect": _C3 + f" SELECT 'IMAG' AS source, 'LOY' AS target, 'SAT' AS via, {_r('b_is * b_sl')} AS estimate FROM e",
    "single_inner_summary": _C3 + f", p AS (SELECT n, unnest({_LADDER}) AS s FROM e) SELECT s.lv AS lv, s.type AS type, {_r('s.r2')} AS r_squared, "
    f"CASE WHEN s.k = 0 THEN 0.0 ELSE {_r('1 - (1 - s.r2) * (n - 1) / (n - s.k - 1)')} END AS r_squared_adj, 1.0::DOUBLE AS block_communality, {_r('s.r2')} AS mean_redundancy, 1.0::DOUBLE AS ave, "
    f"CASE WHEN s.k = 0 THEN NULL ELSE {_r('n * ln((1 - s.r2) * (n - 1) / n) + (s.k + 1) * ln(n)')} END AS bic FROM p",
    "single_f_squared": _C3 + f", p AS (SELECT unnest([{{'source': 'IMAG', 'target': 'SAT', 'f': r2_s, 'r': 0.0::DOUBLE}}, {{'source': 'IMAG', 'target': 'LOY', 'f': r2_l, 'r': s_l * s_l}}, {{'source': 'SAT', 'target': 'LOY', 'f': r2_l, 'r': l_i * l_i}}]) AS s FROM e), "
    "z AS (SELECT s.source AS source, s.target AS target, s.f AS f, s.r AS r, (s.f - s.r) / (1 - s.f) AS v FROM p) "
    f"SELECT source, target, {_r('f')} AS r_squared_full, {_r('r')} AS r_squared_reduced, {_r('v')} AS f_squared, CASE WHEN v >= 0.35 THEN 'large' WHEN v >= 0.15 THEN 'medium' WHEN v >= 0.02 THEN 'small' ELSE 'none' END AS effect_size FROM z",
    "single_vif_inner": _C3 + f" SELECT 'LOY' AS lv, unnest(['IMAG', 'SAT']) AS predictor, {_r('1 / (1 - a * a)')} AS vif FROM e",
    "single_groups": f"WITH a AS ({_READ}), x AS (SELECT CASE gender WHEN 'female' THEN 'women' ELSE 'men' END AS grp, imag1, sat1, loy1 FROM a WHERE gender IN ('female', 'male') AND imag1 IS NOT NULL AND sat1 IS NOT NULL AND loy1 IS NOT NULL), "
    + _THREE.format(select=_CORR.replace("SELECT ", "SELECT grp, "), group="GROUP BY grp")
    + f", p AS (SELECT grp, n, unnest([{{'source': 'IMAG', 'target': 'SAT', 'v': b_is}}, {{'source': 'IMAG', 'target': 'LOY', 'v': b_il}}, {{'source': 'SAT', 'target': 'LOY', 'v': b_sl}}]) AS s FROM e) SELECT grp, n, s.source AS source, s.target AS target, {_r('s.v')} AS estimate FROM p",
    "single_ipma": _C3 + f", y AS (SELECT avg(imag1) * 10 AS pi, avg(sat1) * 10 AS ps FROM x), p AS (SELECT unnest([{{'lv': 'IMAG', 'i': b_il + b_is * b_sl, 'p': pi}}, {{'lv': 'SAT', 'i': b_sl, 'p': ps}}]) AS s FROM e, y) SELECT s.lv AS lv, {_r('s.i')} AS importance, {_r('s.p')} AS performance FROM p",
    "windowed_paths": f"WITH a AS ({_READ}), x AS (SELECT time_bucket(INTERVAL 182 DAYS, survey_ts, TIMESTAMP '1970-01-01') AS window_start, imag1, sat1, loy1 FROM a WHERE survey_ts IS NOT NULL AND imag1 IS NOT NULL AND sat1 IS NOT NULL AND loy1 IS NOT NULL), "
    + _THREE.format(select=_CORR.replace("SELECT ", "SELECT window_start, "), group="GROUP BY window_start")
    + f", p AS (SELECT window_start, n, unnest([{{'source': 'IMAG', 'target': 'SAT', 'v': b_is}}, {{'source': 'IMAG', 'target': 'LOY', 'v': b_il}}, {{'source': 'SAT', 'target': 'LOY', 'v': b_sl}}]) AS s FROM e) SELECT window_start, window_start + INTERVAL 182 DAYS AS window_end, n, s.source AS source, s.target AS target, CASE WHEN n >= 10 THEN {_r('s.v')} END AS estimate, CASE WHEN n >= 10 THEN 'ok' ELSE 'too few rows' END AS status FROM p",
    "two_outer_model": _TWO_OUTER,
    "two_inner_summary": _two(
        f", p AS (SELECT s.block AS lv, any_value(path) AS path, any_value(n) AS n, avg(s.l * s.l) AS c FROM h GROUP BY 1) SELECT lv, CASE lv WHEN 'LOY' THEN 'Endogenous' ELSE 'Exogenous' END AS type, "
        f"CASE lv WHEN 'LOY' THEN {_r('path * path')} ELSE 0.0 END AS r_squared, CASE lv WHEN 'LOY' THEN {_r('1 - (1 - path * path) * (n - 1) / (n - 2)')} ELSE 0.0 END AS r_squared_adj, {_r('c')} AS block_communality, "
        f"CASE lv WHEN 'LOY' THEN {_r('c * path * path')} ELSE 0.0 END AS mean_redundancy, {_r('c')} AS ave, CASE lv WHEN 'LOY' THEN {_r('n * ln((1 - path * path) * (n - 1) / n) + 2 * ln(n)')} ELSE NULL END AS bic FROM p"
    ),
    "two_fornell_larcker": _two(
        f", p AS (SELECT s.block AS lv, any_value(abs(path)) AS path, avg(s.l * s.l) AS c FROM h GROUP BY 1) SELECT lv, {_r('sqrt(c)')} AS sqrt_ave, {_r('path')} AS max_abs_corr, sqrt(c) > path AS passes, '' AS note FROM p"
    ),
}

_BLOCKS = {lv: _block(lv) for lv in SIZES}
_WHOLE = Fixpoint(_rows(_ALL), _BLOCKS, EDGES)
_SINGLE_MODEL = Fixpoint(_SINGLE, {"IMAG": ["imag1"], "SAT": ["sat1"], "LOY": ["loy1"]}, [("IMAG", "SAT"), ("IMAG", "LOY"), ("SAT", "LOY")])
_TWO_MODEL = Fixpoint(_rows([_block("SAT"), _block("LOY")]), {lv: _block(lv) for lv in ("SAT", "LOY")}, [("SAT", "LOY")], tolerance="1e-20")
SQL |= {
    "outer_model": _WHOLE.outer_model(),
    "crossloadings": _WHOLE.crossloadings(),
    "inner_model": _WHOLE.inner_model(),
    "path_coefficients": _WHOLE.path_coefficients(),
    "effects": _WHOLE.effects(),
    "inner_summary": _WHOLE.inner_summary(),
    "reliability": _WHOLE.reliability(),
    "fornell_larcker": _WHOLE.fornell_larcker(),
    "f_squared": _WHOLE.f_squared(),
    "vif": _WHOLE.vif(),
    "vif_inner": _WHOLE.vif_inner(),
    "model_fit": _WHOLE.model_fit(),
    "residuals": _WHOLE.residuals(),
    "specific_indirect": _WHOLE.specific_indirect(),
    "scores": _WHOLE.scores(),
    "plsc_summary": _WHOLE.plsc_summary(),
    "plsc_paths": _WHOLE.paths("k"),
    "plsc_loadings": _WHOLE.plsc_loadings(),
    "plsc_correlations": _WHOLE.plsc_correlations(),
    "plsc_effects": _WHOLE.effects("k"),
    "plsc_specific_indirect": _WHOLE.specific_indirect("k"),
    "plsc_vif_inner": _WHOLE.vif_inner("k"),
    "plsc_htmt": _WHOLE.plsc_htmt(),
    "plsc_model_fit": _WHOLE.model_fit(consistent=True),
    "mode_b_outer_model": Fixpoint(_rows(_ALL), _BLOCKS, EDGES, formative=True).outer_model(),
    "unscaled_outer_model": Fixpoint(_rows(_ALL), _BLOCKS, EDGES, scaled=False).outer_model(),
    "centroid_inner_model": Fixpoint(_rows(_ALL), _BLOCKS, EDGES, "centroid").inner_model(),
    "factorial_inner_model": Fixpoint(_rows(_ALL), _BLOCKS, EDGES, "factorial").inner_model(),
    "newton_inner_model": Fixpoint(_rows(_ALL), _BLOCKS, EDGES, "newton").inner_model(),
    "single_inner_model": _SINGLE_MODEL.inner_model(),
    "single_fit_error": _SINGLE_MODEL.fit_error(),
    "two_inner_model": _TWO_MODEL.inner_model(),
    "two_reliability": _TWO_MODEL.reliability(),
    "two_residuals": _TWO_MODEL.residuals(),
}

# second stages on the scores of a first one
_BASE = Fixpoint(_rows(_ALL), _BLOCKS, EDGES, pre="b")
_LV = list(SIZES).index
_PRODUCT = Fixpoint(
    f"{_BASE.ctes()}, x2 AS (SELECT x.*, ({_BASE.score(_LV('IMAG'))}) * ({_BASE.score(_LV('SAT'))}) AS product FROM x, bz)",
    {"IMAG_x_SAT": ["product"]} | _BLOCKS, [*EDGES, ("IMAG_x_SAT", "LOY")], table="x2",
)
_DISJOINT = Fixpoint(
    f"{_BASE.ctes()}, x2 AS (SELECT x.*, {_BASE.score(_LV('QUAL'))} AS of_qual, {_BASE.score(_LV('VAL'))} AS of_val FROM x, bz)",
    {"EXPE": _block("EXPE"), "VALUE": ["of_qual", "of_val"], "SAT": _block("SAT")}, [("EXPE", "VALUE"), ("VALUE", "SAT")], table="x2",
)
_PARTS = {lv: _block(lv) for lv in ("EXPE", "QUAL", "VAL", "SAT")}
_FIRST = Fixpoint(_rows(list(_PARTS.values())), _PARTS, [("EXPE", "QUAL"), ("EXPE", "VAL"), ("QUAL", "SAT"), ("VAL", "SAT")], pre="b")
_EMBEDDED = Fixpoint(
    f"{_FIRST.ctes()}, x2 AS (SELECT x.*, {_FIRST.score(1)} AS QUAL, {_FIRST.score(2)} AS VAL FROM x, bz)",
    {"EXPE": _block("EXPE"), "VALUE": ["QUAL", "VAL"], "SAT": _block("SAT")}, [("EXPE", "VALUE"), ("VALUE", "SAT")], table="x2",
)
SQL |= {
    "moderation": f"SELECT * FROM ({_PRODUCT.inner_model()}) WHERE source = 'IMAG_x_SAT' AND target = 'LOY'",
    "disjoint_higher_order": _DISJOINT.unnest(
        [{"p": f"'{p}'", "w": f"y_{5 + i}", "l": f"l_{5 + i}", "r": f"(SELECT b2_{_LV(p)} FROM bz)"} for i, p in enumerate(("QUAL", "VAL"))],
        f"SELECT s.p AS first_order, {_r('s.w')} AS weight, {_r('s.l')} AS loading, {_r('s.r')} AS stage1_r_squared FROM g",
    ),
    "embedded_higher_order": _EMBEDDED.outer_model(),
}

_RATED = []
for _lv, _b in _BLOCKS.items():
    for _m in _b:
        _j = INDICATORS.index(_m)
        _effect = f"bt_{_LV('LOY')}_{_LV(_lv)}" if _lv != "LOY" else "NULL::DOUBLE"
        _RATED.append({"lv": f"'{_lv}'", "m": f"'{_m}'", "w": f"y_{_j}", "n": f"y_{_j} / ({' + '.join(f'y_{INDICATORS.index(x)}' for x in _b)})", "e": _effect, "p": f"mean_{_j} * 10"})
SQL["ipma_indicators"] = _WHOLE.unnest(
    _RATED,
    f"SELECT s.lv AS lv, s.m AS indicator, {_r('s.w')} AS outer_weight, {_r('s.n')} AS normalized_weight, {_r('s.w * s.e')} AS indicator_importance, "
    f"CASE WHEN s.e <> 0 THEN {_r('s.w')} END AS henseler_normalized_weight, {_r('s.p')} AS performance, 0.0::DOUBLE AS scale_min, 10.0::DOUBLE AS scale_max FROM g",
)
SQL["group_paths"] = " UNION ALL ".join(
    f"SELECT '{g}' AS grp, * FROM ({Fixpoint(_rows(_ALL, where=f'gender = {v!r}'), _BLOCKS, EDGES).paths(more='CAST(n AS BIGINT) AS n, ')})" for g, v in (("women", "female"), ("men", "male"))
)
SQL["report_reliability"] = f"SELECT a.lv, mode, mvs, cronbach_alpha, dillon_goldstein_rho AS rho_c, rho_a, c.ave FROM ({SQL['reliability']}) a JOIN ({SQL['plsc_summary']}) b USING (lv) JOIN ({SQL['inner_summary']}) c USING (lv)"
SQL["report_paths"] = f"SELECT a.*, f_squared, effect_size FROM ({SQL['inner_model']}) a JOIN ({SQL['f_squared']}) b USING (source, target)"
SQL["htmt_matrix"] = "SELECT lv, " + ", ".join(f"max(v) FILTER (o = '{x}') AS {x}" for x in SIZES) + (
    f" FROM (SELECT lv_b AS lv, lv_a AS o, htmt AS v FROM ({SQL['htmt']}) UNION ALL SELECT unnest([{', '.join(repr(x) for x in SIZES)}]), '', NULL) GROUP BY lv"
)

# blindfolding: a model for every endogenous construct and every seventh of the rows, all in one recursion
_ENDS = [lv for lv in SIZES if any(t == lv for _, t in EDGES)]
_OF = {m: lv for lv in SIZES for m in _block(lv)}
_BLIND = Fixpoint(
    f"{_rows(_ALL)}, r AS (SELECT d, {', '.join(f'avg({m}) FILTER (row_id % 7 <> d) AS rest_{m}, stddev_pop({m}) FILTER (row_id % 7 <> d) AS dev_{m}' for m in INDICATORS)} FROM x, range(7) AS u(d) GROUP BY d), "
    "xx AS (" + " UNION ALL ".join(
        f"SELECT '{lv}:' || d AS fold, " + ", ".join(f"CASE WHEN row_id % 7 = d THEN rest_{m} ELSE {m} END AS {m}" if _OF[m] == lv else m for m in INDICATORS) + " FROM x, r" for lv in _ENDS
    ) + ")",
    _BLOCKS, EDGES, table="xx", key="fold",
)


def _blind(lv: str) -> str:
    k = _LV(lv)
    said = " + ".join(f"b_{k}_{_LV(s)} * ({_BLIND.score(_LV(s))})" for s, t in EDGES if t == lv)
    off = " + ".join(f"({m} - rest_{m} - l_{INDICATORS.index(m)} * dev_{m} * said) ** 2" for m in _block(lv))
    about = " + ".join(f"({m} - rest_{m}) ** 2" for m in _block(lv))
    return f"SELECT '{lv}' AS lv, {_r(f'1 - sum({off}) / sum({about})')} AS q_squared, 0 AS skipped FROM (SELECT *, {said} AS said FROM x JOIN r ON r.d = row_id % 7 JOIN z ON z.fold = '{lv}:' || r.d)"


SQL["q_squared"] = f"WITH RECURSIVE {_BLIND.ctes()} " + " UNION ALL ".join(_blind(lv) for lv in _ENDS)
