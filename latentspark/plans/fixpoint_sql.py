"""DuckDB SQL of whole path models: the iteration as a recursive query, and the tables that follow.

Matrices are unrolled into columns of a single row: each step of the algebra is one more nested SELECT.
The SQL shares nothing with the kernel but the published formulas: sums are written out, linear systems
are solved by elimination, eigenvalues come from repeated squaring, t probabilities from Simpson's rule.
"""

from __future__ import annotations

from collections.abc import Sequence

SQUARINGS, SIMPSON = 16, 4000


def rounded(x: str) -> str:
    return f"round({x}, 6) + 0.0"


class Steps:
    """A SELECT that grows by nesting; ``let`` adds columns computed from all earlier ones."""

    def __init__(self, source: str):
        self.sql, self.made = source, 0

    def let(self, **columns: str) -> Steps:
        shown = ", ".join(f"({e}) AS {n}" for n, e in columns.items())
        self.sql = f"(SELECT *, {shown} FROM {self.sql})"
        return self

    def solve(self, a: Sequence[Sequence[str]], right: Sequence[Sequence[str]]) -> list[list[str]]:
        """Columns that solve a symmetric positive definite system for several right sides."""
        n, self.made = len(a), self.made + 1
        cell = {(i, j): a[i][j] for i in range(n) for j in range(n)} | {(i, n + k): right[k][i] for k in range(len(right)) for i in range(n)}
        width = n + len(right)
        for p in range(n):
            new = {}
            for i in range(p + 1, n):
                for j in range(p + 1, width):
                    new[f"g{self.made}_{p}_{i}_{j}"] = f"{cell[i, j]} - {cell[i, p]} * {cell[p, j]} / {cell[p, p]}"
            if new:
                self.let(**new)
                for name in new:
                    i, j = map(int, name.split("_")[2:])
                    cell[i, j] = name
        out = [[""] * n for _ in right]
        for i in reversed(range(n)):
            found = {}
            for k in range(len(right)):
                known = " ".join(f"- {cell[i, j]} * {out[k][j]}" for j in range(i + 1, n))
                out[k][i] = f"h{self.made}_{k}_{i}"
                found[out[k][i]] = f"({cell[i, n + k]} {known}) / {cell[i, i]}"
            self.let(**found)
        return out

    def top_eigen(self, matrices: Sequence[Sequence[Sequence[str]]]) -> list[tuple[str, list[list[str]]]]:
        """(largest eigenvalue, the projection on its vector) of each symmetric matrix."""
        self.made += 1
        now = list(matrices)
        for step in range(SQUARINGS):
            q = f"q{self.made}_{step}"
            sizes = [(b, len(a)) for b, a in enumerate(now)]
            self.let(**{f"{q}_{b}_{i}_{j}": " + ".join(f"{now[b][i][k]} * {now[b][k][j]}" for k in range(n)) for b, n in sizes for i in range(n) for j in range(i, n)})
            trace = {b: "(" + " + ".join(f"{q}_{b}_{i}_{i}" for i in range(n)) + ")" for b, n in sizes}
            self.let(**{f"{q}n_{b}_{i}_{j}": f"{q}_{b}_{i}_{j} / {trace[b]}" for b, n in sizes for i in range(n) for j in range(i, n)})
            now = [[[f"{q}n_{b}_{min(i, j)}_{max(i, j)}" for j in range(n)] for i in range(n)] for b, n in sizes]
        self.let(**{f"e{self.made}_{b}": " + ".join(f"{a[i][j]} * {now[b][i][j]}" for i in range(len(a)) for j in range(len(a))) for b, a in enumerate(matrices)})
        return [(f"e{self.made}_{b}", m) for b, m in enumerate(now)]


class Fixpoint:
    """blocks: {construct: indicators} in topological order; edges: (source, target)."""

    def __init__(self, rows: str, blocks: dict[str, list[str]], edges: Sequence[tuple[str, str]], scheme: str = "path", formative: bool = False, scaled: bool = True, tolerance: str = "1e-6", pre: str = "", table: str = "x", key: str = ""):
        """key: a column of ``table`` whose values each have a solution of their own."""
        self.key, self.keys = key, f"{key}, " if key else ""
        self.rows, self.blocks, self.edges, self.scheme, self.formative, self.scaled, self.tolerance, self.pre, self.table = rows, blocks, list(edges), scheme, formative, scaled, tolerance, pre, table
        self.lvs = list(blocks)
        self.mvs = [m for b in blocks.values() for m in b]
        self.of = {m: lv for lv, b in blocks.items() for m in b}
        self.before = {lv: [s for s in self.lvs if (s, lv) in self.edges] for lv in self.lvs}

    def s(self, a: str, b: str) -> str:
        i, j = sorted((self.mvs.index(a), self.mvs.index(b)))
        return f"s_{i}_{j}"

    def r(self, a: str, b: str, name: str = "r") -> str:
        i, j = sorted((self.lvs.index(a), self.lvs.index(b)))
        return "1.0" if i == j else f"{name}_{i}_{j}"

    def _products(self, steps: Steps) -> None:
        """t: indicators x constructs; c, d, r: of the constructs, from weights w."""
        mvs, lvs = self.mvs, self.lvs
        steps.let(**{f"t_{j}_{k}": " + ".join(f"{self.s(a, b)} * w_{mvs.index(b)}" for b in self.blocks[lv]) for j, a in enumerate(mvs) for k, lv in enumerate(lvs)})
        steps.let(**{f"c_{k}_{m}": " + ".join(f"w_{mvs.index(a)} * t_{mvs.index(a)}_{m}" for a in self.blocks[lv]) for k, lv in enumerate(lvs) for m in range(k, len(lvs))})
        steps.let(**{f"d_{k}": f"1 / sqrt(c_{k}_{k})" for k in range(len(lvs))})
        if len(lvs) > 1:
            steps.let(**{f"r_{k}_{m}": f"c_{k}_{m} * d_{k} * d_{m}" for k in range(len(lvs)) for m in range(k + 1, len(lvs))})

    def _inner(self, steps: Steps) -> dict[tuple[str, str], str]:
        """(from, to) -> weight of a construct in the inner estimate of another."""
        linked = self.edges + [(t, s) for s, t in self.edges]
        if self.scheme == "centroid":
            return {(a, b): f"sign({self.r(a, b)})" for a, b in linked}
        if self.scheme == "factorial":
            return {(a, b): f"{self.r(a, b)} / kappa" for a, b in linked}
        out = {}
        for lv in self.lvs:
            if self.scheme == "path":
                x = self.before[lv]
                if x:
                    beta = steps.solve([[self.r(a, b) for b in x] for a in x], [[self.r(a, lv) for a in x]])[0]
                    out |= {(a, lv): b for a, b in zip(x, beta)}
                out |= {(t, lv): self.r(t, lv) for s, t in self.edges if s == lv}
            else:  # newton: the coefficients of a construct's neighbours stand in its row
                x = [v for v in self.lvs if (v, lv) in linked]
                beta = steps.solve([[self.r(a, b) for b in x] for a in x], [[self.r(a, lv) for a in x]])[0]
                out |= {(lv, a): b for a, b in zip(x, beta)}
        return out

    def ctes(self, moments_only: bool = False) -> str:
        """CTEs up to ``c``, one row of moments, or ``z``, one row with every quantity of the solution."""
        mvs, lvs, pre = self.mvs, self.lvs, self.pre
        pairs = [(a, b) for i, a in enumerate(mvs) for b in mvs[i:]]
        fn = "corr" if self.scaled else "covar_samp"
        one = lambda a, b: "1.0" if a == b and self.scaled else f"{fn}({a}, {b})"
        moments = ", ".join(f"{one(a, b)} AS {self.s(a, b)}" for a, b in pairs)
        moments += ", " + ", ".join(f"avg({m}) AS mean_{j}, stddev_samp({m}) AS sd_{j}" for j, m in enumerate(mvs))
        given = f"{self.rows}, {pre}c AS (SELECT *, n / (n - 1) AS kappa FROM (SELECT {self.keys}CAST(count(*) AS DOUBLE) AS n, {moments} FROM {self.table}{f' GROUP BY {self.key}' if self.key else ''}))"
        if moments_only:
            return given
        start = ", ".join(f"sqrt(kappa) / sqrt({' + '.join(self.s(a, b) for a in self.blocks[self.of[m]] for b in self.blocks[self.of[m]])}) AS w_{j}" for j, m in enumerate(mvs))
        both = f"{pre}t JOIN {pre}c USING ({self.key})" if self.key else f"{pre}t, {pre}c"
        steps = Steps(f"(SELECT * FROM {both} WHERE NOT done AND i < 1000)")
        self._products(steps)
        inner = self._inner(steps)
        into = {lv: [(a, e) for (a, b), e in inner.items() if b == lv] for lv in lvs}
        steps.let(**{f"u_{j}": " + ".join(f"t_{j}_{lvs.index(a)} * d_{lvs.index(a)} * ({e})" for a, e in into[self.of[m]]) for j, m in enumerate(mvs)})
        if self.formative:
            new = {}
            for lv, b in self.blocks.items():
                beta = steps.solve([[self.s(x, y) for y in b] for x in b], [[f"u_{mvs.index(x)}" for x in b]])[0]
                new |= {f"v_{mvs.index(m)}": f"{e} / sqrt(kappa)" for m, e in zip(b, beta)}
        else:
            new = {f"v_{j}": f"u_{j} / (kappa * sqrt(kappa))" for j in range(len(mvs))}
        steps.let(**new)
        change = " + ".join(f"(abs(w_{j}) - abs(v_{j})) ** 2" for j in range(len(mvs)))
        iterate = f"SELECT i + 1, ({change}) < {self.tolerance}, {self.keys}{', '.join(f'v_{j}' for j in range(len(mvs)))} FROM {steps.sql}"
        final = Steps(f"(SELECT * FROM {both} WHERE done)")
        self._products(final)
        self._finish(final)
        w = ", ".join(f"w_{j}" for j in range(len(mvs)))
        return (
            f"{given}, {pre}t(i, done, {self.keys}{w}) AS (SELECT 0, FALSE, {self.keys}{w} FROM (SELECT {self.keys}{start} FROM {pre}c) UNION ALL {iterate}), {pre}z AS (SELECT * FROM {final.sql})"
        )

    def _regress(self, steps: Steps, r: str, beta: str) -> None:
        """{beta}_target_source, {beta}v: diagonal of the inverse, {beta}2: R2, {beta}a: adjusted R2."""
        for k, lv in enumerate(self.lvs):
            x = self.before[lv]
            if not x:
                continue
            units = [["1.0" if a == b else "0.0" for a in x] for b in x]
            found = steps.solve([[self.r(a, b, r) for b in x] for a in x], [[self.r(a, lv, r) for a in x], *units])
            at = [self.lvs.index(a) for a in x]
            steps.let(**{f"{beta}_{k}_{j}": e for j, e in zip(at, found[0])}, **{f"{beta}v_{k}_{j}": found[1 + i][i] for i, j in enumerate(at)})
            steps.let(**{f"{beta}2_{k}": " + ".join(f"{beta}_{k}_{j} * {self.r(self.lvs[j], lv, r)}" for j in at)})
            steps.let(**{f"{beta}a_{k}": f"1 - (1 - {beta}2_{k}) * (n - 1) / (n - {len(x) + 1})"})
        for k, lv in enumerate(self.lvs):  # totals in topological order
            for j, s in enumerate(self.lvs[:k]):
                terms = [f"{beta}_{k}_{j}"] if s in self.before[lv] else []
                terms += [f"{beta}_{k}_{m} * {beta}t_{m}_{j}" for m in range(j + 1, k) if self.lvs[m] in self.before[lv] and self.reaches(s, self.lvs[m])]
                if terms:
                    steps.let(**{f"{beta}t_{k}_{j}": " + ".join(terms)})

    def reaches(self, s: str, t: str) -> bool:
        return any(a == s and (b == t or self.reaches(b, t)) for a, b in self.edges)

    def _finish(self, z: Steps) -> None:
        mvs, lvs = self.mvs, self.lvs
        at = {m: (j, lvs.index(self.of[m])) for j, m in enumerate(mvs)}
        z.let(**{f"y_{j}": f"w_{j} * sqrt(kappa) * d_{k}" for j, k in at.values()})  # final weights
        z.let(**{f"x_{j}_{k}": f"t_{j}_{k} * d_{k} / sqrt({self.s(m, m)})" for j, m in enumerate(mvs) for k in range(len(lvs))})
        z.let(**{f"f_{k}": f"CASE WHEN {' + '.join(f'sign(x_{mvs.index(m)}_{k})' for m in self.blocks[lv])} < 0 THEN -1 ELSE 1 END" for k, lv in enumerate(lvs)})
        z.let(**{f"l_{j}": f"x_{j}_{k} * f_{k}" for j, k in at.values()})
        z.let(**{f"p_{i}_{k}": f"r_{i}_{k} * f_{i} * f_{k}" for i in range(len(lvs)) for k in range(i + 1, len(lvs))})
        self._regress(z, "p", "b")
        # consistent estimates
        many = {k: b for k, b in enumerate(self.blocks.values()) if len(b) > 1 and not self.formative}
        norm = {}
        for k, b in many.items():
            norm |= {f"o_{mvs.index(m)}": f"y_{mvs.index(m)} / sqrt({' + '.join(f'y_{mvs.index(a)} * y_{mvs.index(c)} * {self.s(a, c)}' for a in b for c in b)})" for m in b}
        if norm:
            z.let(**norm)
            ww = {k: " + ".join(f"o_{mvs.index(m)} * o_{mvs.index(m)}" for m in b) for k, b in many.items()}
            z.let(**{f"oo_{k}": e for k, e in ww.items()})
        rho = {}
        for k in range(len(lvs)):
            if k in many:
                b = [mvs.index(m) for m in many[k]]
                up = " + ".join(f"o_{i} * o_{j} * s_{min(i, j)}_{max(i, j)}" for i in b for j in b if i != j)
                low = " + ".join(f"o_{i} * o_{i} * o_{j} * o_{j}" for i in b for j in b if i != j)
                rho[f"rho_{k}"] = f"oo_{k} * oo_{k} * ({up}) / ({low})"
            else:
                rho[f"rho_{k}"] = "1.0"
        z.let(**rho)
        z.let(**{f"m_{j}": f"o_{j} * sqrt(rho_{k}) / oo_{k} * f_{k}" if k in many else f"l_{j}" for j, k in at.values()})
        z.let(**{f"h_{i}_{k}": f"p_{i}_{k} / sqrt(rho_{i} * rho_{k})" for i in range(len(lvs)) for k in range(i + 1, len(lvs))})
        self._regress(z, "h", "k")

    # tables
    def unnest(self, rows: Sequence[dict[str, str]], final: str, extra: str = "n") -> str:
        lists = ", ".join("{" + ", ".join(f"'{k}': {v}" for k, v in row.items()) + "}" for row in rows)
        return f"WITH RECURSIVE {self.ctes()}, g AS (SELECT {extra}, unnest([{lists}]) AS s FROM {self.pre}z) {final}"

    def outer_model(self) -> str:
        r2 = {k: f"b2_{k}" if self.before[lv] else "0.0" for k, lv in enumerate(self.lvs)}
        rows = [{"name": f"'{m}'", "block": f"'{self.of[m]}'", "w": f"y_{j}", "l": f"l_{j}", "r": r2[self.lvs.index(self.of[m])]} for j, m in enumerate(self.mvs)]
        return self.unnest(rows, f"SELECT s.name AS name, s.block AS block, {rounded('s.w')} AS weight, {rounded('s.l')} AS loading, {rounded('s.l * s.l')} AS communality, {rounded('s.l * s.l * s.r')} AS redundancy FROM g")

    def crossloadings(self) -> str:
        rows = [{"name": f"'{m}'", "block": f"'{self.of[m]}'", "lv": f"'{lv}'", "v": f"x_{j}_{k} * f_{k}"} for j, m in enumerate(self.mvs) for k, lv in enumerate(self.lvs)]
        return self.unnest(rows, f"SELECT s.name AS name, s.block AS block, s.lv AS lv, {rounded('s.v')} AS loading FROM g")

    def _edges(self, beta: str) -> list[dict[str, str]]:
        out = []
        for k, lv in enumerate(self.lvs):
            for a in self.before[lv]:
                j = self.lvs.index(a)
                out.append({"source": f"'{a}'", "target": f"'{lv}'", "b": f"{beta}_{k}_{j}", "v": f"{beta}v_{k}_{j}", "r2": f"{beta}2_{k}", "k": str(len(self.before[lv]))})
        return out

    def inner_model(self) -> str:
        step = f"least(abs(t), 40) / {SIMPSON}"
        area = f"SELECT source, target, any_value(b) AS b, any_value(se) AS se, any_value(t) AS t, 1 - 2 * any_value({step}) / 3 * sum((CASE WHEN i IN (0, {SIMPSON}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + (i * {step}) ** 2 / df, -(df + 1) / 2)) AS p FROM v, range(0, {SIMPSON + 1}) AS u(i) GROUP BY source, target"
        return self.unnest(
            self._edges("b"),
            f", v AS (SELECT source, target, b, se, b / se AS t, df FROM (SELECT s.source AS source, s.target AS target, s.b AS b, n - s.k - 1 AS df, sqrt((1 - s.r2) / (n - s.k - 1) * s.v) AS se FROM g)), "
            f"a2 AS ({area}) SELECT source, target, {rounded('b')} AS estimate, {rounded('se')} AS std_error, {rounded('t')} AS t, {rounded('greatest(p, 0.0)')} AS p_value FROM a2",
        )

    def paths(self, beta: str = "b", more: str = "") -> str:
        return self.unnest(self._edges(beta), f"SELECT {more}s.source AS source, s.target AS target, {rounded('s.b')} AS estimate FROM g")

    def path_coefficients(self) -> str:
        rows = [{"target": f"'{a}'", "source": f"'{b}'", "v": f"b_{i}_{j}" if b in self.before[a] else "0.0::DOUBLE"} for i, a in enumerate(self.lvs) for j, b in enumerate(self.lvs)]
        return self.unnest(rows, f"SELECT s.target AS target, s.source AS source, {rounded('s.v')} AS estimate FROM g")

    def effects(self, beta: str = "b") -> str:
        rows = []
        for k, t in enumerate(self.lvs):
            for j, s in enumerate(self.lvs):
                if self.reaches(s, t):
                    direct = f"{beta}_{k}_{j}" if s in self.before[t] else "0.0::DOUBLE"
                    more = any(self.reaches(s, m) for m in self.before[t])
                    rows.append({"source": f"'{s}'", "target": f"'{t}'", "d": direct, "i": f"{beta}t_{k}_{j} - {direct}" if more else "0.0::DOUBLE", "t": f"{beta}t_{k}_{j}"})
        return self.unnest(rows, f"SELECT s.source AS source, s.target AS target, {rounded('s.d')} AS direct, {rounded('s.i')} AS indirect, {rounded('s.t')} AS total FROM g")

    def specific_indirect(self, beta: str = "b") -> str:
        found: list[list[str]] = []

        def walk(chain: list[str]) -> None:
            for s, t in self.edges:
                if s == chain[-1]:
                    if len(chain) >= 2:
                        found.append([*chain, t])
                    walk([*chain, t])

        for lv in self.lvs:
            walk([lv])
        at = self.lvs.index
        rows = [{"source": f"'{c[0]}'", "target": f"'{c[-1]}'", "via": f"'{' -> '.join(c[1:-1])}'", "v": " * ".join(f"{beta}_{at(t)}_{at(s)}" for s, t in zip(c, c[1:]))} for c in found]
        return self.unnest(rows, f"SELECT s.source AS source, s.target AS target, s.via AS via, {rounded('s.v')} AS estimate FROM g")

    def _communality(self, lv: str) -> str:
        b = self.blocks[lv]
        return "(" + " + ".join(f"l_{self.mvs.index(m)} * l_{self.mvs.index(m)}" for m in b) + f") / {len(b)}"

    def inner_summary(self) -> str:
        rows = []
        for k, lv in enumerate(self.lvs):
            x = len(self.before[lv])
            rows.append({"lv": f"'{lv}'", "type": "'Endogenous'" if x else "'Exogenous'", "r": f"b2_{k}" if x else "0.0::DOUBLE", "a": f"ba_{k}" if x else "0.0::DOUBLE", "c": self._communality(lv), "k": str(x)})
        return self.unnest(
            rows,
            f"SELECT s.lv AS lv, s.type AS type, {rounded('s.r')} AS r_squared, {rounded('s.a')} AS r_squared_adj, {rounded('s.c')} AS block_communality, {rounded('s.c * s.r')} AS mean_redundancy, {rounded('s.c')} AS ave, "
            f"CASE WHEN s.k > 0 THEN {rounded('n * ln((1 - s.r) * (n - 1) / n) + (s.k + 1) * ln(n)')} END AS bic FROM g",
        )

    def f_squared(self) -> str:
        return self.unnest(
            self._edges("b"),
            ", v AS (SELECT s.source AS source, s.target AS target, s.r2 AS f, CASE WHEN s.k = 1 THEN 0.0 ELSE s.r2 - s.b * s.b / s.v END AS r FROM g), u AS (SELECT *, (f - r) / (1 - f) AS e FROM v) "
            f"SELECT source, target, {rounded('f')} AS r_squared_full, {rounded('r')} AS r_squared_reduced, {rounded('e')} AS f_squared, CASE WHEN e >= 0.35 THEN 'large' WHEN e >= 0.15 THEN 'medium' WHEN e >= 0.02 THEN 'small' ELSE 'none' END AS effect_size FROM u",
        )

    def vif_inner(self, beta: str = "b") -> str:
        rows = [e for e in self._edges(beta) if int(e["k"]) >= 2]
        return self.unnest(rows, f"SELECT s.target AS lv, s.source AS predictor, {rounded('s.v')} AS vif FROM g")

    def _on_moments(self, build) -> str:
        """A query whose rows need the correlations only."""
        steps = Steps(f"{self.pre}c")
        rows, final = build(steps)
        lists = ", ".join("{" + ", ".join(f"'{k}': {v}" for k, v in row.items()) + "}" for row in rows)
        return f"WITH {self.ctes(moments_only=True)}, g AS (SELECT n, unnest([{lists}]) AS s FROM {steps.sql}) {final}"

    def vif(self) -> str:
        def build(steps: Steps):
            rows = []
            for lv, b in self.blocks.items():
                if len(b) > 1:
                    inverse = steps.solve([[self.s(x, y) for y in b] for x in b], [["1.0" if x == y else "0.0" for x in b] for y in b])
                    rows += [{"lv": f"'{lv}'", "m": f"'{m}'", "v": inverse[i][i]} for i, m in enumerate(b)]
            return rows, f"SELECT s.lv AS lv, s.m AS indicator, {rounded('s.v')} AS vif FROM g"

        return self._on_moments(build)

    def reliability(self) -> str:
        def build(steps: Steps):
            blocks = list(self.blocks.values())
            matrices = [[[self.s(x, y) for y in b] for x in b] for b in blocks]
            first = steps.top_eigen(matrices)
            rest = [[[f"w{k}_{min(i, j)}_{max(i, j)}" for j in range(len(b))] for i in range(len(b))] for k, b in enumerate(blocks)]
            steps.let(**{rest[k][i][j]: f"{matrices[k][i][j]} - {first[k][0]} * {first[k][1][i][j]}" for k, b in enumerate(blocks) for i in range(len(b)) for j in range(i, len(b))})
            second = steps.top_eigen(rest)
            steps.let(**{f"sum_{k}": " + ".join(x for row in a for x in row) for k, a in enumerate(matrices)}, **{f"load_{k}": f"{e} * ({' + '.join(x for row in m for x in row)})" for k, (e, m) in enumerate(first)})
            rows = []
            for k, (lv, b) in enumerate(self.blocks.items()):
                p, e = len(b), first[k][0]
                rows.append({"lv": f"'{lv}'", "p": str(p), "a": f"greatest(0.0, {p} / ({p} - 1.0) * (sum_{k} - {p}) / sum_{k})", "r": f"load_{k} / (load_{k} + {p} - {e})", "e": e, "f": second[k][0]})
            return rows, f"SELECT s.lv AS lv, 'A' AS mode, CAST(s.p AS INTEGER) AS mvs, {rounded('s.a')} AS cronbach_alpha, {rounded('s.r')} AS dillon_goldstein_rho, {rounded('s.e')} AS eig_1st, {rounded('s.f')} AS eig_2nd FROM g"

        return self._on_moments(build)

    def fornell_larcker(self) -> str:
        rows = []
        for lv in self.lvs:
            most = [f"abs({self.r(lv, o, 'p')})" for o in self.lvs if o != lv]
            rows.append({"lv": f"'{lv}'", "c": self._communality(lv), "m": f"greatest({', '.join(most)})"})
        return self.unnest(rows, f"SELECT s.lv AS lv, {rounded('sqrt(s.c)')} AS sqrt_ave, {rounded('s.m')} AS max_abs_corr, sqrt(s.c) > s.m AS passes, '' AS note FROM g")

    def _residuals(self, loading: str, r: str) -> list[dict[str, str]]:
        return [
            {"a": f"'{a}'", "b": f"'{b}'", "v": f"{self.s(a, b)} / sqrt({self.s(a, a)} * {self.s(b, b)}) - {loading}_{i} * {loading}_{j} * {self.r(self.of[a], self.of[b], r)}"}
            for i, a in enumerate(self.mvs) for j, b in enumerate(self.mvs[:i]) if not (self.formative and self.of[a] == self.of[b])
        ]

    def residuals(self) -> str:
        return self.unnest(self._residuals("l", "p"), f"SELECT s.a AS mv_a, s.b AS mv_b, {rounded('s.v')} AS residual FROM g")

    def model_fit(self, consistent: bool = False) -> str:
        many = [lv for lv in self.lvs if len(self.blocks[lv]) > 1]
        ends = [k for k, lv in enumerate(self.lvs) if self.before[lv]]
        size = sum(len(self.blocks[lv]) for lv in many)
        gof = "NULL::DOUBLE"
        if many and ends:
            gof = f"sqrt(({' + '.join(f'({self._communality(lv)}) * {len(self.blocks[lv])}' for lv in many)}) / {size} * ({' + '.join(f'b2_{k}' for k in ends)}) / {len(ends)})"
        rows = self._residuals(*(("m", "h") if consistent else ("l", "p")))
        shown = "" if consistent else f", {rounded('any_value(gof)')} AS goodness_of_fit"
        return self.unnest(rows, f"SELECT {rounded('sqrt(avg(s.v * s.v))')} AS srmr, {rounded('sum(s.v * s.v)')} AS d_uls{shown} FROM g", f"n, {gof} AS gof")

    def fit_error(self) -> str:
        return self.unnest(self._residuals("l", "p"), f"SELECT {rounded('sqrt(avg(s.v * s.v))')} AS srmr, {rounded('sum(s.v * s.v)')} AS d_uls FROM g")

    def scores(self, key: str = "row_id", ids: bool = True) -> str:
        return f"WITH RECURSIVE {self.ctes()} SELECT {key}, {', '.join(f'{rounded(self.score(k))} AS {lv}' for k, lv in enumerate(self.lvs))} FROM {self.table}, {self.pre}z"

    def score(self, k: int) -> str:
        return " + ".join(f"({m} - mean_{self.mvs.index(m)}) * y_{self.mvs.index(m)} * f_{k}" + (f" / sd_{self.mvs.index(m)}" if self.scaled else "") for m in self.blocks[self.lvs[k]])

    def plsc_summary(self) -> str:
        rows = []
        for k, lv in enumerate(self.lvs):
            at, x = [self.mvs.index(m) for m in self.blocks[lv]], len(self.before[lv])
            square, plain = " + ".join(f"m_{j} * m_{j}" for j in at), " + ".join(f"m_{j}" for j in at)
            rows.append({"lv": f"'{lv}'", "rho": f"rho_{k}", "q": square, "p": plain, "size": str(len(at)), "r": f"k2_{k}" if x else "0.0::DOUBLE", "a": f"ka_{k}" if x else "0.0::DOUBLE", "k": str(x)})
        return self.unnest(
            rows,
            f"SELECT s.lv AS lv, {rounded('s.rho')} AS rho_a, {rounded('s.q / s.size')} AS ave, {rounded('s.p * s.p / (s.p * s.p + s.size - s.q)')} AS rho_c, {rounded('s.r')} AS r_squared, {rounded('s.a')} AS r_squared_adj, "
            f"CASE WHEN s.k > 0 THEN {rounded('n * ln((1 - s.r) * (n - 1) / n) + (s.k + 1) * ln(n)')} END AS bic FROM g",
        )

    def plsc_loadings(self) -> str:
        rows = [{"lv": f"'{self.of[m]}'", "m": f"'{m}'", "v": f"m_{j}"} for j, m in enumerate(self.mvs)]
        return self.unnest(rows, f"SELECT s.lv AS lv, s.m AS indicator, {rounded('s.v')} AS loading FROM g")

    def plsc_correlations(self) -> str:
        rows = [{"a": f"'{a}'", "b": f"'{b}'", "v": self.r(a, b, "h")} for a in self.lvs for b in self.lvs]
        return self.unnest(rows, f"SELECT s.a AS lv_a, s.b AS lv_b, {rounded('s.v')} AS correlation FROM g")

    def plsc_htmt(self) -> str:
        rows = [{"a": f"'{a}'", "b": f"'{b}'", "v": f"abs({self.r(a, b, 'h')})"} for i, a in enumerate(self.lvs) for b in self.lvs[i + 1 :]]
        return self.unnest(rows, f"SELECT s.a AS lv_a, s.b AS lv_b, {rounded('s.v')} AS htmt FROM g")
