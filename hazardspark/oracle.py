"""Builders of the DuckDB SQL that queries are held to. Nothing here calls the operators under test."""

from __future__ import annotations

P = 2147483647


def hash_sql(j: str, b: str, seed: int = 1) -> str:
    """The portable hash of BIGINT expressions."""
    h1 = f"((({j}) * 48271 + ({b}) * 69621 + {seed}) % {P})"
    h2 = f"(({h1} * {h1} % {P} + {h1} * 16807 + 12345) % {P})"
    return f"(({h2} * {h2} % {P} + {h2} * 48271 + ({b})) % {P})"


def solved_sql(relation: str, d: int, sides: list[str], keep: list[str]) -> str:
    """relation with each side's columns (s1 to sd) replaced by the solution of the symmetric system h11, h12, ..., by elimination."""
    cells = [(i, j) for i in range(1, d + 1) for j in range(i, d + 1)]
    for k in range(1, d):
        h = [f"h{i}{j}" if i <= k else f"h{i}{j} - h{k}{i} * h{k}{j} / h{k}{k} AS h{i}{j}" for i, j in cells]
        s = [f"{p}{i}" if i <= k else f"{p}{i} - h{k}{i} * {p}{k} / h{k}{k} AS {p}{i}" for p in sides for i in range(1, d + 1)]
        relation = f"(SELECT {', '.join([*keep, *h, *s])} FROM {relation} e{k})"
    for i in range(d, 0, -1):
        rest = lambda p: "".join(f" - h{i}{j} * {p}{j}" for j in range(i + 1, d + 1))  # noqa: B023, E731
        s = [f"({p}{i}{rest(p)}) / h{i}{i} AS {p}{i}" if n == i else f"{p}{n}" for p in sides for n in range(1, d + 1)]
        relation = f"(SELECT {', '.join([*keep, *[f'h{a}{b}' for a, b in cells], *s])} FROM {relation} f{i})"
    return relation


def eval_sql(d: int, ties: str, alpha: float, source: str, keys: tuple[str, ...] = (), offset: bool = False) -> str:
    """One row per row of source (columns keys, i, b1, b2, ...): loss f, gradient and Hessian over the compacted table g."""
    x = [f"x{j + 1}" for j in range(d)]
    lp = " + ".join([f"b{j + 1} * {v}" for j, v in enumerate(x)] + (["off"] if offset else []))
    pairs = [(a, b) for a in range(d) for b in range(a, d)]
    terms = {"0": "1", **{f"{j + 1}": v for j, v in enumerate(x)}, **{f"{a + 1}{b + 1}": f"{x[a]} * {x[b]}" for a, b in pairs}}
    s = ", ".join(f"sum(CASE WHEN event = {e} THEN n * exp({lp}) * {t} ELSE 0 END) AS {k}{m}" for e, k in ((0, "a"), (1, "d")) for m, t in terms.items())
    xs = ", ".join(f"sum(CASE WHEN event = 1 THEN n * {v} ELSE 0 END) AS l{j + 1}" for j, v in enumerate(x))
    by = ", ".join([*keys, "i", *[f"b{j + 1}" for j in range(d)]])
    c, times, join = ("k / w", "1", "k <= w") if ties == "efron" else ("1.0", "w", "k = 1")
    ss = ", ".join(f"a{m} + {c} * d{m} AS s{m}" for m in terms)
    g = ", ".join(f"sum({times} * s{j + 1} / s0 - CASE WHEN k = 1 THEN l{j + 1} ELSE 0 END) + 2 * {alpha} * b{j + 1} AS g{j + 1}" for j in range(d))
    h = ", ".join(f"sum({times} * (s{a + 1}{b + 1} / s0 - s{a + 1} * s{b + 1} / (s0 * s0))) + {2 * alpha if a == b else 0} AS h{a + 1}{b + 1}" for a, b in pairs)
    ridge = " + ".join(f"b{j + 1} * b{j + 1}" for j in range(d))
    both = f"{source} JOIN g USING ({', '.join(keys)})" if keys else f"{source}, g"
    return f"""SELECT {by}, sum({times} * ln(s0) - CASE WHEN k = 1 THEN l ELSE 0 END) + {alpha} * ({ridge}) AS f, {g}, {h}
        FROM (SELECT {by}, k, w, l, {", ".join(f"l{j + 1}" for j in range(d))}, {ss}
            FROM (SELECT {by}, stop, {s}, sum(CASE WHEN event = 1 THEN n ELSE 0 END) AS w, sum(CASE WHEN event = 1 THEN n * ({lp}) ELSE 0 END) AS l, {xs}
                FROM {both} GROUP BY {by}, stop) q, generate_series(1, (SELECT max(n_dead) FROM top)) AS ks(k) WHERE {join}) r
        GROUP BY {by}"""


def compact_sql(covariates: list[str], table: str = "panel", keys: tuple[str, ...] = (), weight: str = "1", offset: str | None = None) -> str:
    """Tables top (the most deaths at a time) and g (equal rows as one)."""
    xs = ", ".join([f"{c} AS x{j + 1}" for j, c in enumerate(covariates)] + ([f"{offset} AS off"] if offset else []))
    covariates = [*covariates, *([offset] if offset else [])]
    by = ", ".join([*keys, "stop"])
    return f"""top AS (SELECT CAST(max(c) AS BIGINT) AS n_dead FROM (SELECT sum({weight}) AS c FROM {table} WHERE event = 1 GROUP BY {by}) q),
    g AS MATERIALIZED (SELECT {by}, event, {xs}, CAST(sum({weight}) AS DOUBLE) AS n FROM {table} WHERE stop IN (SELECT stop FROM {table} WHERE event = 1) GROUP BY {by}, event, {", ".join(covariates)})"""


def newton_sql(covariates: list[str], ties: str = "efron", alpha: float = 0.0, rounds: int = 8, table: str = "panel", keys: tuple[str, ...] = (), weight: str = "1", offset: str | None = None) -> str:
    """Tables top, g and it: Newton steps from zero, numbered i, for each value of keys."""
    d = len(covariates)
    zero = ", ".join([*keys, *[f"CAST(0 AS DOUBLE) AS b{j + 1}" for j in range(d)]])
    start = f"(SELECT 0 AS i, {zero}" + (f" FROM (SELECT DISTINCT {', '.join(keys)} FROM g) k0)" if keys else ")") + " z"
    bs = [f"b{j + 1}" for j in range(d)]
    last = solved_sql(f"(SELECT * FROM it WHERE i < {rounds})", d, ["g"], ["i", *keys, *bs])
    step = f"(SELECT i + 1 AS i, {', '.join([*keys, *[f'b{j + 1} - g{j + 1} AS b{j + 1}' for j in range(d)]])} FROM {last} v) z"
    both = " UNION ALL ".join(eval_sql(d, ties, alpha, source, keys, offset is not None) for source in (start, step))
    return f"{compact_sql(covariates, table, keys, weight, offset)}, it AS ({both})"


def fits_sql(covariates: list[str], rounds: int = 8, keys: tuple[str, ...] = (), alpha: float = 0.0) -> str:
    """A query of keys, term, coef, se, loglik, loglik_init and score over it, unrounded."""
    d, bs = len(covariates), [f"b{j + 1}" for j in range(len(covariates))]
    ones = [f"CAST({int(i == j)} AS DOUBLE) AS u{j + 1}_{i + 1}" for j in range(d) for i in range(d)]
    last = solved_sql(f"(SELECT *, {', '.join(ones)} FROM it WHERE i = {rounds})", d, [f"u{j + 1}_" for j in range(d)], [*keys, *bs, "f"])
    first = solved_sql("(SELECT *, " + ", ".join(f"g{j + 1} AS y{j + 1}" for j in range(d)) + " FROM it WHERE i = 0)", d, ["y"], [*keys, "f", *[f"g{j + 1}" for j in range(d)]])
    score = " + ".join(f"z.g{j + 1} * z.y{j + 1}" for j in range(d))
    on = " AND ".join(f"l.{k} = z.{k}" for k in keys) or "TRUE"
    rows = " UNION ALL ".join(
        f"SELECT {''.join(f'l.{k}, ' for k in keys)}'{c}' AS term, l.b{j + 1} AS coef, sqrt(l.u{j + 1}_{j + 1}) AS se, -l.f AS loglik, -z.f AS loglik_init, {score} AS score FROM last_fit l JOIN first_fit z ON {on}"
        for j, c in enumerate(covariates)
    )
    return f"WITH last_fit AS MATERIALIZED (SELECT * FROM {last} a), first_fit AS MATERIALIZED (SELECT * FROM {first} b) {rows}"


def regression_sql(y: str, covariates: list[str], kind: str, rounds: int = 10, table: str = "panel") -> str:
    """Tables g and it as newton_sql's, of a logistic or Poisson regression on covariates (of which one may be the constant 1)."""
    d, x = len(covariates), [f"x{j + 1}" for j in range(len(covariates))]
    lp = " + ".join(f"b{j + 1} * {v}" for j, v in enumerate(x))
    mean, loss, var = {"logistic": (f"1 / (1 + exp(-({lp})))", f"ln(1 + exp({lp}))", "m * (1 - m)"), "poisson": (f"exp({lp})", f"exp({lp})", "m")}[kind]
    by = ", ".join(["i", *[f"b{j + 1}" for j in range(d)]])
    sums = ", ".join([f"sum(n * (l - y * ({lp}))) AS f", *[f"sum(n * (m - y) * {v}) AS g{j + 1}" for j, v in enumerate(x)], *[f"sum(n * {var} * {x[a]} * {x[b]}) AS h{a + 1}{b + 1}" for a in range(d) for b in range(a, d)]])
    value = lambda source: f"SELECT {by}, {sums} FROM (SELECT *, {mean} AS m, {loss} AS l FROM {source}, g) q GROUP BY {by}"
    bs = [f"b{j + 1}" for j in range(d)]
    last = solved_sql(f"(SELECT * FROM it WHERE i < {rounds})", d, ["g"], ["i", *bs])
    begin = f"(SELECT 0 AS i, {', '.join(f'CAST(0 AS DOUBLE) AS {b}' for b in bs)}) z"
    step = f"(SELECT i + 1 AS i, {', '.join(f'{b} - g{j + 1} AS {b}' for j, b in enumerate(bs))} FROM {last} v) z"
    cells = ", ".join(f"CAST({c} AS DOUBLE) AS {v}" for c, v in zip(covariates, x))
    return f"g AS MATERIALIZED (SELECT y, {', '.join(x)}, CAST(count(*) AS DOUBLE) AS n FROM (SELECT {y} AS y, {cells} FROM {table}) q GROUP BY ALL), it AS ({value(begin)} UNION ALL {value(step)})"


def atoms_sql(cutoff: int, nknots: int = 1, columns: tuple[int, ...] | None = None, order: int = 3) -> str:
    """Table atoms (lag, k, value): B-splines by the Cox-de Boor recursion at lag + 1; columns: the splines (from 0) that stay."""
    inner = " UNION ALL ".join(f"SELECT {order + j}, CAST(round_even((SELECT quantile_cont(v, {j}.0 / {nknots + 1}) FROM generate_series(1, {cutoff}) q(v)), 0) AS DOUBLE)" for j in range(1, nknots + 1))
    parts = [f"kn(i, t) AS (SELECT v, CAST(v - {order} AS DOUBLE) FROM generate_series(0, {order}) a(v) UNION ALL {inner} UNION ALL SELECT v + {order + nknots + 1}, CAST({cutoff} + v AS DOUBLE) FROM generate_series(0, {order}) c(v))"]
    parts.append(f"s0 AS (SELECT lag, a.i, CASE WHEN a.t <= lag + 1 AND lag + 1 < b.t THEN 1.0::DOUBLE ELSE 0 END AS v FROM generate_series(0, {cutoff - 1}) l(lag), kn a JOIN kn b ON b.i = a.i + 1)")
    for k in range(1, order + 1):
        parts.append(f"""s{k} AS (SELECT x.lag, x.i, coalesce((x.lag + 1 - p.t) / nullif(q.t - p.t, 0), 0) * x.v + coalesce((r.t - x.lag - 1) / nullif(r.t - o.t, 0), 0) * y.v AS v
            FROM s{k - 1} x JOIN s{k - 1} y ON y.lag = x.lag AND y.i = x.i + 1 JOIN kn p ON p.i = x.i JOIN kn q ON q.i = x.i + {k} JOIN kn o ON o.i = x.i + 1 JOIN kn r ON r.i = x.i + {k + 1})""")
    kept = f" WHERE i IN ({', '.join(map(str, columns))})" if columns else ""
    parts.append(f"atoms AS (SELECT CAST(lag AS INTEGER) AS lag, CAST(dense_rank() OVER (ORDER BY i) AS INTEGER) AS k, v AS value FROM s{order}{kept})")
    return ", ".join(parts)


def features_sql(count: int, cutoff: int, table: str = "panel", keys: tuple[str, ...] = (), out: str = "feat") -> str:
    """Table feat (keys, id, stop, D1, ...) from atoms."""
    d = ", ".join(f"coalesce(sum(s.dose * a.value) FILTER (a.k = {k + 1}), 0.0) AS D{k + 1}" for k in range(count))
    by = ", ".join(f"p.{c}" for c in [*keys, "id", "stop"])
    on = "".join(f" AND s.{k} = p.{k}" for k in keys)
    return f"""{out} AS MATERIALIZED (SELECT {by}, {d} FROM {table} p LEFT JOIN (SELECT * FROM {table} WHERE dose <> 0) s ON s.id = p.id{on} AND s.stop BETWEEN p.stop - {cutoff - 1} AND p.stop
        LEFT JOIN atoms a ON a.lag = p.stop - s.stop GROUP BY {by})"""


def drawn_sql(count: str, replicates: int) -> str:
    """Table weights (b, i, w): how often replicate b draws index i of count."""
    return f"""draws AS (SELECT b, CASE WHEN b = 0 THEN j ELSE {hash_sql('j', 'b')} % ({count}) END AS i FROM generate_series(0, {replicates - 1}) bs(b), (SELECT unnest(range(({count})::BIGINT)) AS j) js),
    weights AS (SELECT b, i, count(*) AS w FROM draws GROUP BY b, i)"""


def permuted_sql(ids: str, count: int) -> str:
    """Table perm (p, id, other) of the subjects of a table."""
    return f"""pf AS (SELECT row_number() OVER (ORDER BY id) - 1 AS j, id FROM {ids}),
    pk AS (SELECT b AS p, j, id, row_number() OVER (PARTITION BY b ORDER BY CASE WHEN b = 0 THEN j ELSE {hash_sql('j', 'b')} END, j) - 1 AS r FROM pf, generate_series(0, {count}) bs(b)),
    perm AS (SELECT l.p, l.id, o.id AS other FROM pk l JOIN pk o ON l.p = o.p AND l.j = o.r)"""


def normal_two_sided_sql(z: str, table: str, columns: str) -> str:
    """columns and p of a table: 2 - 2 Phi(abs(z)), by Simpson's rule over 2000 steps."""
    return f"""SELECT {columns}, 1 - abs({z}) / 3000 / sqrt(2 * pi()) * sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-power({z} * k / 2000, 2) / 2)) AS p
        FROM {table}, generate_series(0, 2000) ks(k) GROUP BY {columns}"""
