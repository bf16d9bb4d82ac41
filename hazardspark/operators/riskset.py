"""Risk-set sums and partial likelihoods as DataFrame aggregations.

aligned: the risk set of a death time is the rows that stop there (right for panels cut at death times).
interval: all rows with start < t <= stop. Death times are the leaves of a binary tree; an interval counts in the few nodes that make it up, and a
time sums the nodes above it, so no row is joined to its times and nothing is ever taken away from a sum.

Risks exp(lp) are summed by bands of lp, a band a range of 32 of it, and bands are put together at the greatest one of a time. So sums of any lp are exact to rounding,
without a shift known beforehand: scaled_sums gives them with the logarithm of their scale.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardspark.operators import ordered
from hazardspark.sources.scratch import written

#: Width of a band of linear predictors, within which exponentials are summed at one scale.
BAND = 32.0
#: Covariates beyond which predictors and second moments are matrix products in batches of rows, and not columns.
WIDE = 16
#: Tied deaths that a row stands for; times of more are several rows, in several tasks.
TIES = 4096
#: Tied deaths that a task sums at a time.
PIECE = 1 << 18


def compact(df: DataFrame, covariates: Sequence[str], stop: str = "stop", event: str = "event", start: str | None = None, weight: str | None = None, by: Sequence[str] = (), offset: str | None = None) -> DataFrame:
    """Equal rows as one with their weight in ``n``; aligned data lose the rows that no death time reads."""
    keys = [*by, *([start] if start else []), stop, event, *covariates, *([offset] if offset else [])]
    w = F.sum(weight) if weight else F.count("*")
    out = df.groupBy(*keys).agg(w.cast("double").alias("n"))
    if start:
        return out
    deaths = df.where(F.col(event) == 1).select(*by, stop).distinct()
    return out.join(deaths, [*by, stop], "left_semi")


def predictor(covariates: Sequence[str], beta: Sequence[float | Column], centre: Sequence[float] | None = None) -> Column:
    """Sum of beta * (x - centre); beta are numbers or columns."""
    out = F.lit(0.0)
    for i, (c, b) in enumerate(zip(covariates, beta)):
        out = out + (b if isinstance(b, Column) else F.lit(float(b))) * (F.col(c) - F.lit(float(centre[i] if centre else 0.0)))
    return out


def log_sum_exp(df: DataFrame, by: Sequence[str], value: str, out: str = "lse") -> DataFrame:
    """log of the sum of exponentials of each group, shifted by the group's maximum."""
    top = df.groupBy(*by).agg(F.max(value).alias("__m"))
    return df.join(top, list(by)).groupBy(*by, "__m").agg((F.log(F.sum(F.exp(F.col(value) - F.col("__m")))) + F.col("__m")).alias(out)).drop("__m")


def moments(d: int, order: int = 2) -> list[tuple[int, ...]]:
    """Names of the sums: (), (i,), (i, j)."""
    return [m for k in range(order + 1) for m in combinations_with_replacement(range(d), k)]


def _name(kind: str, m: tuple[int, ...]) -> str:
    return "_".join([kind, *map(str, m)])


@dataclass(frozen=True)
class Cover:
    """Interval risk sets as nodes of a binary tree over death times, made once for any number of coefficients.

    alive: by, level, node, covariates, n; dead: by, no, covariates, n; times: t and its number no; levels of the tree.
    """

    alive: DataFrame
    dead: DataFrame
    times: DataFrame
    levels: int

    def persist(self) -> Cover:
        return Cover(self.alive.persist(), self.dead.persist(), self.times.persist(), self.levels)

    def unpersist(self) -> None:
        for df in (self.alive, self.dead, self.times):
            df.unpersist()


def cover(rows: DataFrame, covariates: Sequence[str], stop: str, event: str, start: str, by: Sequence[str] = (), offset: str | None = None) -> Cover:
    """Compacted rows (with n) as nodes. A row that fails is alive up to its last time but one, and dead at its last; rows that cover no death time go."""
    kept = [*covariates, *([offset] if offset else [])]
    times = ordered.dense_ranks(rows.where(F.col(event) == 1).select(F.col(stop).alias("t")), "t", "no")
    numbered = ordered.up_to(rows, times.withColumn("__no", F.lit(1).cast("long")), "t", ["__no"], [start, stop])
    first, last, dead = F.col(f"__no_{start}"), F.col(f"__no_{stop}"), F.col(event) == 1
    total = F.sum("n").alias("n")
    levels = max(1, int(times.count()).bit_length())
    # read for those alive and for the dead, again for every sum that is not of a persisted cover
    ranges = numbered.select(*by, first.alias("first"), (last - dead.cast("long")).alias("last"), dead.alias("dead"), *kept, "n").where("first < last OR dead").groupBy(*by, "first", "last", "dead", *kept).agg(total)
    ranges = written(ranges)
    # at level k a range [l, r) of nodes of 2**k times gives away its odd ends
    def nodes(k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        low, high = F.call_function("shiftright", F.col("first") + width - 1, k), F.call_function("shiftright", F.col("last"), k)
        node = lambda odd, at: F.when((low < high) & (odd % 2 == 1), F.struct(k.alias("level"), at.alias("node")))
        return F.array(node(low, low), node(high, high - 1))

    ends = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), nodes)), lambda x: x.isNotNull())
    alive = ranges.where("first < last").select(*by, F.inline(ends), *kept, "n").groupBy(*by, "level", "node", *kept).agg(total)
    died = ranges.where("dead").select(*by, F.col("last").alias("no"), *kept, "n").groupBy(*by, "no", *kept).agg(total)
    return Cover(alive, died, times.select("t", "no"), levels)


def _multiplied(rows: DataFrame, covariates: Sequence[str], beta: Sequence[float], offset: str | None) -> DataFrame:
    """rows with the linear predictor __lp by matrix products: an expression of many terms, copied into each sum, would be too large a plan."""
    names, values = list(covariates), np.asarray(beta, dtype=float)

    def run(batches):
        for pdf in batches:
            yield pdf.assign(__lp=pdf[names].to_numpy(dtype=float) @ values + (pdf[offset].to_numpy(dtype=float) if offset else 0.0))

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("__lp", T.DoubleType())]))


def _banded(rows: DataFrame, covariates: Sequence[str], beta: Sequence[float | Column], offset: str | None) -> DataFrame:
    """rows with the linear predictor __lp, its band and __r, the risk at the band's scale."""
    if len(covariates) > WIDE and not any(isinstance(b, Column) for b in beta):
        rows = _multiplied(rows, covariates, beta, offset)
    else:
        rows = rows.withColumn("__lp", predictor(covariates, beta) + (F.col(offset) if offset else F.lit(0.0)))
    rows = rows.withColumn("__band", F.floor(F.col("__lp") / BAND))
    return rows.withColumn("__r", F.col("n") * F.exp(F.col("__lp") - F.col("__band") * BAND))


def _one_scale(bands: DataFrame, keys: Sequence[str], scaled: Sequence[str], plain: Sequence[str]) -> DataFrame:
    """Sums of the bands of each key at the scale of its greatest one, whose logarithm is top."""
    rows = bands.withColumn("__top", F.max("__band").over(Window.partitionBy(*keys)))
    factor = F.exp((F.col("__band") - F.col("__top")) * BAND)
    return rows.groupBy(*keys).agg(*[F.sum(F.col(c) * factor).alias(c) for c in scaled], *[F.sum(c).alias(c) for c in plain], (F.max("__top") * BAND).alias("top"))


def scaled_sums(rows: DataFrame | Cover, covariates: Sequence[str], beta: Sequence[float | Column], stop: str = "stop", event: str = "event", start: str | None = None, by: Sequence[str] = (), offset: str | None = None, order: int = 2) -> DataFrame:
    """Per death time: a_* (survivors) and d_* (dead) sums of n exp(lp - top) times 1, x_i, x_i x_j (up to the order); top; deaths; lp; x_i of the dead.

    rows: compacted rows, or with start their cover(), whose rows may have more columns (as beta) beside by.
    """
    names = moments(len(covariates), order)

    def term(m: tuple[int, ...]) -> Column:
        out = F.col("__r")
        for i in m:
            out = out * F.col(covariates[i])
        return out

    none = F.lit(0.0)
    of_alive, of_dead, plain = ([_name("a", m) for m in names], [_name("d", m) for m in names], ["deaths", "lp", *[f"x_{i}" for i in range(len(covariates))]])
    counts = [F.col("n"), F.col("n") * F.col("__lp"), *[F.col("n") * F.col(c) for c in covariates]]
    if isinstance(rows, DataFrame) and start is not None:
        rows = cover(rows, covariates, stop, event, start, by, offset)
    if isinstance(rows, DataFrame):
        dead = F.col(event) == 1
        bands = _banded(rows, covariates, beta, offset).groupBy(*by, F.col(stop).alias("t"), "__band").agg(
            *[F.sum(F.when(dead, none).otherwise(term(m))).alias(c) for m, c in zip(names, of_alive)], *[F.sum(F.when(dead, term(m)).otherwise(none)).alias(c) for m, c in zip(names, of_dead)],
            *[F.sum(F.when(dead, c).otherwise(none)).alias(k) for c, k in zip(counts, plain)],
        )
        return _one_scale(bands, [*by, "t"], [*of_alive, *of_dead], plain).where("deaths > 0")
    nodes = _banded(rows.alive, covariates, beta, offset).groupBy(*by, "level", "node", "__band").agg(*[F.sum(term(m)).alias(c) for m, c in zip(names, of_alive)])
    leaves = rows.dead.select(*by, "no").distinct().select(*by, "no", F.explode(F.sequence(F.lit(0), F.lit(rows.levels - 1))).alias("level"))
    above = leaves.withColumn("node", F.call_function("shiftright", F.col("no"), F.col("level"))).join(nodes, [*by, "level", "node"])
    died = _banded(rows.dead, covariates, beta, offset).groupBy(*by, "no", "__band").agg(
        *[F.sum(term(m)).alias(c) for m, c in zip(names, of_dead)], *[F.sum(c).alias(k) for c, k in zip(counts, plain)]
    )
    # a time has a row a level and band
    both = above.select(*by, "no", "__band", *of_alive, *[none.alias(c) for c in [*of_dead, *plain]])
    both = both.unionByName(died.select(*by, "no", "__band", *[none.alias(c) for c in of_alive], *of_dead, *plain))
    out = _one_scale(both, [*by, "no"], [*of_alive, *of_dead], plain).join(rows.times, "no")
    return out if order < 2 else out.drop("no")


def sums(rows: DataFrame, covariates: Sequence[str], beta: Sequence[float | Column], stop: str = "stop", event: str = "event", start: str | None = None, by: Sequence[str] = (), shift: float = 0.0, offset: str | None = None) -> DataFrame:
    """scaled_sums at one scale: per death time a_* and d_* of n exp(lp - shift) times 1, x_i, x_i x_j; deaths; lp; x_i of the dead."""
    out = scaled_sums(rows, covariates, beta, stop, event, start, by, offset)
    scale = F.exp(F.col("top") - F.lit(float(shift)))
    return out.select(*[(F.col(c) * scale).alias(c) if c.split("_")[0] in ("a", "d") and c not in by else F.col(c) for c in out.columns if c != "top"])


def likelihood(stops: DataFrame, d: int, ties: str = "efron", by: Sequence[str] = (), shift: float = 0.0, most_ties: int | None = None) -> DataFrame:
    """Per group: loss (negative log partial likelihood), g_i and h_i_j from the sums of its death times (scaled_sums, or sums with their shift).

    A time of W tied deaths is W rows, made from chunks of at most TIES; where most_ties says that a time has more, chunks are dealt out to the tasks first.
    """
    if ties not in ("efron", "breslow"):
        raise ValueError("ties is efron or breslow")
    w = F.col("deaths").cast("int")
    if ties == "efron":
        rows = stops.select("*", F.explode(F.sequence(F.lit(0), F.floor((w - 1) / TIES).cast("int"))).alias("chunk"))
        if most_ties is not None and most_ties > TIES:
            rows = rows.repartition(*by, "t", "chunk")
        rows = rows.select("*", F.explode(F.sequence(F.col("chunk") * TIES + 1, F.least(w, (F.col("chunk") + 1) * TIES))).alias("k"))
    else:
        rows = stops.withColumn("k", w)
    c = F.col("k") / F.col("deaths") if ties == "efron" else F.lit(1.0)
    times = F.lit(1.0) if ties == "efron" else F.col("deaths")
    log_scale = F.col("top") if "top" in stops.columns else F.lit(float(shift))
    s = {m: F.col(_name("a", m)) + c * F.col(_name("d", m)) for m in moments(d)}
    last = F.when(F.col("k") == w, 1.0).otherwise(0.0)  # what is counted once a time
    out = [F.sum(times * (F.log(s[()]) + log_scale) - last * F.col("lp")).alias("loss")]
    out += [F.sum(times * s[(i,)] / s[()] - last * F.col(f"x_{i}")).alias(f"g_{i}") for i in range(d)]
    out += [F.sum(times * (s[m] / s[()] - (s[m[:1]] / s[()]) * (s[m[1:]] / s[()]))).alias(_name("h", m)) for m in moments(d) if len(m) == 2]
    return rows.groupBy(*by).agg(*out) if by else rows.agg(*out)


def _summed(v: np.ndarray, m: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Groups x columns of v x columns of m: sums of products over the rows of each group."""
    if 16 * len(starts) <= len(v):
        return np.stack([v[a:b].T @ m[a:b] for a, b in zip(starts, [*starts[1:], len(v)])])
    return np.stack([np.add.reduceat(v[:, k, None] * m, starts) for k in range(v.shape[1])], axis=1)


def vector_sums(rows: DataFrame, covariates: Sequence[str], betas: dict[tuple, tuple[np.ndarray, np.ndarray]], stop: str = "stop", event: str = "event", by: Sequence[str] = (), weight: str | None = None, centre: Sequence[float] | None = None, offset: str | None = None) -> DataFrame:
    """by, k, t and what scaled_sums has, of aligned rows at many vectors of coefficients at once: rows are summed in batches by matrix products, not once a vector.

    rows: by, stop, event, covariates, n, and weight, by which n is multiplied: an array with a number for each vector, or a whole number with a bit for each (none: a single vector).
    betas: for each value of by the places k of its vectors among the weights, and the vectors. Rows of other values are left out.
    """
    names, labels = list(covariates), moments(len(covariates))
    first, second = ([m[i] for m in labels if len(m) == 2] for i in (0, 1))
    middle = np.zeros(len(names)) if centre is None else np.asarray(centre, dtype=float)
    bits = weight is not None and isinstance(rows.schema[weight].dataType, T.LongType)
    scaled, plain = [[_name(kind, m) for m in labels] for kind in ("a", "d")], ["deaths", "lp", *[f"x_{i}" for i in range(len(names))]]
    sent = rows.sparkSession.sparkContext.broadcast(betas)

    def part(key: tuple, batch: pa.RecordBatch, dead: bool) -> pa.RecordBatch | None:
        places, beta = sent.value[key]
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        w = column("n").astype(float)[:, None]
        if bits:
            w = w * np.unpackbits(column(weight).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, places]
        elif weight:
            w = w * batch.column(weight).flatten().to_numpy().reshape(batch.num_rows, -1)[:, places]
        times = batch.column(stop).dictionary_encode()
        some = np.flatnonzero((w > 0).any(axis=1))
        if not len(some):
            return None
        at = times.indices.to_numpy()[some]
        order = np.argsort(at, kind="stable")
        some, at = some[order], at[order]
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        of = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(at)))
        x, w = np.stack([column(c)[some].astype(float) for c in names], axis=1) - middle, w[some]
        lp = x @ beta.T + (column(offset)[some].astype(float)[:, None] if offset else 0.0)
        top = np.maximum.reduceat(np.where(w > 0, lp, -np.inf), starts, axis=0)
        there = np.isfinite(top)
        band = np.floor(np.where(there, top, 0.0) / BAND)
        r = w * np.exp(np.minimum(lp - band[of] * BAND, BAND))
        one = np.ones((len(x), 1))
        sums = _summed(r, np.concatenate([one, x, x[:, first] * x[:, second]], axis=1), starts)[there]
        none = np.zeros_like(sums)
        if dead:
            counts = np.concatenate([_summed(w, np.concatenate([one, x], axis=1), starts)[there], np.add.reduceat(w * lp, starts, axis=0)[there][:, None]], axis=1)
            values = [none, sums, counts[:, [0, len(names) + 1]], counts[:, 1:-1]]
        else:
            values = [sums, none, np.zeros((len(sums), len(plain)))]
        g, k = np.nonzero(there)
        keys = [pa.array([v] * len(g), batch.schema.field(c).type) for c, v in zip(by, key)]
        found = [*keys, pa.array(places[k], pa.int32()), times.dictionary.take(pa.array(at[starts][g])), pa.array(band[there], pa.float64()), *map(pa.array, np.concatenate(values, axis=1).T.copy())]
        return pa.RecordBatch.from_arrays(found, [*by, "k", "t", "__band", *scaled[0], *scaled[1], *plain])

    def run(batches):
        for batch in batches:
            code = np.zeros(batch.num_rows, dtype=np.int64)
            for c in by:
                coded = batch.column(c).dictionary_encode()
                code = code * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
            died = batch.column(event).to_numpy(zero_copy_only=False) == 1
            for u in np.unique(code):
                mine = np.flatnonzero(code == u)
                key = tuple(batch.column(c)[int(mine[0])].as_py() for c in by)
                if key not in sent.value:
                    continue
                for dead in (False, True):
                    at = mine[died[mine] == dead]
                    found = part(key, batch.take(pa.array(at)), dead) if len(at) else None
                    if found is not None:
                        yield found

    numbers = [*scaled[0], *scaled[1], *plain]
    kinds = T.StructType([*[rows.schema[c] for c in by], T.StructField("k", T.IntegerType()), T.StructField("t", rows.schema[stop].dataType), *[T.StructField(c, T.DoubleType()) for c in ["__band", *numbers]]])
    used = rows.select(*by, stop, event, *names, "n", *([weight] if weight else []), *([offset] if offset else []))
    bands = used.mapInArrow(run, kinds).groupBy(*by, "k", "t", "__band").agg(*[F.sum(c).alias(c) for c in numbers])
    return _one_scale(bands, [*by, "k", "t"], [*scaled[0], *scaled[1]], plain).where("deaths > 0")


def tie_sums(a: np.ndarray, dead: np.ndarray, deaths: np.ndarray, ties: str) -> np.ndarray:
    """Per time: sums over its ties of 1/s, c/s, 1/s^2, c/s^2, c^2/s^2 and log s, for s = a + c d."""
    if ties == "breslow":
        s = a + dead
        return np.stack([deaths / s, deaths / s, deaths / s**2, deaths / s**2, deaths / s**2, deaths * np.log(s)], axis=1)
    n = np.rint(deaths).astype(np.int64)
    ends, out = np.cumsum(n), np.zeros((len(n), 6))
    for low in range(0, int(n.sum()), PIECE):
        j = np.arange(low, min(low + PIECE, ends[-1]))
        row = np.searchsorted(ends, j, side="right")
        c = (j - (ends[row] - n[row]) + 1) / deaths[row]
        s = a[row] + c * dead[row]
        i = 1 / s
        begin = int(row[0])
        for q, v in enumerate((i, c * i, i * i, c * i * i, c * c * i * i, np.log(s))):
            found = np.bincount(row - begin, weights=v)
            out[begin : begin + len(found), q] += found
    return out


def tied_likelihood(stops: DataFrame, d: int, ties: str = "efron", by: Sequence[str] = ()) -> DataFrame:
    """likelihood of scaled_sums, where a time's tied deaths are summed in a task and are no rows."""
    labels = [m for m in moments(d) if len(m) == 2]
    names = ["loss", *[f"g_{i}" for i in range(d)], *[_name("h", m) for m in labels]]
    i, j = ([m[side] for m in labels] for side in (0, 1))

    def run(batches):
        for pdf in batches:
            column = lambda kind: pdf[[_name(kind, (k,)) for k in range(d)]].to_numpy()
            q = tie_sums(pdf["a"].to_numpy(), pdf["d"].to_numpy(), pdf["deaths"].to_numpy(), ties)
            a, dead = column("a"), column("d")
            a2, d2 = (pdf[[_name(kind, m) for m in labels]].to_numpy() for kind in ("a", "d"))
            each = lambda k: q[:, k, None]
            loss = q[:, 5] + pdf["deaths"].to_numpy() * pdf["top"].to_numpy() - pdf["lp"].to_numpy()
            g = each(0) * a + each(1) * dead - column("x")
            h = each(0) * a2 + each(1) * d2 - each(2) * a[:, i] * a[:, j] - each(3) * (a[:, i] * dead[:, j] + dead[:, i] * a[:, j]) - each(4) * dead[:, i] * dead[:, j]
            yield pd.concat([pdf[list(by)].reset_index(drop=True), pd.DataFrame(np.concatenate([loss[:, None], g, h], axis=1), columns=names)], axis=1)

    kinds = T.StructType([*[stops.schema[c] for c in by], *[T.StructField(c, T.DoubleType()) for c in names]])
    rows = stops.mapInPandas(run, kinds)
    out = [F.sum(c).alias(c) for c in names]
    return rows.groupBy(*by).agg(*out) if by else rows.agg(*out)


def weighted_rows(rows: DataFrame | Cover, times: DataFrame, covariates: Sequence[str], beta: Sequence[float], stop: str = "stop", event: str = "event", by: Sequence[str] = (), offset: str | None = None) -> DataFrame:
    """(covariates, w): of rows or nodes, w such that the sum of w x x' is the part of the Hessian that is of second moments.

    times: by, t (no for a cover), top, alpha and beta, what a unit of survivors' and of the dead's second moments adds. So no second moments are kept for each time.
    """
    if isinstance(rows, DataFrame):
        joined = _banded(rows, covariates, beta, offset).join(times.withColumnRenamed("t", stop), [*by, stop])
        w = F.col("n") * F.exp(F.col("__lp") - F.col("top")) * F.when(F.col(event) == 1, F.col("beta")).otherwise(F.col("alpha"))
        return joined.select(*covariates, w.alias("w"))
    alive = _banded(rows.alive, covariates, beta, offset)
    bands = alive.select(*by, "level", "node", "__band").distinct()
    leaves = times.select(*by, "no", "top", "alpha", F.explode(F.sequence(F.lit(0), F.lit(rows.levels - 1))).alias("level"))
    leaves = leaves.withColumn("node", F.call_function("shiftright", F.col("no"), F.col("level")))
    # a band of a node above a time is never beyond the time's own scale
    nodes = bands.join(leaves, [*by, "level", "node"]).groupBy(*by, "level", "node", "__band").agg(F.sum(F.col("alpha") * F.exp(F.col("__band") * BAND - F.col("top"))).alias("each"))
    living = alive.join(nodes, [*by, "level", "node", "__band"]).select(*covariates, (F.col("__r") * F.col("each")).alias("w"))
    dead = _banded(rows.dead, covariates, beta, offset).join(times.select(*by, "no", "top", "beta"), [*by, "no"])
    return living.union(dead.select(*covariates, (F.col("n") * F.exp(F.col("__lp") - F.col("top")) * F.col("beta")).alias("w")))


def members(df: DataFrame, id: str = "id", start: str = "start", stop: str = "stop", event: str = "event") -> DataFrame:
    """(t, id) for every death time and row at risk then; as many rows as risk sets have members. Times are met by their numbers."""
    t = ordered.dense_ranks(df.where(F.col(event) == 1).select(F.col(stop).alias("t")), "t", "no").withColumn("n", F.lit(1).cast("long"))
    rows = ordered.up_to(df.select(id, start, stop), t, "t", ["n"], [start, stop]).where(F.col(f"n_{start}") < F.col(f"n_{stop}"))
    return rows.select(id, F.explode(F.sequence(F.col(f"n_{start}"), F.col(f"n_{stop}") - 1)).alias("no")).join(t.select("t", "no"), "no").select("t", id)


def hazards(df: DataFrame, risk: str = "risk", start: str | None = "start", stop: str = "stop", event: str = "event", ties: str = "efron") -> DataFrame:
    """Per death time: increment h of the cumulative hazard, increment e that its own dead get, and cumhaz."""
    dead = F.col(event) == 1
    end = lambda at, s, eden, deaths: F.struct(F.col(at).alias("t"), s.alias("s"), eden.alias("eden"), deaths.alias("deaths"))
    both = [end(stop, F.col(risk), F.when(dead, F.col(risk)).otherwise(0.0), F.when(dead, 1).otherwise(0))]
    if start:
        both.append(end(start, -F.col(risk), F.lit(0.0), F.lit(0)))
    ends = df.select(F.inline(F.array(*both))).groupBy("t").agg(*[F.sum(c).alias(c) for c in ("s", "eden", "deaths")])
    t = ordered.prefix_sums(ends.withColumn("den", F.col("s")), "t", ["den"], descending=True).where("deaths > 0")
    if ties == "efron":
        # a time of many ties is several rows of at most TIES of them
        chunks = t.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("deaths") - 1) / TIES).cast("int"))).alias("chunk"))
        ks = F.sequence(F.col("chunk") * TIES, F.least(F.col("deaths").cast("int"), (F.col("chunk") + 1) * TIES) - 1)
        part = lambda k: 1.0 / (F.col("den") - k / F.col("deaths") * F.col("eden"))
        h = F.aggregate(ks, F.lit(0.0), lambda a, k: a + part(k))
        e = F.aggregate(ks, F.lit(0.0), lambda a, k: a + (1 - k / F.col("deaths")) * part(k))
        t = chunks.repartition("t", "chunk").groupBy("t", "deaths").agg(F.sum(h).alias("h"), F.sum(e).alias("e"))
    else:
        h = F.col("deaths") / F.col("den")
        t = t.select("t", "deaths", h.alias("h"), h.alias("e"))
    return ordered.prefix_sums(t.withColumn("cumhaz", F.col("h")), "t", ["cumhaz"])


def martingale(df: DataFrame, risk: str = "risk", start: str | None = "start", stop: str = "stop", event: str = "event", ties: str = "efron", keys: Sequence[str] = ("id", "stop")) -> DataFrame:
    """keys and resid = event - risk * hazard over (start, stop], with the dead's own reduced increment; a row for each row of df.

    The cumulative hazard is looked up at both ends of an interval, so no row meets more than its own times.
    """
    h = hazards(df, risk, start, stop, event, ties).select(F.col("t").alias("__t"), F.col("h").alias("__h"), (F.col("h") - F.col("e")).alias("__less"))
    rows = ordered.up_to(df, h, "__t", ["__h"], [start, stop] if start else [stop])
    rows = rows.join(h.select("__t", "__less"), (F.col(stop) == F.col("__t")) & (F.col(event) == 1), "left")
    used = F.col(f"__h_{stop}") - (F.col(f"__h_{start}") if start else F.lit(0.0)) - F.coalesce("__less", F.lit(0.0))
    return rows.select(*keys, (F.col(event) - F.col(risk) * used).alias("resid"))


def _pairs_by_score(df: DataFrame, score: str, start: str, stop: str, event: str, by: Sequence[str] = (), weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(by, s, t, d, x, n, rank and places) of distinct rows, and per failing (by, t, x): m and, of the rows at risk that do not fail then, below, equal, above.

    A time t takes the places 2 r (rows that fail at t) and 2 r + 1 (the event at t itself, other rows that end or begin there), so those
    that fail together are no pairs.
    """
    n = F.sum(weight) if weight else F.count("*")
    groups = written(df.groupBy(*by, F.col(start).alias("s"), F.col(stop).alias("t"), F.col(event).alias("d"), F.round(score, 9).alias("x")).agg(n.cast("long").alias("n")))
    times = ordered.dense_ranks(groups.select(F.explode(F.array("s", "t")).alias("t")), "t", "r")
    ranks = ordered.dense_ranks(groups, "x", "rank")
    groups = groups.join(ranks, "x").join(times.select("t", (2 * F.col("r")).alias("end")), "t").join(times.select(F.col("t").alias("s"), (2 * F.col("r") + 1).alias("begin")), "s")
    # read for points, failures and events
    groups = written(groups)
    # a row is counted from its end back, and taken away from its beginning back
    ends = groups.select(*by, (F.col("end") + (F.col("d") != 1).cast("long")).alias("pos"), "rank", "n")
    points = ends.union(groups.select(*by, F.col("begin").alias("pos"), "rank", -F.col("n")))
    fails = groups.where("d = 1").groupBy(*by, "t", "x", "rank", "end").agg(F.sum("n").alias("m"))
    levels = max(1, (ranks.count() or 1).bit_length())
    asked = fails.select(*by, F.struct("t", "x").alias("q"), (F.col("end") + 1).alias("pos"), "rank")
    found = ordered.counts_below(points, asked, levels, by).select(*by, "q.t", "q.x", "below", "equal", (F.col("all") - F.col("below") - F.col("equal")).alias("above"))
    return groups, written(fails.join(found, [*by, "t", "x"]).withColumn("levels", F.lit(levels)))


def concordance(df: DataFrame, score: str, start: str = "start", stop: str = "stop", event: str = "event", by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """by, and counts of concordant, discordant and tied pairs: an event at t against rows at risk then that don't fail then. weight: numbers of equal rows.

    A pair is concordant if the one that fails has the higher score. Pairs are counted by sums over a tree of scores, one for all values of by, not made.
    """
    fails = _pairs_by_score(df, score, start, stop, event, by, weight)[1]
    total = lambda c, name: F.coalesce(F.sum(F.col("m") * F.col(c)), F.lit(0)).cast("long").alias(name)
    counts = fails.groupBy(*by).agg(total("below", "concordant"), total("above", "discordant"), total("equal", "tied_x"))
    same = fails.groupBy(*by, "t").agg(F.sum("m").alias("__a"), F.sum(F.col("m") * F.col("m")).alias("__b"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("__c"))
    ties = same.groupBy(*by).agg(
        F.coalesce(F.sum((F.col("__a") * F.col("__a") - F.col("__b")) / 2), F.lit(0.0)).cast("long").alias("tied_y"), F.coalesce(F.sum("__c"), F.lit(0.0)).cast("long").alias("tied_xy")
    )
    # without by one row each
    out = counts.join(ties, list(by)) if by else counts.crossJoin(F.broadcast(ties))
    total_ = F.col("concordant") + F.col("discordant") + F.col("tied_x")
    return out.withColumn("concordance", (F.col("concordant") + F.col("tied_x") / 2) / F.when(total_ > 0, total_))


def concordance_error(df: DataFrame, score: str, start: str = "start", stop: str = "stop", event: str = "event") -> DataFrame:
    """concordance and its standard error by the infinitesimal jackknife over rows.

    A row's influence is the score of its pairs (1 concordant, 1/2 tied) less their expected score, over all pairs. Rows
    that are equal in (start, stop, event, score) share it. Both sides of the pairs are counted as in concordance.
    """
    groups, fails = _pairs_by_score(df, score, start, stop, event)
    levels = fails.select("levels").limit(1).collect()
    half = lambda a, b: F.col(a) + F.col(b) / 2
    as_dead = fails.select("t", "x", half("below", "equal").alias("w1"), (F.col("below") + F.col("equal") + F.col("above")).alias("p1"), F.lit(1).alias("d"))
    # of a row at risk: the events from its beginning (not at it) to its end (before it, if the row itself fails then)
    events = fails.select((F.col("end") + 1).alias("pos"), "rank", F.col("m").alias("n"))
    key = F.struct("s", "t", "d", "x")
    after = lambda place: ordered.counts_below(events, groups.select(key.alias("q"), place.alias("pos"), "rank"), levels[0][0] if levels else 1)
    above = (F.col("all") - F.col("below") - F.col("equal")).alias("above")
    begun = after(F.col("begin") + 1).select("q", above, "equal", "all")
    ended = after(F.when(F.col("d") == 1, F.col("end") + 1).otherwise(F.col("end") + 2)).select("q", above.alias("above2"), F.col("equal").alias("equal2"), F.col("all").alias("all2"))
    at_risk = begun.join(ended, "q").select("q.*", (half("above", "equal") - half("above2", "equal2")).alias("w2"), (F.col("all") - F.col("all2")).alias("p2"))
    zero = F.lit(0.0)
    each = groups.join(as_dead, ["t", "x", "d"], "left").join(at_risk, ["s", "t", "d", "x"], "left").select(
        "n", (F.coalesce("w1", zero) + F.coalesce("w2", zero)).alias("w"), (F.coalesce("p1", zero) + F.coalesce("p2", zero)).alias("p")
    )
    # every pair counts once for each of its rows; squares of w - c p are summed by their parts
    total = each.agg(*[F.sum(F.col("n") * c).alias(k) for k, c in {"w": F.col("w"), "p": F.col("p"), "ww": F.col("w") ** 2, "wp": F.col("w") * F.col("p"), "pp": F.col("p") ** 2}.items()])
    c = F.col("w") / F.when(F.col("p") > 0, F.col("p"))
    return total.select(c.alias("concordance"), (F.sqrt(F.greatest(zero, F.col("ww") - 2 * c * F.col("wp") + c * c * F.col("pp"))) / (F.when(F.col("p") > 0, F.col("p")) / 2)).alias("se"))
