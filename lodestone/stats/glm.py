"""Count and choice models on aggregates: the data are reduced to Gram matrices on the executors, solved on the driver.

Designs have at most MAX_COLUMNS columns, so what a step sends is bounded whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import erf, exp, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_COLUMNS = 2_000


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    dispersion: float
    n: int
    n_clusters: int | None = None

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov), 0))

    def table(self) -> pd.DataFrame:
        z = np.divide(self.beta, self.se, out=np.zeros_like(self.beta), where=self.se > 0)
        p = np.array([2 * (1 - 0.5 * (1 + erf(abs(v) / sqrt(2)))) for v in z])
        return pd.DataFrame({"term": self.names, "coef": self.beta, "se": self.se, "z": z, "p": p, "low": self.beta - 1.959964 * self.se, "high": self.beta + 1.959964 * self.se})

    def percent_per(self, term: str, step: float = 10.0) -> float:
        return (exp(step * float(self.beta[self.names.index(term)])) - 1) * 100


def _levels(df: DataFrame, factors: Sequence[str]) -> dict[str, list[str]]:
    out = {}
    for f in factors:
        rows = df.select(F.col(f).cast("string").alias("v")).distinct().limit(MAX_COLUMNS + 1).collect()
        if len(rows) > MAX_COLUMNS:
            raise ValueError(f"{f} has more than {MAX_COLUMNS} levels")
        out[f] = sorted(r.v for r in rows)
    return out


def _design(pdf: pd.DataFrame, numeric: Sequence[str], levels: dict[str, list[str]]) -> np.ndarray:
    """Intercept, numeric columns, and treatment-coded factors without their first level."""
    cols = [np.ones(len(pdf))] + [pdf[c].to_numpy(float) for c in numeric]
    for f, vs in levels.items():
        x = pdf[f].astype(str).to_numpy()
        cols += [(x == v).astype(float) for v in vs[1:]]
    return np.column_stack(cols)


def _summed(parts: DataFrame, column: str) -> np.ndarray:
    """The element-wise sum of an array column of equal lengths, added up before it reaches the driver."""
    rows = parts.select(F.posexplode(column).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # one matrix
    return np.array([r.v for r in sorted(rows, key=lambda r: r.i)])


def fit_counts(df: DataFrame, y: str, numeric: Sequence[str] = (), factors: Sequence[str] = (), exposure: str | None = None, family: str = "poisson", cluster: str | None = None, alpha: float = 1.0, robust: bool = False, iterations: int = 50) -> Fit:
    """Log-link Poisson or negative-binomial (fixed ``alpha``) regression by iteratively reweighted least squares.

    Rows with a null or NaN in any used column, or without positive exposure, are left out. Standard errors: cluster-robust with the usual small-sample
    factor, HC1 (``robust``) or from the model.
    """
    used = list(dict.fromkeys([y, *numeric, *factors, *([exposure] if exposure else []), *([cluster] if cluster else [])]))
    d = df.select(*used).na.drop()
    for c in [y, *numeric]:
        d = d.filter(~F.isnan(F.col(c).cast("double")))
    if exposure:
        d = d.filter(F.col(exposure) > 0)
    levels = _levels(d, factors)
    names = ["Intercept", *numeric, *[f"{f}[{v}]" for f, vs in levels.items() for v in vs[1:]]]
    k = len(names)
    if k > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns")
    d = d.persist()

    def sums(batches: Iterator[pd.DataFrame], beta: np.ndarray | None) -> Iterator[pd.DataFrame]:
        g, b, s = np.zeros((k, k)), np.zeros(k), np.zeros(3)
        for pdf in batches:
            x, yy = _design(pdf, numeric, levels), pdf[y].to_numpy(float)
            off = np.log(pdf[exposure].to_numpy(float)) if exposure else np.zeros(len(pdf))
            mu = np.exp(np.clip(x @ beta + off, -30, 30)) if beta is not None else yy + 0.1
            eta = np.log(mu)
            v = mu if family == "poisson" else mu + alpha * mu * mu
            w = mu * mu / v
            z = eta - off + (yy - mu) / mu
            g += (x * w[:, None]).T @ x
            b += x.T @ (w * z)
            s += (len(pdf), float((((yy - mu) ** 2) / v).sum()), 0.0)
        yield pd.DataFrame({"g": [np.concatenate([g.ravel(), b, s]).tolist()]})

    def gather(beta: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = _summed(d.mapInPandas(lambda it: sums(it, beta), "g array<double>"), "g")
        return t[: k * k].reshape(k, k), t[k * k : k * k + k], t[-3:]

    beta = None
    for _ in range(iterations):
        g, b, _s = gather(beta)
        new = np.linalg.lstsq(g, b, rcond=None)[0]
        done = beta is not None and np.max(np.abs(new - beta)) < 1e-9
        beta = new
        if done:
            break
    g, _b, s = gather(beta)
    bread, n = np.linalg.pinv(g), int(s[0])
    clusters = None
    if cluster or robust:
        def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((k, k))
            for pdf in batches:
                x, yy = _design(pdf, numeric, levels), pdf[y].to_numpy(float)
                off = np.log(pdf[exposure].to_numpy(float)) if exposure else 0.0
                mu = np.exp(np.clip(x @ beta + off, -30, 30))
                v = mu if family == "poisson" else mu + alpha * mu * mu
                sc = x * ((yy - mu) * mu / v)[:, None]
                if not cluster:
                    total += sc.T @ sc
                    continue
                by = pd.DataFrame(sc).groupby(pdf[cluster].astype(str).to_numpy()).sum()
                yield pd.DataFrame({"c": by.index.to_numpy(), "s": by.to_numpy().tolist()})
            if not cluster:
                yield pd.DataFrame({"c": [""], "s": [total.ravel().tolist()]})

        parts = d.mapInPandas(scores, "c string, s array<double>")
        if cluster:
            # sums per cluster, then outer products added up per task: never one row per cluster on the driver
            each = parts.select("c", F.posexplode("s").alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v")).groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("s"))

            def meat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                m, c = np.zeros((k, k)), 0
                for pdf in batches:
                    a = np.array(pdf["s"].tolist())
                    if len(a):
                        m += a.T @ a
                        c += len(a)
                yield pd.DataFrame({"m": [[*m.ravel().tolist(), float(c)]]})

            t = _summed(each.mapInPandas(meat, "m array<double>"), "m")
            m, clusters = t[:-1].reshape(k, k), int(t[-1])
            factor = clusters / max(1, clusters - 1) * (n - 1) / max(1, n - k)
        else:
            m, factor = _summed(parts, "s").reshape(k, k), n / max(1, n - k)
        cov = factor * bread @ m @ bread
    else:
        cov = bread
    d.unpersist()
    return Fit(names, beta, cov, float(s[1] / max(1, n - np.linalg.matrix_rank(g))), n, clusters)


def fit_small(x: np.ndarray, y: np.ndarray, offset: np.ndarray, alpha: float | None = None, iterations: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, HC1 standard errors) of one group's few rows: Poisson, or negative-binomial with fixed ``alpha``."""
    beta = None
    for _ in range(iterations):
        mu = np.exp(np.clip(x @ beta + offset, -30, 30)) if beta is not None else y + 0.1
        v = mu if alpha is None else mu + alpha * mu * mu
        w, z = mu * mu / v, np.log(mu) - offset + (y - mu) / mu
        g = (x * w[:, None]).T @ x
        new = np.linalg.lstsq(g, x.T @ (w * z), rcond=None)[0]
        done, beta = beta is not None and np.max(np.abs(new - beta)) < 1e-10, new
        if done:
            break
    mu = np.exp(np.clip(x @ beta + offset, -30, 30))
    v = mu if alpha is None else mu + alpha * mu * mu
    bread, sc = np.linalg.pinv((x * (mu * mu / v)[:, None]).T @ x), x * ((y - mu) * mu / v)[:, None]
    n, k = x.shape
    return beta, np.sqrt(np.maximum(np.diag(n / max(1, n - k) * bread @ (sc.T @ sc) @ bread), 0))


def trends(df: DataFrame, group: str, time: str, y: str, exposure: str, least: int, alpha: float | None = 1.0) -> DataFrame:
    """``<group>, slope, se, direction`` of each group's rate over time, for groups with ``least`` rows; a group is one aggregated series."""
    kind = df.schema[group].dataType.simpleString()

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[(pdf[exposure] > 0)].dropna().sort_values(time)
        cols = [group, "slope", "se", "direction"]
        if len(pdf) < least:
            return pd.DataFrame(columns=cols)
        x = np.column_stack([np.ones(len(pdf)), pdf[time].to_numpy(float) - pdf[time].mean()])
        b, se = fit_small(x, pdf[y].to_numpy(float), np.log(pdf[exposure].to_numpy(float)), alpha)
        low, high = b[1] - 1.959964 * se[1], b[1] + 1.959964 * se[1]
        return pd.DataFrame([(key[0], b[1], se[1], "up" if low > 0 else "down" if high < 0 else "flat")], columns=cols)

    return df.select(group, time, y, exposure).groupBy(group).applyInPandas(one, f"{group} {kind}, slope double, se double, direction string")


def design_rank(df: DataFrame, numeric: Sequence[str], factors: Sequence[str] = ()) -> tuple[int, int, list[str]]:
    """(rank, columns, columns without variance) of the design matrix, from its Gram matrix."""
    d = df.select(*numeric, *factors).na.drop()
    levels = _levels(d, factors)
    k = 1 + len(numeric) + sum(len(v) - 1 for v in levels.values())

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((k, k))
        for pdf in batches:
            x = _design(pdf, numeric, levels)
            g += x.T @ x
        yield pd.DataFrame({"g": [g.ravel().tolist()]})

    g = _summed(d.mapInPandas(gram, "g array<double>"), "g").reshape(k, k)
    names = ["Intercept", *numeric, *[f"{f}[{v}]" for f, vs in levels.items() for v in vs[1:]]]
    n = g[0, 0]
    flat = [names[i] for i in range(1, k) if n and abs(g[i, i] / n - (g[0, i] / n) ** 2) < 1e-12]
    scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
    return int(np.linalg.matrix_rank(g / np.outer(scale, scale))), k, flat


def conditional_logit(sets: DataFrame, iterations: int = 100) -> dict[str, float]:
    """One covariate (``provoked``) in strata ``obs`` with one ``chosen`` each: strata are reduced to (size, provoked, chosen provoked) counts."""
    s = sets.groupBy("obs").agg(F.count(F.lit(1)).alias("n"), F.sum("provoked").alias("m"), F.max(F.col("chosen") * F.col("provoked")).alias("c")).filter("m > 0 AND m < n")
    rows = [(r.n, r.m, r.c, r.k) for r in s.groupBy("n", "m", "c").agg(F.count(F.lit(1)).alias("k")).collect()]  # at most sizes squared
    strata = sum(k for *_, k in rows)
    if strata < 10:
        raise ValueError("fewer than 10 strata with variation")
    b = 0.0
    for _ in range(iterations):
        u = h = 0.0
        for n, m, c, k in rows:
            p = m * exp(b) / (m * exp(b) + n - m)
            u += k * (c - p)
            h += k * p * (1 - p)
        step = u / h
        b += max(-2.0, min(2.0, step))
        if abs(step) < 1e-12:
            break
    return {"coef": b, "se": 1 / sqrt(h), "odds_ratio": exp(b), "n_strata": float(strata)}


def polarity_check(df: DataFrame, name: str, score: str, left: str, right: str) -> tuple[float, float]:
    """Means of the score over names that tell left and right; raises unless the left mean is the smaller."""
    r = df.agg(F.avg(F.when(F.col(name).rlike(left), F.col(score))).alias("l"), F.avg(F.when(F.col(name).rlike(right), F.col(score))).alias("r")).first()
    if r.l is None or r.r is None or not r.l < r.r:
        raise AssertionError(f"polarity: left mean {r.l}, right mean {r.r}")
    return r.l, r.r


def lowess(x: np.ndarray, y: np.ndarray, frac: float = 0.3) -> np.ndarray:
    """Locally weighted linear fit with tricube weights, without robustness rounds, at each x (aggregated series only)."""
    order = np.argsort(x, kind="stable")
    xs, ys, n = x[order].astype(float), y[order].astype(float), len(x)
    k, out = max(2, int(frac * n + 1e-10)), np.zeros(len(x))
    for i in range(n):
        d = np.abs(xs - xs[i])
        near = np.argsort(d, kind="stable")[:k]
        h = d[near].max() or 1.0
        w = np.clip(1 - (d[near] / h) ** 3, 0, None) ** 3
        a = np.column_stack([np.ones(k), xs[near] - xs[i]])
        out[order[i]] = np.linalg.lstsq(a * np.sqrt(w)[:, None], ys[near] * np.sqrt(w), rcond=None)[0][0]
    return out


