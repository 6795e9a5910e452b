"""Distinct counts by set registers with a logarithmic base.

A sketch of a set is m registers. An element's hash picks one register and gives a uniform variate u; the register
holds the largest floor(1 - log_base(u)) of its elements, clamped to 0..cap (0: no element). Merging is the maximum per register, so
partial results of any split give the same sketch. The base sets resolution against size (base 2 is a HyperLogLog,
close to 1 each register nearly keeps the minimum itself).

Under Poissonised balls-in-bins each register is independent with P(K <= k) = exp(-n/m * base^-k), k < cap. All
estimates maximise that likelihood: the cardinality of one sketch, and jointly (|A\\B|, |B\\A|, |A and B|) of two, from
which union, intersection and Jaccard follow. The stated error is the inverse observed Fisher information.

In Spark a sketch is sparse rows (group, reg, k): groupBy(...).agg(max(k)) builds, merges and rolls up, all partially
aggregated in the JVM. Estimation needs only the histogram of register values per group (at most cap + 2 values).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SetSketch:
    """m registers (a power of two), base > 1, registers clamped to 0..cap."""

    def __init__(self, m: int = 4096, base: float = 1.2, cap: int = 254) -> None:
        if m < 16 or m & (m - 1) or base <= 1 or cap < 1:
            raise ValueError("m must be a power of two of at least 16, base above 1, cap at least 1")
        self.m, self.base, self.cap = m, base, cap

    def relative_error(self) -> float:
        """Asymptotic relative standard error of a distinct count."""
        b = self.base
        return math.sqrt(((b + 1) / (b - 1) * math.log(b) - 1) / self.m)

    def register(self, element: Column) -> tuple[Column, Column]:
        """(reg, k) of an element; nulls belong to no set."""
        h = F.xxhash64(element)
        reg = F.pmod(h, F.lit(self.m)).cast("int")
        low = self.m.bit_length() - 1  # the register takes the low bits, u the others
        u = F.least((F.shiftrightunsigned(h, low).cast("double") + 0.5) / float(1 << (64 - low)), F.lit(1 - 2.0**-53))
        k = F.floor(1 - F.log(u) / math.log(self.base))
        return reg, F.greatest(F.lit(0), F.least(F.lit(self.cap), k)).cast("int")

    def build(self, df: DataFrame, groups: list[str], element: str) -> DataFrame:
        """Sparse sketches (groups..., reg, k); registers at 0 aren't stored. Rows with a null element are ignored."""
        reg, k = self.register(F.col(element))
        return df.where(F.col(element).isNotNull()).select(*groups, reg.alias("reg"), k.alias("k")).groupBy(*groups, "reg").agg(F.max("k").alias("k")).where("k > 0")

    def merge(self, sketches: DataFrame, groups: list[str]) -> DataFrame:
        """The union of all sketches that agree on `groups`."""
        return sketches.groupBy(*groups, "reg").agg(F.max("k").alias("k"))

    # likelihood of registers

    def _levels(self) -> np.ndarray:
        return self.base ** -np.arange(self.cap + 1, dtype=float)

    def _log_p(self, k: np.ndarray, rate: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """(log P(K = k), its derivative by rate) at n/m = rate."""
        hi = np.where(k >= self.cap, 0.0, self.base ** -np.minimum(k, self.cap).astype(float))
        lo = np.where(k > 0, self.base ** -(np.maximum(k, 1) - 1.0), np.inf)
        a, b = np.exp(-rate * hi), np.where(k > 0, np.exp(-rate * np.where(np.isinf(lo), 0, lo)), 0.0)
        p = np.maximum(a - b, 1e-300)
        d = (-hi * a + np.where(k > 0, np.where(np.isinf(lo), 0, lo) * b, 0.0)) / p
        return np.log(p), d

    def count(self, histogram: np.ndarray) -> tuple[float, float]:
        """(estimate, standard error) from histogram[k] = registers with value k (k = 0..cap), by Newton in log n."""
        c = np.asarray(histogram, float)
        if c[0] >= self.m:
            return 0.0, 0.0
        k = np.flatnonzero(c)
        w = c[k]
        r = self.m / max(float((c * self._levels()).sum()), 1e-12) * (1 - 1 / self.base) / math.log(self.base)
        for _ in range(100):
            _, d = self._log_p(k, r)
            e = r * 1e-5
            _, d2 = self._log_p(k, r + e)
            g, h = float((w * d).sum()) * r, float((w * (d2 - d) / e).sum()) * r * r + float((w * d).sum()) * r
            step = np.clip(-g / h if h < 0 else np.sign(g) * 0.5, -1, 1)
            r *= math.exp(step)
            if abs(step) < 1e-9:
                break
        info = max(-h, 1e-12)
        return r * self.m, r * self.m / math.sqrt(info)

    def joint(self, pairs: pd.DataFrame) -> dict[str, float]:
        """Maximum likelihood of two sketches, from columns ka, kb, n (registers with these two values; registers that
        are 0 in both included). Returns a_only, b_only, both, union, intersection, jaccard and their standard errors.

        With P(Ka <= i, Kb <= j) = exp(-(a base^-i + b base^-j + c base^-min(i,j))) / per register; cells are its double
        differences. Maximised over log rates by Newton with a numeric Hessian.
        """
        ka, kb, n = (pairs[x].to_numpy(float) for x in ("ka", "kb", "n"))

        def tail(k: np.ndarray) -> np.ndarray:
            return np.where(k < 0, np.inf, np.where(k >= self.cap, 0.0, self.base ** -np.clip(k, 0, self.cap)))

        def cdf(r: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            with np.errstate(invalid="ignore"):
                s = r[0] * tail(i) + r[1] * tail(j) + r[2] * tail(np.minimum(i, j))
            return np.where((i < 0) | (j < 0), 0.0, np.exp(-np.where(np.isfinite(s), s, 700)))

        def loss(x: np.ndarray) -> float:
            r = np.exp(x)
            p = cdf(r, ka, kb) - cdf(r, ka - 1, kb) - cdf(r, ka, kb - 1) + cdf(r, ka - 1, kb - 1)
            return -float((n * np.log(np.maximum(p, 1e-300))).sum())

        def hist(k: np.ndarray) -> np.ndarray:
            return np.bincount(k.astype(int), n, minlength=self.cap + 1)

        na, nb, nu = self.count(hist(ka))[0], self.count(hist(kb))[0], self.count(hist(np.maximum(ka, kb)))[0]
        if nu == 0:
            return dict.fromkeys(("a_only", "b_only", "both", "union", "intersection", "jaccard", "union_se", "intersection_se", "jaccard_se"), 0.0)
        floor = max(nu * 1e-6, 1e-6)
        x = np.log(np.maximum([nu - nb, nu - na, na + nb - nu], floor) / self.m)
        low = math.log(floor / self.m / 10)
        f = loss(x)
        eps = 1e-3
        unit = np.eye(3) * eps

        def derivatives(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            f0 = loss(x)
            up, down = np.array([loss(x + u) for u in unit]), np.array([loss(x - u) for u in unit])
            h = np.diag((up - 2 * f0 + down) / eps**2)
            for i in range(3):
                for j in range(i):
                    h[i, j] = h[j, i] = (loss(x + unit[i] + unit[j]) - up[i] - up[j] + f0 + loss(x - unit[i] - unit[j]) - down[i] - down[j] + f0) / (2 * eps**2)
            return (up - down) / (2 * eps), h

        for _ in range(60):
            g, h = derivatives(x)
            e, q = np.linalg.eigh(h)
            step = -(q @ ((q.T @ g) / np.maximum(np.abs(e), 1e-3 * max(np.abs(e).max(), 1e-9))))
            step *= min(1, 2 / max(np.abs(step).max(), 1e-12))
            t = 1.0
            while t > 1e-6 and loss(np.maximum(x + t * step, low)) > f:
                t /= 2
            x2 = np.maximum(x + t * step, low)
            f2 = loss(x2)
            done = f - f2 < 1e-7
            x, f = (x2, f2) if f2 <= f else (x, f)
            if done:
                break
        r = np.exp(x) * self.m
        _, h = derivatives(x)
        cov = np.linalg.pinv(h + 1e-9 * np.eye(3)) * np.outer(r, r)
        union, both = r.sum(), r[2]
        gj = np.array([-both, -both, union - both]) / union**2
        se = lambda v: float(math.sqrt(max(v @ cov @ v, 0)))
        return {"a_only": r[0], "b_only": r[1], "both": both, "union": union, "intersection": both, "jaccard": both / union, "union_se": se(np.ones(3)), "intersection_se": se(np.array([0.0, 0, 1])), "jaccard_se": se(gj)}

    # estimates in Spark

    def estimates(self, sketches: DataFrame, groups: list[str]) -> DataFrame:
        """(groups..., estimate, std_error): one row per group of sparse merged sketches."""
        hist = sketches.groupBy(*groups, "k").agg(F.count("*").alias("n")).groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("h"))

        def est(h: pd.Series) -> pd.DataFrame:
            out = []
            for x in h:
                c = np.zeros(self.cap + 1)
                for k, n in dict(x).items():
                    c[k] = n
                c[0] = self.m - c[1:].sum()
                out.append(self.count(c))
            return pd.DataFrame(out, columns=["estimate", "std_error"])

        return hist.withColumn("e", F.pandas_udf(est, "estimate double, std_error double")("h")).select(*groups, "e.estimate", "e.std_error")

    def pairs(self, sketches: DataFrame, group: str, pairs: DataFrame) -> DataFrame:
        """Joint estimates for the stated pairs (a, b) of groups: union, intersection, jaccard, each with its error."""
        side = lambda x: pairs.join(sketches.select(F.col(group).alias(x), "reg", F.col("k").alias(f"k{x}")), x)
        cell = side("a").select("a", "b", "reg", "ka", F.lit(0).alias("kb")).unionByName(side("b").select("a", "b", "reg", F.lit(0).alias("ka"), "kb")).groupBy("a", "b", "reg").agg(F.max("ka").alias("ka"), F.max("kb").alias("kb"))
        cells = cell.groupBy("a", "b", "ka", "kb").agg(F.count("*").alias("n"))
        kind = sketches.schema[group].dataType.simpleString()
        names = ["union", "union_se", "intersection", "intersection_se", "jaccard", "jaccard_se"]

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            rest = self.m - pdf.n.sum()
            e = self.joint(pd.concat([pdf[["ka", "kb", "n"]], pd.DataFrame({"ka": [0], "kb": [0], "n": [rest]})]))
            return pd.DataFrame([[pdf.a.iloc[0], pdf.b.iloc[0], *(e[x] for x in names)]], columns=["a", "b", *names])

        return cells.groupBy("a", "b").applyInPandas(fit, f"a {kind}, b {kind}, " + ", ".join(f"{x} double" for x in names))
