"""Network meta-analysis: effects of all treatments of a network from contrasts of pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.evidence import reached
from corpuslens.operators.lineage import cut

Z95 = 1.959963984540054


def _solved(entries: pd.DataFrame) -> pd.DataFrame:
    """Solves one network's normal equations, of as many rows as it has treatments, less the reference's."""
    names = sorted(set(entries.i))
    free = [n for n in names if n != entries.reference.iloc[0]]
    place = {n: k for k, n in enumerate(free)}
    a, b = np.zeros((len(free), len(free))), np.zeros(len(free))
    for i, j, w, wy in zip(entries.i, entries.j, entries.w, entries.wy):
        if i in place:
            if j in place:
                a[place[i], place[j]] += w
            if i == j:
                b[place[i]] += wy
    theta, cov = np.linalg.solve(a, b), np.linalg.inv(a)
    rows = [(n, theta[place[n]], float(np.sqrt(max(0.0, cov[place[n], place[n]])))) if n in place else (n, 0.0, 0.0) for n in names]
    out = pd.DataFrame(rows, columns=["treatment", "estimate", "se"])
    out.insert(0, "network", entries.network.iloc[0])
    out["low"], out["high"] = out.estimate - Z95 * out.se, out.estimate + Z95 * out.se
    out["residual_q"] = float(entries.yy.iloc[0] - theta @ b)
    out["residual_df"] = int(entries.n.iloc[0]) - len(free)
    return out


def network_effects(contrasts: DataFrame, reference: str | None = None) -> DataFrame:
    """``network, treatment, connected, estimate, se, low, high, residual_q, residual_df`` against the reference treatment.

    ``contrasts(network, a, b, effect, se)`` observes the effect of b less that of a.  The reference is ``reference`` or a
    network's first treatment by name.  A network whose treatments aren't all linked to it isn't estimated: its rows have
    ``connected`` false and nulls.  Spark sums the normal equations; a network's own, one entry for each pair of treatments
    that met, are solved in one task.  A standard error that isn't positive is refused.
    """
    w = 1 / (F.col("se") * F.col("se"))
    weight = F.when(F.col("se") > 0, w).otherwise(F.raise_error(F.lit("a standard error must be positive")).cast("double"))
    c = cut(contrasts.select("network", "a", "b", "effect", weight.alias("w")).where("a <> b"))
    ends = c.select("network", "a", "b").unionByName(c.select("network", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    first = F.min("a") if reference is None else F.when(F.max((F.col("a") == reference).cast("int")) == 1, reference)
    base = cut(ends.groupBy(F.col("network").alias("question")).agg(first.alias("reference"), F.count_distinct("a").alias("treatments")))
    linked = reached(base.where("reference is not null").select("question", F.col("reference").alias("node")), ends.select(F.col("network").alias("question"), F.col("a").alias("src"), F.col("b").alias("dst")))
    whole = linked.groupBy("question").agg(F.count("*").alias("reached")).join(base, "question").where("reached = treatments").select(F.col("question").alias("network"), "reference")
    part = lambda i, j, w, wy: c.select("network", F.col(i).alias("i"), F.col(j).alias("j"), w.alias("w"), wy.alias("wy"))
    w, wy, none = F.col("w"), F.col("w") * F.col("effect"), F.lit(0.0)
    parts = [part("a", "a", w, -wy), part("b", "b", w, wy), part("a", "b", -w, none), part("b", "a", -w, none)]
    sums = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("network", "i", "j").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))
    total = c.groupBy("network").agg(F.sum(F.col("w") * F.col("effect") * F.col("effect")).alias("yy"), F.count("*").alias("n"))
    kind, name = c.schema["network"].dataType.simpleString(), c.schema["a"].dataType.simpleString()
    schema = f"network {kind}, treatment {name}, estimate double, se double, low double, high double, residual_q double, residual_df long"
    solved = sums.join(whole, "network").join(total, "network").groupBy("network").applyInPandas(_solved, schema)
    every = ends.select("network", F.col("a").alias("treatment")).distinct()
    return every.join(solved, ["network", "treatment"], "left").select("network", "treatment", F.col("estimate").isNotNull().alias("connected"), "estimate", "se", "low", "high", "residual_q", "residual_df")
