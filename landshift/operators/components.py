"""Connected components.

Edges are first contracted on the way: every task replaces a stretch of edges by the stars that span the
same components. Graphs that fall into scopes (one raster, one parcel) are sorted by scope before,
so nearly all scopes are done then. While a vertex has two labels or a label that is no root, the stored stars are
contracted again in as many stretches as their number asks for, which spans the tasks of the pass before, and what is open
after that goes through a large-star and a small-star step (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014). The path is the same for every size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from landshift.session import store

#: Edges that a task holds at once; a longer stretch is contracted in pieces.
HELD_EDGES = 200_000


def _least_labels(u: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """Least vertex number of the component of every vertex 0..size-1, edges u-v."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for at in (u, v, label[u], label[v]):
            np.minimum.at(new, at, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _stars(part: pd.DataFrame, scope: list[str]) -> pd.DataFrame:
    """Edges (scope, src, dst) from every vertex to the least of its component within the given edges."""
    rows = part.reset_index(drop=True)
    n = len(rows)
    group = rows.groupby(scope, sort=False, dropna=False).ngroup().to_numpy() if scope else np.zeros(n, np.int64)
    codes, names = pd.factorize(pd.concat([rows["src"], rows["dst"]]), sort=True)
    pairs = np.concatenate([group, group]).astype(np.int64) * len(names) + codes
    known, at = np.unique(pairs, return_inverse=True)
    label = _least_labels(at[:n], at[n:], len(known))
    own = label != np.arange(len(known))
    first = pd.Series(np.arange(n)).groupby(group).first().to_numpy()
    out = rows.loc[first[known[own] // len(names)], scope].reset_index(drop=True)
    out["src"] = np.asarray(names)[known[own] % len(names)]
    out["dst"] = np.asarray(names)[known[label[own]] % len(names)]
    return out


def _contracted(edges: DataFrame, scope: list[str], held: int) -> DataFrame:
    """The stars of every stretch of ``held`` edges, in the order in which tasks meet them."""
    cols = [*scope, "src", "dst"]
    types = dict(edges.dtypes)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            waiting.append(batch)
            size += len(batch)
            if size >= held:
                yield _stars(pd.concat(waiting), scope)
                waiting, size = [], 0
        if size:
            yield _stars(pd.concat(waiting), scope)

    return edges.select(*cols).mapInPandas(walk, ", ".join(f"`{c}` {types[c]}" for c in cols))


def _open(edges: DataFrame, scope: list[str]) -> bool:
    """Whether some vertex has two labels, or a label that has a label itself."""
    ends = edges.select(*scope, F.col("src").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(*scope, F.col("dst").alias("v"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    per = ends.groupBy(*scope, "v").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return bool(per.agg(F.max(((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).cast("int"))).first()[0])


def _stored(edges: DataFrame) -> tuple[DataFrame, int]:
    """Distinct edges as a stored table, and their number."""
    kept, seen = store(edges.distinct(), n=F.count(F.lit(1)))
    return kept, seen["n"]


def _star_round(current: DataFrame, s: list[str]) -> DataFrame:
    both = current.unionByName(current.select(*s, F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy(*s, "src").agg(F.least(F.col("src"), F.min("dst")).alias("m"))
    large = (
        both.join(least, [*s, "src"]).where(F.col("dst") > F.col("src"))
        .select(*s, F.col("dst").alias("src"), F.col("m").alias("dst"))
        .where(F.col("src") != F.col("dst")).distinct()
    )
    lowest = large.groupBy(*s, "src").agg(F.min("dst").alias("m"))
    return (
        large.join(lowest, [*s, "src"])
        .select(*s, F.col("dst").alias("src"), F.col("m").alias("dst"))
        .where(F.col("src") != F.col("dst"))
        .unionByName(lowest.select(*s, "src", F.col("m").alias("dst")))
    )


def connected_components(
    edges: DataFrame, vertices: DataFrame | None = None, scope: tuple[str, ...] = (), held: int = HELD_EDGES,
) -> DataFrame:
    """Least vertex of the component of every vertex.

    ``edges``: scope columns, src, dst (any direction, repeated or not); edges never leave their scope.
    Returns scope, vertex, component; with ``vertices`` (scope, vertex) isolated ones are their own
    component.
    """
    s = list(scope)
    given = edges.where(F.col("src") != F.col("dst"))
    if s:
        given = given.select(*s, "src", "dst").repartition(*s).sortWithinPartitions(*s)
    current, n = _stored(_contracted(given, s, held))
    while _open(current, s):
        # Files of the pass before are read in longer stretches, without a shuffle of their own.
        current, n = _stored(_contracted(current.coalesce(max(1, math.ceil(n / held))), s, held))
        if not _open(current, s):
            break
        current, n = _stored(_star_round(current, s))
    labels = current.select(*s, F.col("src").alias("vertex"), F.col("dst").alias("component"))
    roots = current.select(*s, F.col("dst").alias("vertex"), F.col("dst").alias("component")).distinct()
    known = labels.unionByName(roots)
    if vertices is None:
        return known
    return (
        vertices.select(*s, "vertex").distinct().join(known, [*s, "vertex"], "left")
        .withColumn("component", F.coalesce("component", "vertex"))
    )
