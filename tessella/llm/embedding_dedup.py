"""Embedding near-duplicates by PCA-ordered tiled comparison.

All unit vectors are rotated onto their principal axes, which keeps cosines and
puts most of a product into the leading dimensions. Vectors are cut into slabs
along the first axis and packed into chunks of bounded size. Two chunks whose
slabs lie further apart on that axis than sqrt(2 - 2 t) cannot hold a pair with
cosine t, and never meet. Within a tile of two chunks the product of the leading
dimensions comes first; the rest of a pair's product is at most the product of
their suffix norms, so a pair stops when even that cannot reach the threshold.
Pairs within 1e-9 of the threshold are computed again from the vectors as given.

Equal vectors are one class before any tile. A tile gives link counts per vector
and a spanning forest of its links, never all pairs, so a dense cluster of n
vectors costs n rows a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.components import components
from tessella.llm.scratch import Scratch

THRESHOLD = 0.9
CHUNK = 2048
MAX_SLABS = 4096  # beyond it a slab has several chunks, which all meet
STRIP = 256
_NEAR = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so no norm under- or overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of components, by vector length."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        dims = b.column(1).to_numpy()
        for d in np.unique(dims):
            u = _units(_matrix(b.column(0).filter(pa.array(dims == d))))
            sums[int(d)] = sums.get(int(d), 0) + u.T @ u
    for d, s in sums.items():
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int64)), pa.array(i), pa.array(j), pa.array(s[i, j])], names=["dim", "i", "j", "s"])


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length, the axes (columns) by falling share; d * d / 2 sums reach the driver."""
    rows = vectors.select("embedding", "dim").mapInArrow(_gram, "dim long, i long, j long, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    axes = {}
    for d, part in rows.groupby("dim"):
        gram = np.zeros((int(d), int(d)))
        gram[part["i"], part["j"]] = part["s"]
        gram[part["j"], part["i"]] = part["s"]
        axes[int(d)] = np.linalg.eigh(gram)[1][:, ::-1].copy()
    return axes


def _link_rows(ids_a, n_a, x_a, ids_b, n_b, x_b, axes, same: bool, t: float):
    """Counts (id, links) and forest edges (id, id) of one tile."""
    u_a, u_b = _units(x_a), _units(x_b)
    y_a, y_b = u_a @ axes, u_b @ axes
    d = y_a.shape[1]
    cuts = [0, *(c for c in (8, 16, 32, 64, 128, 256, 512, 1024) if c < d), d]
    tail = lambda y, c: np.sqrt((y[:, c:] ** 2).sum(axis=1))
    tails_a, tails_b = [tail(y_a, c) for c in cuts], [tail(y_b, c) for c in cuts]
    links_a, links_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    group = np.arange(len(ids_a) + len(ids_b)) if not same else np.concatenate([np.arange(len(ids_a))] * 2)
    edges: list[tuple[int, int]] = []
    for lo in range(0, len(ids_a), STRIP):
        hi = min(lo + STRIP, len(ids_a))
        first = lo + 1 if same else 0  # a tile of a chunk with itself takes each pair once
        if first >= len(ids_b):
            continue
        product = np.zeros((hi - lo, len(ids_b) - first))
        alive = np.ones(product.shape, bool)
        if same:
            alive &= np.arange(first, len(ids_b))[None, :] > np.arange(lo, hi)[:, None]
        i = j = None
        for k in range(1, len(cuts)):
            product += y_a[lo:hi, cuts[k - 1] : cuts[k]] @ y_b[first:, cuts[k - 1] : cuts[k]].T
            alive &= product + tails_a[k][lo:hi, None] * tails_b[k][None, first:] >= t - _NEAR
            if not alive.any():
                break
            if k + 1 < len(cuts) and alive.mean() < 0.02:
                i, j = np.nonzero(alive)
                values = product[i, j] + (y_a[lo + i, cuts[k] :] * y_b[first + j, cuts[k] :]).sum(axis=1)
                break
        else:
            i, j = np.nonzero(alive)
            values = product[i, j]
        if i is None or not len(i):
            continue
        i, j = i + lo, j + first
        close = np.flatnonzero(np.abs(values - t) < _NEAR)
        for c in close:
            p, q = x_a[i[c]], x_b[j[c]]
            values[c] = float(p @ q) / (float(np.sqrt(p @ p)) * float(np.sqrt(q @ q)))
        hit = values >= t
        i, j = i[hit], j[hit]
        links_a += np.bincount(i, n_b[j], len(ids_a)).astype(np.int64)
        links_b += np.bincount(j, n_a[i], len(ids_b)).astype(np.int64)
        shift = 0 if same else len(ids_a)
        for r, js in zip(*np.unique(i, return_index=True), strict=True):
            to = j[js : np.searchsorted(i, r, side="right")]
            groups, where = np.unique(group[to + shift], return_index=True)
            new = groups != group[r]
            if new.any():
                edges += [(int(ids_a[r]), int(ids_b[to[w]])) for w in where[new]]
                group[np.isin(group, groups)] = group[r]
    return links_a, links_b, edges


def _tiles(axes: dict[int, np.ndarray], t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                dim, a, c, *packed = (b.column(k)[r].as_py() for k in range(b.num_columns))
                ids_a, n_a, ids_b, n_b = (np.frombuffer(packed[k], np.int64) for k in (0, 1, 3, 4))
                x_a, x_b = (np.frombuffer(packed[k], np.float64).reshape(-1, dim) for k in (2, 5))
                links_a, links_b, edges = _link_rows(ids_a, n_a, x_a, ids_b, n_b, x_b, axes[dim], a == c, t)
                ids = np.concatenate([ids_a, ids_b])
                links = np.concatenate([links_a, links_b])
                some = links > 0
                ids, links = ids[some], links[some]
                one, two = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([ids, one])),
                        pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(two)]),
                        pa.concat_arrays([pa.array(links), pa.nulls(len(one), pa.int64())]),
                    ],
                    names=["a", "b", "n"],
                )

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (dim, slab) to chunks of at most CHUNK vectors."""
    number: dict[tuple, int] = {}
    held: list[pa.RecordBatch] = []
    key, n = None, 0

    def chunk() -> pa.RecordBatch:
        part = number[key] = number.get(key, -1) + 1
        rows = pa.Table.from_batches(held)
        x = np.concatenate([_matrix(b.column(4)) for b in held])
        values = [key[0], key[1], part, rows.column(2).to_numpy().tobytes(), rows.column(3).to_numpy().tobytes(), x.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["dim", "slab", "part", "ids", "sizes", "data"])

    for b in batches:
        if not b.num_rows:
            continue
        dims, slabs = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(dims) != 0) | (np.diff(slabs) != 0)) + 1), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            at = lo
            while at < hi:
                if held and (key != (int(dims[at]), int(slabs[at])) or n >= CHUNK):
                    yield chunk()
                    held, n = [], 0
                key = (int(dims[at]), int(slabs[at]))
                take = min(hi - at, CHUNK - n)
                held.append(b.slice(at, take))
                n += take
                at += take
    if held:
        yield chunk()


def near_duplicate_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Links are pairs with cosine >= threshold in double precision. Vectors that are
    null, empty, zero or hold a null or non-finite component link with nothing, as
    do vectors of different lengths. Rows with equal vectors link with each other;
    a repeated row is a vector of its own and counts as a link of its copies, while
    rows of one vec_id are one node. A null vec_id gives n_links 0, a null
    component, and is kept. Other columns are not read.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "embeddings")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.coalesce((F.size("embedding") > 0) & ~odd & F.exists("embedding", lambda x: x != 0), F.lit(False))
    fine = rows.where(usable)
    classes = fine.groupBy("embedding").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"))
    classes = scratch.keep(classes.withColumn("dim", F.size("embedding").cast("long")), "classes")
    member = fine.join(classes.select("embedding", "class_id"), "embedding").select("vec_id", "class_id")
    axes = principal_axes(classes)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    @F.pandas_udf("double")
    def lead(vectors, dims):
        import pandas as pd

        out = np.empty(len(dims))
        for d in dims.unique():
            at = np.flatnonzero(dims.to_numpy() == d)
            out[at] = _units(np.stack([np.asarray(vectors.iloc[k], np.float64) for k in at])) @ axes[int(d)][:, 0]
        return pd.Series(out)

    placed = scratch.keep(classes.withColumn("lead", lead("embedding", "dim")), "placed")
    counts = {r["dim"]: r["n"] for r in placed.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    cuts: dict[int, list[float]] = {}
    for d, n in counts.items():
        slabs = min(MAX_SLABS, max(1, -(-n // CHUNK)))
        cuts[d] = sorted(set(placed.where(F.col("dim") == d).approxQuantile("lead", [k / slabs for k in range(1, slabs)], min(0.01, 0.2 / slabs)))) if slabs > 1 else []
    cut_rows = [(d, [float("-inf"), *c]) for d, c in cuts.items()]
    borders = F.broadcast(spark.createDataFrame(cut_rows, "dim long, cuts array<double>"))  # at most MAX_SLABS numbers per length
    slab = F.size(F.filter("cuts", lambda c: c <= F.col("lead"))).cast("long") - 1
    sorted_rows = placed.join(borders, "dim").select("dim", slab.alias("slab"), F.col("class_id").alias("id"), F.col("copies").alias("size"), "embedding")
    chunks = scratch.keep(
        sorted_rows.repartition("dim", "slab").sortWithinPartitions("dim", "slab").mapInArrow(_packed, "dim long, slab long, part long, ids binary, sizes binary, data binary"),
        "chunks",
    )
    # A chunk of slab s reaches every slab whose lower border is within reach of the upper border of s.
    upper = F.coalesce(F.get("cuts", F.col("slab").cast("int") + 1), F.lit(float("inf")))
    last = F.size(F.filter("cuts", lambda c: c <= upper + reach)).cast("long") - 1
    left = chunks.join(borders, "dim").withColumn("to", F.explode(F.sequence(F.col("slab"), F.greatest("slab", last)))).drop("cuts")
    right = chunks.select("dim", F.col("slab").alias("to"), F.col("part").alias("part_b"), F.col("ids").alias("ids_b"), F.col("sizes").alias("sizes_b"), F.col("data").alias("data_b"))
    tiles = left.join(right, ["dim", "to"]).where("slab < to or part <= part_b")
    name = lambda s, p: F.concat_ws(":", s, p)
    tiles = tiles.select("dim", name("slab", "part"), name("to", "part_b"), "ids", "sizes", "data", "ids_b", "sizes_b", "data_b")
    found = scratch.keep(tiles.mapInArrow(_tiles(axes, threshold), "a long, b long, n long"), "found")

    per_class = found.where("b is null").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("n"))
    nodes = components(found.where("b is not null").select("a", "b"), scratch)
    scratch.drop("placed", "chunks")
    linked = member.join(classes.select("class_id", "copies").dropDuplicates(["class_id"]), "class_id").join(per_class, "class_id", "left")
    linked = linked.join(nodes.withColumnRenamed("node", "class_id"), "class_id", "left")
    linked = linked.groupBy("vec_id").agg(
        F.max(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.min(F.coalesce("component", "class_id")).alias("component_id")
    )
    out = rows.select("vec_id", usable.alias("usable")).join(linked, "vec_id", "left")
    n_links = F.when(F.col("usable"), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    result = out.select("vec_id", n_links.alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
