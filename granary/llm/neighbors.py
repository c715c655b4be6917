"""p1 - the k most similar vectors of every vector, by shifted space-filling curves.

Every vector is projected by several random rotations, shifted, and placed on a
Hilbert curve; each ordering is range-partitioned and sorted by Spark, and every
window of consecutive keys is compared with itself and its two neighbouring windows.
Vectors in one cell of the curve are ordered by a second curve inside the cell.
The windows' candidates carry exact cosines, so merging the orderings is a top-k.

Equal vectors would share one key in every ordering, so a group of copies takes part
once, through its smallest id, and its members are put back after the search.

How many orderings are needed depends on the data and its size, so it is measured: the
exact neighbours of a bounded sample are found by a scan, and orderings are added until
the wanted share of them has come out. All rows are indexed and searched for all the same.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.vector import top_cosines
from granary.plans.runtime import keep

SEED = 20_240
SAMPLE = 256  # rows whose exact neighbours measure the recall
TASK_ROWS = 100_000  # placed rows to a task of the window search: 25 MB of vectors of 64 numbers
SLACK = 2e-6  # float32 error allowed when candidates are chosen before the exact cosine


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells (n, d), as int64; d * bits <= 62."""
    x = cells.astype(np.uint32).T.copy()
    d, n = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(d):
            high = (x[i] & np.uint32(q)) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(n, np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[d - 1] & np.uint32(q)) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= flip
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> np.uint32(b)) & np.uint32(1)).astype(np.int64)
    return key


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _curve_keys(dim: int, first: int, orderings: int, projected: int, bits: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = []
        for j in range(orderings):
            rng = np.random.default_rng(SEED + first + j)
            q, _ = np.linalg.qr(rng.standard_normal((dim, projected)))
            turns.append((q, rng.random(projected)))
        side = 1 << bits
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_vectors(batch.column("vec"), dim))
            out, fine = (np.empty((len(unit), orderings), np.int64) for _ in "ab")
            for j, (q, shift) in enumerate(turns):
                # a unit vector's projection spreads by 1/sqrt(dim); four of that span the grid
                spread = unit @ q * (np.sqrt(dim) / 4) + 0.5 + (shift - 0.5) / 8
                place = spread * side
                out[:, j] = hilbert_keys(np.clip(place, 0, side - 1).astype(np.uint32), bits)
                inside = np.minimum((place - np.floor(place)) * side, side - 1)
                fine[:, j] = hilbert_keys(inside.astype(np.uint32), bits)
            offsets = pa.array(np.arange(0, out.size + 1, orderings, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (out, fine)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("vec"), *lists], names=["rep", "vec", "keys", "fine"])

    return keys


def _best_in_window(ids, ordering, unit, lo, hi, start, stop, k, floor):
    """The k best of rows [start, stop) among rows [lo, hi) of the same ordering: arrays (id, other, similarity)."""
    g = unit[start:stop].astype(np.float32) @ unit[lo:hi].astype(np.float32).T
    g[ids[start:stop, None] == ids[None, lo:hi]] = -9
    if ordering[lo] != ordering[hi - 1]:  # the same vectors come again in the next ordering
        g[ordering[start:stop, None] != ordering[None, lo:hi]] = -9
    if floor is None and g.shape[1] > k:
        kth = np.partition(g, g.shape[1] - k, axis=1)[:, g.shape[1] - k]
        row, col = np.nonzero((g >= kth[:, None] - SLACK) & (g > -2))
    else:
        row, col = np.nonzero(g >= (-2 if floor is None else floor - 1e-4))
        sim = g[row, col]
        order = np.lexsort((-sim, row))
        row, col, sim = row[order], col[order], sim[order]
        first = np.searchsorted(row, np.arange(stop - start))
        last = np.searchsorted(row, np.arange(stop - start), side="right")
        cut = np.full(stop - start, -9.0)
        many = last - first > k
        cut[many] = sim[first[many] + k - 1] - SLACK
        keep = sim >= cut[row]
        row, col = row[keep], col[keep]
    exact = np.round(np.einsum("ij,ij->i", unit[start + row], unit[lo + col]), 6)
    mine, other = ids[start + row], ids[lo + col]
    if floor is not None:
        keep = exact >= floor
        row, mine, other, exact = row[keep], mine[keep], other[keep], exact[keep]
    order = np.lexsort((other, -exact, row))
    row, mine, other, exact = row[order], mine[order], other[order], exact[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return mine[keep], other[keep], exact[keep]


def _window_search(dim: int, window: int, k: int, floor: float | None):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ordering, unit = np.empty(0, np.int64), np.empty(0, np.int32), np.empty((0, dim))
        before = 0  # rows of the finished window kept in front as context

        def emit(start, stop, hi):
            a, b, s = _best_in_window(ids, ordering, unit, 0, hi, start, stop, k, floor)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], names=["rep", "other", "similarity"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.concatenate([ids, batch.column("rep").to_numpy(zero_copy_only=False)])
            ordering = np.concatenate([ordering, batch.column("ordering").to_numpy(zero_copy_only=False)])
            unit = np.concatenate([unit, _unit(_vectors(batch.column("vec"), dim))])
            while len(ids) >= before + 2 * window:
                yield emit(before, before + window, before + 2 * window)
                ids, ordering, unit, before = ids[before:], ordering[before:], unit[before:], window
        while len(ids) > before:
            stop = min(before + window, len(ids))
            yield emit(before, stop, min(stop + window, len(ids)))
            ids, ordering, unit, before = ids[before:], ordering[before:], unit[before:], stop - before

    return search


def _top(df: DataFrame, by: str, other: str, k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("similarity"), F.asc(other))
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k).drop("_place")


def _usable(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(_id, vec) of the rows that take part."""
    x = F.col("vec")
    return (
        df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(vec_col).cast("array<float>").alias("vec"))
        .where(F.col("_id").isNotNull() & (F.size(x) == dim))
        .where(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))))
        .where(F.exists(x, lambda e: e != 0))
    )


def _round(classes: DataFrame, rows: int, first: int, orderings: int, dim: int, window: int, k: int, floor: float | None, projected: int, bits: int) -> DataFrame:
    """(rep, other, similarity): what the windows of some orderings hold for every row."""
    keyed = classes.select("rep", "vec").mapInArrow(
        _curve_keys(dim, first, orderings, projected, bits), "rep bigint, vec array<float>, keys array<bigint>, fine array<bigint>"
    )
    placed = keyed.select("rep", "vec", F.posexplode(F.arrays_zip("keys", "fine")).alias("ordering", "at"))
    placed = placed.select("rep", "vec", "ordering", F.col("at.keys").alias("key"), F.col("at.fine").alias("fine"))
    # nearly equal vectors share a cell in every ordering; the place inside the cell keeps each ordering's own neighbours
    # equal keys of many different vectors may be cut anywhere, so the id is part of the range key
    order = ("ordering", "key", "fine", "rep")
    tasks = max(classes.sparkSession.sparkContext.defaultParallelism, math.ceil(rows * orderings / TASK_ROWS))
    sorted_ = placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return sorted_.select("rep", "ordering", "vec").mapInArrow(_window_search(dim, window, k, floor), "rep bigint, other bigint, similarity double")


def _exact_sample(classes: DataFrame, k: int, dim: int, floor: float | None, sample: int) -> DataFrame:
    """(rep, similarity, pos): the true neighbours of the ``sample`` rows with the smallest hashes, by a scan."""
    asked = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("rep", "vec")
    near = top_cosines(asked, classes, k + 1, dim, "rep", "rep").where("query_id <> chunk_id")
    near = near.select(F.col("query_id").alias("rep"), F.round("cosine", 6).alias("similarity"))
    near = near.where(F.col("similarity") >= floor) if floor is not None else near
    w = Window.partitionBy("rep").orderBy(F.desc("similarity"))
    return near.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def _recall(found: DataFrame, exact: DataFrame, k: int) -> float:
    """The share of the exact neighbours' similarities that the found ones reach, place by place."""
    w = Window.partitionBy("rep").orderBy(F.desc("similarity"))
    mine = found.join(exact.select("rep").distinct(), "rep", "left_semi").select("rep", F.col("similarity").alias("mine"), F.row_number().over(w).alias("pos"))
    met = exact.join(mine, ["rep", "pos"], "left")
    # a neighbour that was missed moves all later ones up: a found list holds as many true ones as reach the last exact place
    worst = F.min("similarity").over(Window.partitionBy("rep"))
    hits = met.withColumn("worst", worst).agg(F.count_if(F.col("mine") >= F.col("worst") - 1e-9).alias("hits"), F.count(F.lit(1)).alias("n")).first()
    return hits["hits"] / hits["n"] if hits["n"] else 1.0


def nearest_vectors(
    df: DataFrame,
    id_col: str = "chunk_id",
    vec_col: str = "vec",
    k: int = 10,
    dim: int = 64,
    min_similarity: float | None = None,
    orderings: int = 10,
    window: int = 1024,
    projected: int = 10,
    bits: int = 6,
    recall: float = 0.95,
    most_orderings: int = 80,
    sample: int = SAMPLE,
) -> DataFrame:
    """(id, other, similarity): up to ``k`` most similar other rows of every row.

    Similarity is the cosine in double precision, rounded to 6 decimals; ties go to the
    smaller id. Rows with a null id, and vectors that are null, of another length than
    ``dim``, all zero, or hold nulls, NaN or infinities take no part. Repeated rows count
    once; other columns of ``df`` are ignored, whatever their names. An empty input gives
    an empty result. With ``min_similarity`` less similar pairs are left out early.

    All rows are indexed and all are queries. Neighbours are missed only if no ordering
    brings them into the same or adjacent windows of ``window`` rows. Orderings are taken
    ``orderings`` at a time until ``recall`` is measured on ``sample`` rows against a scan
    of all; a warning says so if ``most_orderings`` do not reach it.
    """
    usable = _usable(df, id_col, vec_col, dim)
    # two hashes name a class of equal vectors where its members are looked up: 128 bits
    hashes = (F.xxhash64("vec").alias("h_1"), F.xxhash64(F.lit(SEED), "vec").alias("h_2"))
    classes = keep(usable.groupBy("vec").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    rows = classes.count()
    exact = keep(_exact_sample(classes, k, dim, min_similarity, sample)) if rows > window else None

    best = None
    for first in range(0, most_orderings, orderings):
        found = _round(classes, rows, first, orderings, dim, window, k, min_similarity, projected, bits)
        found = (found if best is None else found.unionByName(best)).groupBy("rep", "other").agg(F.max("similarity").alias("similarity"))
        best = keep(_top(found, "rep", "other", k))
        reached = 1.0 if exact is None else _recall(best, exact, k)
        if reached >= recall:
            break
    else:
        warnings.warn(f"recall {reached:.3f} after {most_orderings} orderings, {recall} was wanted", stacklevel=2)

    copies = classes.where("n > 1").select(*hashes, "rep")
    members = usable.select("_id", *hashes).join(copies, ["h_1", "h_2"]).select("rep", F.col("_id").alias("member")).distinct()
    w = Window.partitionBy("rep").orderBy("member")
    leading = (
        members.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k + 1).select("rep", "member")
    )
    lists = best.unionByName(copies.select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("similarity")))
    lists = (
        lists.join(leading.withColumnRenamed("rep", "other"), "other", "left")
        .select("rep", F.coalesce("member", "other").alias("other"), "similarity")
    )
    lists = _top(lists, "rep", "other", k + 1)
    full = (
        lists.join(members, "rep", "left")
        .select(F.coalesce("member", "rep").alias("id"), "other", "similarity")
        .where("id <> other")
    )
    return _top(full, "id", "other", k)


def similar_pairs(neighbours: DataFrame, min_similarity: float) -> DataFrame:
    """(chunk_a, chunk_b): each pair once in which one is among the other's neighbours."""
    return (
        neighbours.where(F.col("similarity") >= min_similarity)
        .select(F.least("id", "other").alias("chunk_a"), F.greatest("id", "other").alias("chunk_b"))
        .distinct()
    )
