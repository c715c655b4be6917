"""Exact vector ranking for batches of queries, and the hashing embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.bm25 import WORDS, Analyser, top

DIM = 384
EMBED_ROWS = 1000  # texts that a model is given at once
QUERY_BLOCK = 20_000_000  # numbers of query vectors that one scan takes along


# A model takes texts and gives a matrix, a row for each; it travels to the workers and lives there.
Embedder = Callable[[list[str]], np.ndarray]


class HashEmbedder:
    """Tokens hashed to buckets with a sign, sums brought to length one; without tokens all zeros."""

    def __init__(self, dim: int = DIM):
        self.dim, self.analyser, self.known = dim, Analyser(), {}

    def _entry(self, word: str) -> tuple[list[int], list[float]]:
        """Where a word's tokens and stems go."""
        entry = self.known.get(word)
        if entry is None:
            if len(self.known) > 500_000:
                self.known.clear()
            own, stems = self.analyser.words(word)
            digests = [hashlib.md5(t.encode()).digest() for t in own + stems]
            entry = self.known[word] = (
                [int.from_bytes(h[:4], "little") % self.dim for h in digests], [1.0 if h[4] & 1 else -1.0 for h in digests]
            )
        return entry

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            places, signs = [], []
            for word in WORDS.findall(text):
                place, sign = self._entry(word)
                places += place
                signs += sign
            if places:
                out[row] = np.bincount(places, signs, self.dim)
        length = np.sqrt((out * out).sum(axis=1))
        return (out / np.where(length == 0, 1, length)[:, None]).astype(np.float32)


def with_vectors(df: DataFrame, model: Embedder, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds vec, the model's vector of a row's text; null texts count as empty. One Arrow pass, no shuffle."""
    names = df.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, EMBED_ROWS):
                part = batch.slice(at, EMBED_ROWS)
                m = np.asarray(model([prefix + (t or "") for t in part.column(text_col).to_pylist()]), np.float32)
                offsets = pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(m.ravel()))], names=[*names, "vec"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(add, f"{fields}, vec array<float>")


def embed(df: DataFrame, id_col: str, model: Embedder, text_col: str = "text", prefix: str = "") -> DataFrame:
    """(id_col, vec)."""
    rows = df.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return with_vectors(rows, model, "text", prefix).drop("text")


def usable(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Rows whose vector has the dimension and holds only numbers."""
    return df.where((F.size(vec) == dim) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x)))


def _common_dim(queries: DataFrame, vectors: DataFrame) -> int:
    """The dimension of the queries' vectors, which those compared must share."""
    sizes = [r[0] for df in (queries, vectors) for r in df.where("v is not null").select(F.size("v")).limit(1).collect()]
    if len(set(sizes)) > 1:
        raise ValueError(f"queries have vectors of {sizes[0]} numbers, chunks of {sizes[1]}")
    return sizes[0] if sizes else 0


def _query_blocks(queries: DataFrame, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The stated queries in blocks of bounded size; a larger set means more scans."""
    most = max(1, QUERY_BLOCK // max(dim, 1))
    few = queries.count() <= most
    rows = []
    for row in queries.collect() if few else queries.toLocalIterator():
        rows.append(row)
        if len(rows) == most:
            yield np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
            rows = []
    if rows:
        yield np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)


def top_cosines(queries: DataFrame, vectors: DataFrame, n: int, dim: int | None, query_id: str, vector_id: str, vec: str = "vec") -> DataFrame:
    """(query_id, chunk_id, cosine, pos): the ``n`` most similar rows of each query, without a floor.

    Every row is compared: each task multiplies its batches with the queries' matrix and
    hands on what may be among its own best, so the rows that leave it grow with the
    logarithm of its input; the window over all of them decides. Without ``dim`` both sides
    must have one and the same. The norm of a zero vector is 1.
    """
    asked = queries.select(F.col(query_id).cast("bigint").alias("q"), F.col(vec).alias("v"))
    rows = vectors.select(F.col(vector_id).cast("bigint").alias("id"), F.col(vec).alias("v"))
    dim = _common_dim(asked, rows) if dim is None else dim
    asked, rows = usable(asked, "v", dim), usable(rows, "v", dim)
    asked, rows = asked.where("q is not null"), rows.where("id is not null")
    sc = queries.sparkSession.sparkContext

    def scan(block: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        shared = sc.broadcast(block)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            q = q / _length(q)
            floor = np.full(len(q), -2.0)  # the n-th best of a single part so far, for each query: what lies below cannot come in
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    own = part.column("id").to_numpy(zero_copy_only=False)
                    v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
                    for start in range(0, len(q), 1000):
                        c = np.round(q[start : start + 1000] @ (v / _length(v)).T, 9)
                        best_here = floor[start : start + 1000]
                        if c.shape[1] >= n:
                            np.maximum(best_here, np.partition(c, c.shape[1] - n, axis=1)[:, c.shape[1] - n], out=best_here)
                        i, j = np.nonzero(c >= best_here[:, None])  # all that tie with the n-th stay for the window to decide
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[start + i]), pa.array(own[j]), pa.array(c[i, j])], names=["query_id", "chunk_id", "cosine"]
                        )

        return rows.mapInArrow(best, "query_id bigint, chunk_id bigint, cosine double")

    found = None
    for block in _query_blocks(asked, dim):
        part = scan(block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.sparkSession.createDataFrame([], "query_id bigint, chunk_id bigint, cosine double")
    return top(found, n, "cosine")


def _length(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.where(n == 0, 1, n)
