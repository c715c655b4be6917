"""The stored index: segments that are only ever added, refresh by content hash, statistics."""

from __future__ import annotations

import hashlib
import json
import math
import time
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.config import Config, dump_config, load_config, set_value
from granary.functions import text as T
from granary.operators import bm25, vector
from granary.operators.chunking import chunk_lines, joined
from granary.plans import search as searching
from granary.plans.runtime import keep, prepare

KINDS = {
    "files": "file_id bigint, root string, path string, mtime double, size bigint, hash string, chunk_count int, dl bigint",
    "chunks": "chunk_id bigint, file_id bigint, ord int, start_line int, end_line int, text string, tokens array<string>, dl int, vec array<float>",
    "postings": "term string, chunk_id bigint, file_id bigint, dl int, tf int, places array<int>, bucket int",
    "gone": "file_id bigint",
}
BUCKETS = 16  # folders of postings in a segment; a query opens those of its terms
MOST_SEGMENTS = 8  # more are merged into one
POSTINGS_TASK = 4_000_000  # postings to a written piece
FEW_TERMS = 500  # wanted terms that are pushed into the scan of the postings


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of each chunk, with its places among the chunk's index tokens."""
    for batch in batches:
        for row in range(0, batch.num_rows, 500):
            part = batch.slice(row, 500)
            out: list[list] = [[] for _ in range(6)]
            for chunk, file, tokens in zip(*(part.column(c).to_pylist() for c in ("chunk_id", "file_id", "tokens"))):
                places: dict[str, list[int]] = {}
                held = bm25.index_tokens(tokens)
                for at, term in enumerate(held):
                    places.setdefault(term, []).append(at)
                for term, at in places.items():
                    for column, value in zip(out, (term, chunk, file, len(held), len(at), at)):
                        column.append(value)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["term", "chunk_id", "file_id", "dl", "tf", "places"])


class RetrievalIndex:
    """Files, chunks with tokens and vectors, and postings, in segments under ``path``.

    A change writes one more segment: what is new, and the ids of files that are gone or
    replaced. A numbered manifest names the segments; the highest one counts, so a reader
    finds either the old state or the new one. What is already stored is rewritten only when
    segments are merged. A file's identity is (root, path); every version of it has an id
    of its own, and ids that would collide are drawn again.
    """

    def __init__(self, spark: SparkSession, path: str, model: vector.Embedder | None = None, dim: int | None = None):
        self.spark, self.path, self.model = prepare(spark), path.rstrip("/"), model or vector.HashEmbedder()
        self.dim = dim or getattr(self.model, "dim", None) or int(self.model([""]).shape[1])

    def _fs(self, name: str = ""):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _numbers(self) -> list[int]:
        fs, where = self._fs()
        names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    @property
    def manifest(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "segments": [], "chunks": 0, "dl": 0, "meta": {}, "config": None}
        rows = self.spark.read.text(f"{self.path}/manifest-{numbers[-1]:09d}.json", wholetext=True).collect()  # one small file
        return json.loads(rows[0][0])

    def _publish(self, before: dict, **changes) -> None:
        """The next manifest: written aside, then renamed; one that is there already belongs to another writer."""
        new = before | changes | {"number": before["number"] + 1}
        if self._numbers()[-1:] > [before["number"]]:
            raise RuntimeError("the index was changed by another writer; read it again")
        fs, aside = self._fs(f"writing-{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        _, where = self._fs(f"manifest-{new['number']:09d}.json")
        if fs.exists(where) or not fs.rename(aside, where):
            fs.delete(aside, False)
            raise RuntimeError("the index was changed by another writer; read it again")
        self._sweep(new, before)

    def _sweep(self, new: dict, before: dict) -> None:
        """Removes manifests older than the last two and the segments that neither names."""
        used = {s["name"] for m in (new, before) for s in m["segments"]}
        fs, where = self._fs()
        for x in fs.listStatus(where):
            name = x.getPath().getName()
            old = name.startswith("manifest-") and int(name[9:-5]) < new["number"] - 1
            if old or (name.startswith("segment-") and name not in used and int(name.split("-")[1]) < new["number"]):
                fs.delete(x.getPath(), True)

    @property
    def meta(self) -> dict:
        return self.manifest["meta"]

    @property
    def config(self) -> Config:
        return load_config(self.manifest["config"])

    def save_config(self, config: Config) -> None:
        self._publish(self.manifest, config=dump_config(config))

    def set(self, key: str, value) -> Config:
        """M8: one setting changed and stored."""
        config = set_value(self.config, key, value)
        self.save_config(config)
        return config

    def exclude(self, add: tuple[str, ...] = (), remove: tuple[str, ...] = ()) -> tuple[str, ...]:
        """The exclude patterns after some are added and removed; a refresh applies them."""
        return self._change("exclude_patterns", add, remove)

    def track(self, add: tuple[str, ...] = (), remove: tuple[str, ...] = ()) -> tuple[str, ...]:
        """The roots that a refresh is to list, after some are added and removed."""
        return self._change("tracked_paths", add, remove)

    def _change(self, setting: str, add: tuple[str, ...], remove: tuple[str, ...]) -> tuple[str, ...]:
        old = getattr(self.config, setting)
        new = tuple(x for x in dict.fromkeys([*old, *add]) if x not in set(remove))
        if new != old:
            self.set(setting, new)
        return new

    def _stored(self, kind: str, manifest: dict | None = None) -> DataFrame:
        """All rows of a kind in the manifest's segments, those of files that are gone included."""
        names = [s["name"] for s in (manifest or self.manifest)["segments"] if s[kind]]
        parts = [self.spark.read.schema(KINDS[kind]).parquet(f"{self.path}/{name}/{kind}") for name in names]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], KINDS[kind])

    def _live(self, kind: str, manifest: dict | None = None) -> DataFrame:
        manifest = manifest or self.manifest
        rows = self._stored(kind, manifest)
        if not any(s["gone"] for s in manifest["segments"]):
            return rows
        return rows.join(self._stored("gone", manifest), "file_id", "left_anti")

    @property
    def files(self) -> DataFrame:
        return self._live("files")

    @property
    def chunks(self) -> DataFrame:
        return self._live("chunks")

    def files_by_path(self, wanted: DataFrame) -> DataFrame:
        """The files of many (root, path) at once, nulls where there is none."""
        return wanted.select("root", "path").distinct().join(self.files, ["root", "path"], "left")

    def _write(self, name: str, files: DataFrame | None, chunks: DataFrame | None, gone: DataFrame | None) -> dict:
        """Writes a segment and says how many rows it has; ``chunks`` are written first, as all else follows from them."""
        at, entry = f"{self.path}/{name}", {"name": name} | dict.fromkeys(KINDS, 0)
        if chunks is not None:
            chunks.write.parquet(f"{at}/chunks")
            written = self.spark.read.schema(KINDS["chunks"]).parquet(f"{at}/chunks")
            counted = written.groupBy("file_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"), F.sum("dl").alias("dl"))
            files.join(counted, "file_id").select("file_id", "root", "path", "mtime", "size", "hash", "chunk_count", "dl").write.parquet(f"{at}/files")
            totals = self.spark.read.schema(KINDS["files"]).parquet(f"{at}/files").agg(F.count(F.lit(1)), F.sum("chunk_count"), F.sum("dl")).first()
            entry |= {"files": totals[0], "chunks": totals[1] or 0, "dl": totals[2] or 0, "postings": totals[2] or 0}
            if entry["dl"]:
                post = written.select("chunk_id", "file_id", "tokens").mapInArrow(_postings, KINDS["postings"].removesuffix(", bucket int"))
                post = post.withColumn("bucket", F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(BUCKETS)).cast("int"))
                tasks = max(BUCKETS, math.ceil(entry["dl"] / POSTINGS_TASK))
                # a term of very many chunks is split by chunk, and terms lie together for the scan to skip the rest
                post = post.repartitionByRange(tasks, "bucket", "term", "chunk_id").sortWithinPartitions("bucket", "term", "chunk_id")
                post.write.partitionBy("bucket").parquet(f"{at}/postings")
        if gone is not None:
            gone.select("file_id").distinct().write.parquet(f"{at}/gone")
            entry["gone"] = self.spark.read.schema(KINDS["gone"]).parquet(f"{at}/gone").count()
        return entry

    def index(self, listing: DataFrame, force: bool = False) -> dict:
        """M1: takes up (root, path, text, size, mtime); returns indexed, unchanged, skipped, chunks.

        Blank texts are skipped (F2), files whose hash is known stay (F3) unless ``force``,
        files without chunks are skipped (F4). Of rows with the same identity the last by
        mtime counts; rows without root or path take no part. The model's dimension must
        stay the same (M12). Stored files that do not change are not touched.
        """
        return self._apply(listing, force, False)

    def refresh(self, listing: DataFrame) -> dict:
        """M4: ``index``, and files no longer listed go (J7) in the same step; newly excluded ones, not listed either, go too."""
        return self._apply(listing, False, True)

    def _apply(self, listing: DataFrame, force: bool, drop: bool) -> dict:
        manifest = self.manifest
        known = manifest["meta"].get("vec_dim")
        if known is not None and int(known) != self.dim:
            raise ValueError(f"the index holds vectors of {known} numbers, the model gives {self.dim}; rebuild with force")
        c, number = load_config(manifest["config"]), manifest["number"] + 1
        rows = listing.where("root is not null and path is not null").select(
            "root", "path", F.col("mtime").cast("double").alias("mtime"), F.col("size").cast("bigint").alias("size"), "text",
            T.content_hash("text").alias("hash"), T.is_blank("text").alias("blank"),
        )
        last = F.max(F.struct("mtime", "size", "hash", "blank"))  # texts stay where they lie: their hashes are compared
        once = rows.groupBy("root", "path").agg(last.alias("x"), F.count(F.lit(1)).alias("n")).select("root", "path", "x.*", "n")
        stored = self._live("files", manifest).select("root", "path", F.col("file_id").alias("old_id"), F.col("hash").alias("old_hash"))
        same = F.lit(not force) & F.coalesce(F.col("hash") == F.col("old_hash"), F.lit(False)) & ~F.col("blank")
        met = keep(once.join(stored, ["root", "path"], "left").withColumn("same", same))
        fresh = met.where(~F.col("blank") & ~F.col("same"))
        file_id = self._free_ids(fresh, manifest, number)

        texts = rows.where(~F.col("blank"))
        if manifest["segments"] or met.where("n > 1").limit(1).count():
            chosen = fresh.select("root", "path", "hash").distinct()
            texts = texts.join(chosen, ["root", "path", "hash"], "left_semi")
            if fresh.where("n > 1").limit(1).count():
                texts = texts.dropDuplicates(["root", "path"])
        pieces = chunk_lines(texts.withColumn("file_id", file_id), "file_id", "text", c.chunk_target_lines, c.chunk_min_lines, c.chunk_overlap_lines)
        if pieces.rdd.getNumPartitions() > 8192:
            pieces = pieces.coalesce(8192)
        # the number of the change, of the task and of the row in it: no counter is shared
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 30) - 1))
        chunk_id = F.lit(number << 43) + F.spark_partition_id().cast("bigint") * (1 << 30) + place
        pieces = bm25.with_tokens(pieces.withColumn("chunk_id", chunk_id)).withColumn("dl", F.size("index_tokens")).drop("index_tokens")
        pieces = vector.with_vectors(pieces, self.model, prefix=c.passage_prefix)
        pieces = pieces.select("chunk_id", "file_id", "ord", "start_line", "end_line", "text", "tokens", "dl", "vec")

        name = f"segment-{number:09d}-{uuid.uuid4().hex[:8]}"
        entry = self._write(name, fresh.withColumn("file_id", file_id), pieces, None)
        taken = self.spark.read.schema(KINDS["files"]).parquet(f"{self.path}/{name}/files")
        gone = met.join(taken.select("root", "path"), ["root", "path"], "left_semi").where("old_id is not null").select(F.col("old_id").alias("file_id"))
        removed = 0
        if drop:
            missing = self._live("files", manifest).join(met.select("root", "path"), ["root", "path"], "left_anti").select("file_id")
            removed = missing.count()
            gone = gone.unionByName(missing)
        counted = taken.select("root", "path", "chunk_count")
        n = met.join(counted, ["root", "path"], "left").agg(
            F.count_if(F.col("same")).alias("unchanged"),
            F.count_if(~F.col("same") & F.col("chunk_count").isNotNull()).alias("indexed"),
            F.count_if(F.col("blank") | (~F.col("same") & F.col("chunk_count").isNull())).alias("skipped"),
            F.coalesce(F.sum(F.when(~F.col("same"), F.col("chunk_count"))), F.lit(0)).alias("chunks"),
        ).first().asDict()
        self._commit(manifest, entry, gone, vec_dim=self.dim, model=c.model)
        return n | ({"removed": removed} if drop else {})

    def _free_ids(self, fresh: DataFrame, manifest: dict, number: int):
        """Column: an id for each file of this change; the salt grows until no two files have the same."""
        salt = 0
        while True:
            column = F.xxhash64(F.lit(number), F.lit(salt), "root", "path")
            ids = fresh.select(column.alias("file_id")).unionByName(self._live("files", manifest).select("file_id"))
            if ids.groupBy("file_id").count().where("count > 1").limit(1).count() == 0:
                return column
            salt += 1

    def _commit(self, manifest: dict, entry: dict, gone: DataFrame | None, **meta) -> None:
        lost = {"chunks": 0, "dl": 0}
        if gone is not None and manifest["segments"]:
            sums = self._live("files", manifest).join(gone.distinct(), "file_id", "left_semi").agg(F.sum("chunk_count"), F.sum("dl")).first()
            lost = {"chunks": sums[0] or 0, "dl": sums[1] or 0}
            entry["gone"] = self._write(entry["name"], None, None, gone)["gone"]
        built = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        segments = manifest["segments"] + ([entry] if entry["files"] or entry["gone"] else [])
        self._publish(
            manifest, segments=segments, chunks=manifest["chunks"] + entry["chunks"] - lost["chunks"], dl=manifest["dl"] + entry["dl"] - lost["dl"],
            meta=manifest["meta"] | {"last_build": built} | meta,
        )
        if len(segments) > MOST_SEGMENTS:
            self.merge()

    def merge(self) -> None:
        """All segments as one, without what is gone."""
        manifest = self.manifest
        name = f"segment-{manifest['number'] + 1:09d}-{uuid.uuid4().hex[:8]}"
        files = self._live("files", manifest).drop("chunk_count", "dl")
        entry = self._write(name, files, self._live("chunks", manifest), None)
        self._publish(manifest, segments=[entry], chunks=entry["chunks"], dl=entry["dl"])

    def delete(self, ids: DataFrame) -> None:
        """K2: files and, with them, their chunks: only their ids are written."""
        manifest = self.manifest
        name = f"segment-{manifest['number'] + 1:09d}-{uuid.uuid4().hex[:8]}"
        self._commit(manifest, {"name": name} | dict.fromkeys([*KINDS, "dl"], 0), ids)

    def clear(self) -> None:
        """K3, M6: no rows; settings and metadata stay."""
        self._publish(self.manifest, segments=[], chunks=0, dl=0)

    def rebuild(self, listing: DataFrame, force: bool = False) -> dict:
        """M5: with ``force`` the rows, the dimension and the model are forgotten first."""
        if force:
            meta = {k: v for k, v in self.meta.items() if k not in ("vec_dim", "model")}
            self._publish(self.manifest, segments=[], chunks=0, dl=0, meta=meta)
        return self.index(listing, force=force)

    def status(self) -> DataFrame:
        """M3, A1, A2: one row of counts."""
        return store_stats(self.files, self.chunks)

    def is_stale(self, now: float | None = None) -> bool:
        """older than the settings allow, or never built."""
        built = self.meta.get("last_build")
        if not built:
            return True
        then = time.mktime(time.strptime(built, "%Y-%m-%dT%H:%M:%SZ")) - time.timezone
        return (now or time.time()) - then > self.config.stale_after_hours * 3600

    def refresh_if_stale(self, listing: DataFrame, now: float | None = None) -> dict | None:
        """M10."""
        return self.refresh(listing) if self.is_stale(now) else None

    def corpus(self) -> StoredCorpus:
        return StoredCorpus(self)

    def search(self, queries: DataFrame, config: Config | None = None, semantic: bool = True) -> searching.Searched:
        """M2: over the stored postings, tokens and vectors."""
        return searching.search_corpus(queries, self.corpus(), config or self.config, semantic)

    def inject(self, prompts: DataFrame, semantic: bool = True) -> DataFrame:
        """M9."""
        return searching.inject(prompts, self.corpus(), self.config, semantic)


class StoredCorpus(searching.Corpus):
    """What a search reads, from one state of a stored index."""

    def __init__(self, index: RetrievalIndex):
        self.index, self.manifest = index, index.manifest
        super().__init__(index._live("chunks", self.manifest), index._live("files", self.manifest), index.model, load_config(self.manifest["config"]))
        self.dim = None  # what is stored may be of another model

    def matched(self, wanted: bm25.Wanted) -> tuple[DataFrame, int, float]:
        """From the postings of the wanted terms alone."""
        spark = self.index.spark
        single = {k: c for k, c in wanted.codes.items() if k not in wanted.phrases}
        terms = {*single, *wanted.parts}
        post = self.index._stored("postings", self.manifest).where(F.col("bucket").isin({_bucket(t) for t in terms} or {-1}))
        if len(terms) <= FEW_TERMS:
            post = post.where(F.col("term").isin(*terms)) if terms else post.where("false")
        if any(s["gone"] for s in self.manifest["segments"]):
            post = post.join(self.index._stored("gone", self.manifest), "file_id", "left_anti")
        codes = spark.createDataFrame([*single.items()], "term string, code int")  # at most the pairs that ``top_scores`` lets through
        held = post.join(F.broadcast(codes), "term").select("chunk_id", "dl", "code", "tf")
        if wanted.phrases:
            parts = [(wanted.codes[key], len(own), k, part) for key, own in wanted.phrases.items() for k, part in enumerate(own)]
            parts = spark.createDataFrame(parts, "code int, n int, k int, term string")
            votes = post.select("term", "chunk_id", "dl", F.explode("places").alias("at")).join(F.broadcast(parts), "term")
            starts = votes.groupBy("code", "n", "chunk_id", "dl", (F.col("at") - F.col("k")).alias("start")).agg(F.count(F.lit(1)).alias("votes")).where("votes = n")
            held = held.unionByName(starts.groupBy("chunk_id", "dl", "code").agg(F.count(F.lit(1)).cast("int").alias("tf")))
        lists = held.groupBy("chunk_id", "dl").agg(F.collect_list(F.struct("code", "tf")).alias("x"))
        found = keep(lists.select("chunk_id", "dl", F.col("x.code").alias("keys"), F.col("x.tf").alias("tfs")))
        return found, self.manifest["chunks"], self.manifest["dl"] / max(self.manifest["chunks"], 1)

    def vectors(self) -> DataFrame:
        return self.chunks.select("chunk_id", "vec")

    def details(self, ids: DataFrame, semantic: bool) -> DataFrame:
        return self._of(ids, "chunk_id", "file_id", "text", "start_line", "end_line", "tokens", "vec")


def store_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(files, chunks, vectors, chars, approx_tokens)."""
    c = chunks.agg(
        F.count(F.lit(1)).alias("chunks"), F.count("vec").alias("vectors"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")
    )
    f = files.agg(F.count(F.lit(1)).alias("files"))
    return f.crossJoin(c).withColumn("approx_tokens", T.approx_tokens("chars"))


def term_statistics(chunks: DataFrame) -> DataFrame:
    """(term, df, cf) of the index's terms."""
    return bm25.postings(bm25.analyse_chunks(chunks)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


LINE_ENDS = 64  # line ends tried after a text whose stored size says nothing


def _hashed(text: str, wanted: str, size: int | None) -> bool:
    """Whether a text, or the text and the line ends that chunks leave out at its end, has a hash."""
    data = text.encode()
    for end in (b"\n", b"\r\n"):
        so_far = hashlib.sha1(data)
        for _ in range(max((size or 0) - len(data), LINE_ENDS) + 1):
            if so_far.hexdigest() == wanted:
                return True
            so_far.update(end)
    return False


def unchanged(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """The rows of ``files`` (file_id, hash, size, ...) whose hash is that of the text their chunks make up.

    Chunks of one ``ord`` count once; where their texts differ, the first rows and the last
    ones are tried. A hash cannot match by chance, so a file found is unchanged.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for file_id, wanted, size, pieces in zip(*(batch.column(c).to_pylist() for c in ("file_id", "hash", "size", "pieces"))):
                last = {x["ord"]: x["text"] for x in pieces}
                first = {x["ord"]: x["text"] for x in reversed(pieces)}
                tries = [last] if first == last else [last, first]
                if any(_hashed(joined([x[o] for o in sorted(x)]), wanted, size) for x in tries):
                    same.append(file_id)
            yield pa.RecordBatch.from_arrays([pa.array(same, pa.int64())], names=["file_id"])

    piece = F.struct(F.coalesce("ord", F.lit(-1)).alias("ord"), "chunk_id", "text")
    held = chunks.where("text is not null").groupBy("file_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    known = files.where("hash is not null").select("file_id", F.lower("hash").alias("hash"), F.col("size").cast("bigint").alias("size"))
    same = held.join(known, "file_id").select("file_id", "hash", "size", "pieces").mapInArrow(compare, "file_id bigint")
    return files.join(same.distinct(), "file_id", "left_semi")
