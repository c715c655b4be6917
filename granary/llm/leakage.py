"""p7 - passages of evaluation items inside corpus documents, by Wu-Manber search.

All runs of 13 consecutive words of the evaluation items are the patterns. The search
runs over word codes: a shift table over blocks of two words tells how far the window
may jump, a bucket by the hash of the last words selects the test strings that can end
here, and a direct comparison confirms them.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 13
BLOCK_CHARS = 4_000_000  # characters of evaluation text that one scan of the corpus takes along: some 700,000 runs, 100 MB a worker
FACTOR = 1_000_003
_INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0xFEFF])
_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Words: invisible characters dropped, NFKC, case folded, runs of letters or digits."""
    if not text:
        return []
    if text.isascii():
        return _WORDS.findall(text.lower())
    return _WORDS.findall(unicodedata.normalize("NFKC", text.translate(_INVISIBLE)).casefold())


def _hashed(codes: np.ndarray, ends: np.ndarray, words: int, mask: int) -> np.ndarray:
    """Hash of the ``words`` codes that end at each place; ``WuManber.matches`` computes the same word by word."""
    h = np.zeros(len(ends), np.int64)
    for back in range(words - 1, -1, -1):
        h = h * FACTOR + codes[ends - back]
    return h & mask


class WuManber:
    """Searches lists of words for any run of ``run`` (3 to 256) consecutive words of the items.

    Everything that grows with the items is an array: the words' codes item by item, a
    shift table hashed by blocks of two words, and buckets by the hash of the last three
    words, which hold each different run once with its items beside it.
    """

    def __init__(self, items: list[tuple[int, list[str]]], run: int = RUN):
        if not 3 <= run <= 256:
            raise ValueError(f"runs of 3 to 256 words are searched for, not {run}")
        self.run, self.code = run, {}
        items = [(item, words) for item, words in items if len(words) >= run]
        codes = np.fromiter((self.code.setdefault(w, len(self.code)) for _, words in items for w in words), np.int64)
        sizes = np.array([len(words) for _, words in items], np.int64)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # of a word in its item
        owner = np.repeat(np.array([item for item, _ in items], np.int64), sizes)
        bits = max(10, int(len(codes)).bit_length())
        # how far the window may move on when this block ends it; 0: a run may end here
        self.mask = (1 << (bits + 3)) - 1
        shift = np.full(self.mask + 1, run - 1, np.uint8)
        blocks = np.flatnonzero(place >= 1)
        np.minimum.at(shift, _hashed(codes, blocks, 2, self.mask), np.maximum(run - 1 - place[blocks], 0).astype(np.uint8))
        self.shift = shift.tobytes()
        # the runs by their last words; equal runs side by side, the first of each stands for all
        self.bucket_mask = (1 << bits) - 1
        ends = np.flatnonzero(place >= run - 1)
        bucket = _hashed(codes, ends, 3, self.bucket_mask)
        order = np.lexsort((_hashed(codes, ends, run, (1 << 62) - 1), bucket))
        ends, bucket = ends[order], bucket[order]
        window = codes[ends[:, None] - np.arange(run - 1, -1, -1)]
        first = np.ones(len(ends), bool)
        first[1:] = (window[1:] != window[:-1]).any(axis=1)
        firsts = np.flatnonzero(first)
        self.codes = array("q", codes.tobytes())
        self.ends = array("q", ends[firsts].tobytes())
        self.heads = array("q", np.searchsorted(bucket[firsts], np.arange(self.bucket_mask + 2)).tobytes())
        self.owned = array("q", np.append(firsts, len(ends)).tobytes())
        self.owners = array("q", owner[ends].tobytes())

    def search(self, words: list[str]) -> set[int]:
        """The items of which a run occurs in the words."""
        found: set[int] = set()
        for _, run in self.matches(words):
            found.update(self.owners[self.owned[run] : self.owned[run + 1]])
        return found

    def places(self, words: list[str]) -> list[int]:
        """The places of the last words of all occurrences, ascending."""
        return [end for end, _ in self.matches(words)]

    def matches(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """(place of the last word, number of the run) of every occurrence."""
        run, size = self.run, len(words)
        if size < run or not self.ends:
            return
        shift, mask, bucket_mask, own, ends, heads = self.shift, self.mask, self.bucket_mask, self.codes, self.ends, self.heads
        known = self.code.get
        codes = array("q", [known(w, -1) for w in words])
        end = run - 1
        while end < size:
            last, before = codes[end], codes[end - 1]
            if last < 0:  # a word of no item: no run reaches over it
                end += run
                continue
            if before < 0:
                end += run - 1
                continue
            step = shift[(before * FACTOR + last) & mask]
            if step:
                end += step
                continue
            bucket = ((codes[end - 2] * FACTOR + before) * FACTOR + last) & bucket_mask
            start, stop = heads[bucket], heads[bucket + 1]
            if start < stop:
                window = codes[end - run + 1 : end + 1]
                for k in range(start, stop):
                    if own[ends[k] - run + 1 : ends[k] + 1] == window:
                        yield end, k
            end += 1


_TABLES: dict[str, WuManber] = {}  # of this worker process, by the block's key


def table_of(key: str, items: list[tuple[int, str]], run: int) -> WuManber:
    """The search tables of a block, built once in each worker process; one block's stay at a time."""
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = WuManber([(item, words_of(text)) for item, text in items], run)
    return _TABLES[key]


def _blocks(items: DataFrame, block_chars: int) -> list[list[tuple[int, str]]]:
    """The evaluation items in blocks of bounded size; the corpus is scanned once for each."""
    blocks, size = [[]], 0
    for item, text in items.toLocalIterator():
        if size and size + len(text) > block_chars:
            blocks.append([])
            size = 0
        blocks[-1].append((item, text))
        size += len(text)
    return blocks


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text_col: str = "text",
    run: int = RUN,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id): each document and item that share ``run`` consecutive words, once.

    ``items`` is held-out material of known size. It is taken in blocks of ``block_chars``
    characters; a larger set means more scans, not larger broadcasts. Rows with a null id
    or text take no part; an item of fewer words than ``run`` is never found; repeated
    rows give one row; whole texts are searched; other columns are ignored.
    """
    held = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t"))
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.where("doc_id is not null and text is not null")  # how many words a text has shows only once it is normalised
    spark = documents.sparkSession

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = table_of(key, shared.value, run)
            for batch in batches:
                rows = [
                    (doc, item)
                    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                    for item in matcher.search(words_of(text))
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())],
                    names=["doc_id", "item_id"],
                )

        return docs.mapInArrow(search, "doc_id bigint, item_id bigint")

    blocks = _blocks(held.where("i is not null and t is not null").orderBy("i"), block_chars)
    return reduce(DataFrame.unionByName, map(scan, blocks)).distinct()
