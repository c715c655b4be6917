"""Lexical ranking: postings, document lengths and BM25 over batches of queries."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.plans.runtime import keep

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
ASKED_BOUND = 2_000_000  # pairs of query and term that one scan takes along
LIST_ROWS, QUERY_ROWS = 4000, 1000  # a block of scores in a task: 32 MB


WORDS = re.compile(T.WORD)
_BOUNDARY = re.compile(T.BOUNDARY)


def _stem(t: str) -> str:
    n = len(t)
    if n <= 4:
        return t
    for ending, longer, dropped, added in (("ies", 5, 3, "y"), ("ing", 6, 3, ""), ("ed", 5, 2, "")):
        if t.endswith(ending) and n > longer:
            return t[:-dropped] + added
    for ending, stays in (("es", "ses"), ("s", "ss")):
        if t.endswith(ending) and not t.endswith(stays):
            return t[: -len(ending)]
    return t


def _word_tokens(word: str) -> tuple[list[str], list[str]]:
    """A word's own tokens, and the stems among them that differ."""
    low = word.lower()
    parts = [p.lower() for p in _BOUNDARY.split(word) if p]
    own = [t for t in [low, *(p for p in parts if p != low)] if len(t) >= 2 and not t.isdigit()]
    return own, [s for t in own if (s := _stem(t)) != t]


class Analyser:
    """Tokens of texts, in a worker that remembers its words."""

    def __init__(self):
        self.known: dict[str, tuple[list[str], list[str]]] = {}

    def words(self, word: str) -> tuple[list[str], list[str]]:
        entry = self.known.get(word)
        if entry is None:
            if len(self.known) > 500_000:
                self.known.clear()
            entry = self.known[word] = _word_tokens(word)
        return entry

    def tokens(self, text: str | None) -> list[str]:
        """T4: own tokens in order, then the stems that differ."""
        own, stems = [], []
        for word in WORDS.findall(text or ""):
            first, then = self.words(word)
            own += first
            stems += then
        return own + stems


def index_tokens(tokens: list[str]) -> list[str]:
    """Tokens as the index holds them: split at underscores."""
    return [p for t in tokens for p in t.split("_") if p] if any("_" in t for t in tokens) else tokens


_STRINGS = pa.list_(pa.string())


def with_tokens(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds tokens and index_tokens to rows with texts; one Arrow pass, rows stay where they lie."""
    names = df.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyser = Analyser()
        for batch in batches:
            tokens = [analyser.tokens(t) for t in batch.column(text_col).to_pylist()]
            columns = [*batch.columns, pa.array(tokens, _STRINGS), pa.array(map(index_tokens, tokens), _STRINGS)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "tokens", "index_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(add, f"{fields}, tokens array<string>, index_tokens array<string>")


def analyse_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, tokens, index_tokens): stored tokens, and those of the index, split at underscores.

    The tokens are those of ``functions.text.tokens``. Nested higher-order functions took
    about 100 microseconds a word here; Arrow batches with a memory of words take one.
    """
    rows = chunks.where("chunk_id is not null").select(F.col("chunk_id").cast("bigint"), F.col("text").cast("string"))
    return with_tokens(rows).drop("text")


def postings(analysed: DataFrame) -> DataFrame:
    """(term, chunk_id, tf)."""
    return analysed.select("chunk_id", F.explode("index_tokens").alias("term")).groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))


def lengths(analysed: DataFrame) -> DataFrame:
    """(chunk_id, dl)."""
    return analysed.select("chunk_id", F.size("index_tokens").cast("bigint").alias("dl"))


_DOTTED = re.compile(T.DOTTED)
_NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_RARE = re.compile(r"[_0-9]|[a-z].*[A-Z]|[A-Z].*[a-z]|.{12}")
_STOP = frozenset(T.STOPWORDS)


def query_parts(text: str, analyser: Analyser) -> tuple[list[str], list[str]]:
    """A query's content terms and rare identifiers, as ``functions.text`` defines them."""
    terms = dict.fromkeys(map(_stem, analyser.tokens(text)))
    rare = [w for w in WORDS.findall(text) if _RARE.search(w) and w.lower() not in _STOP]
    names = [w for w in _DOTTED.findall(text) if len(w) >= 4 and not _NUMBER.fullmatch(w)]
    return [t for t in terms if t not in _STOP], list(dict.fromkeys(rare + names))


def analyse_queries(queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """(query_id, query, content, ids): content terms and rare identifiers of each query; a null query counts as empty."""

    def analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyser = Analyser()
        for batch in batches:
            parts = [query_parts(t, analyser) for t in batch.column("query").to_pylist()]
            columns = [*batch.columns, pa.array([p[0] for p in parts], _STRINGS), pa.array([p[1] for p in parts], _STRINGS)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "query", "content", "ids"])

    rows = queries.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("query_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("query")
    )
    return rows.mapInArrow(analyse, "query_id bigint, query string, content array<string>, ids array<string>")


def _phrase_postings(phrases: DataFrame, analysed: DataFrame) -> DataFrame:
    """(term, chunk_id, tf) of terms of several parts: the parts side by side, in order.

    Every part votes for the place where its phrase would start; a start with all votes is
    an occurrence. The join is on the part, so its size is that of the parts' postings.
    """
    parts = phrases.select("term", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "part"))
    placed = analysed.select("chunk_id", F.posexplode("index_tokens").alias("at", "part"))
    votes = placed.join(parts, "part").groupBy("term", "n", "chunk_id", (F.col("at") - F.col("k")).alias("start"))
    starts = votes.agg(F.count(F.lit(1)).alias("votes")).where("votes = n")
    return starts.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))


def _asked(queries: DataFrame) -> DataFrame:
    """(query_id, term, parts, key): content terms; the key of a term of several parts is led by an underscore."""
    parts = F.filter(F.split("term", "_+"), lambda p: p != "")
    asked = queries.select("query_id", F.explode("content").alias("term")).withColumn("parts", parts).where(F.size("parts") > 0)
    return asked.withColumn("key", F.when(F.size("parts") == 1, F.col("parts")[0]).otherwise(F.concat(F.lit("_"), "term")))


def score(queries: DataFrame, analysed: DataFrame) -> DataFrame:
    """(query_id, chunk_id, bm25): every chunk with a content term of the query; higher is better.

    A term with underscores is a phrase of its parts. Terms in at least half of all chunks
    weigh next to nothing. Chunks without text count in the statistics. Both joins are on
    the term; the only thing broadcast is one row of totals.
    """
    asked = _asked(queries)
    phrases = asked.where(F.size("parts") > 1).select("term", "parts").distinct()
    wanted = asked.where(F.size("parts") == 1).select("key").distinct()
    found = postings(analysed).select(F.col("term").alias("key"), "chunk_id", "tf").join(wanted, "key", "left_semi")
    found = keep(  # read for the document frequencies and again for the weights
        found.unionByName(_phrase_postings(phrases, analysed).select(F.concat(F.lit("_"), "term").alias("key"), "chunk_id", "tf"))
    )
    df = found.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    dl = lengths(analysed)
    totals = dl.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
    tf = F.col("tf").cast("double")
    part = weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighed = found.join(df, "key").join(dl, "chunk_id").crossJoin(F.broadcast(totals)).select("key", "chunk_id", part.alias("part"))
    return asked.select("query_id", "key").join(weighed, "key").groupBy("query_id", "chunk_id").agg(F.sum("part").alias("bm25"))


class Wanted:
    """What a batch of queries asks for, in the form that travels to the tasks."""

    def __init__(self, rows: list):
        """``rows``: (key, query_id, times), phrases led by an underscore."""
        self.ids = sorted({r.query_id for r in rows})
        place = {q: i for i, q in enumerate(self.ids)}
        self.codes: dict[str, int] = {}
        asked: list[tuple[list, list]] = []
        for r in rows:
            code = self.codes.setdefault(r.key, len(self.codes))
            if code == len(asked):
                asked.append(([], []))
            asked[code][0].append(place[r.query_id])
            asked[code][1].append(float(r.times))
        self.asked = [(np.array(a), np.array(t)) for a, t in asked]
        self.phrases = {key: [p for p in key.split("_") if p] for key in self.codes if key.startswith("_")}
        self.begun: dict[tuple[str, str], list[tuple[str, list[str]]]] = {}  # phrases by their first two parts
        for key, own in self.phrases.items():
            self.begun.setdefault((own[0], own[1]), []).append((key, own))

    @property
    def parts(self) -> set[str]:
        return {p for parts in self.phrases.values() for p in parts}


def occurrences(stream: list[str], parts: list[str]) -> int:
    """How often the parts stand side by side in a stream of tokens, in order."""
    first, n, at, count = parts[0], len(parts), -1, 0
    while True:
        try:
            at = stream.index(first, at + 1)
        except ValueError:
            return count
        count += stream[at : at + n] == parts


def _count_wanted(shared):
    """(chunk_id, dl, keys, tfs) of each text: how often it holds what is wanted, by its distinct words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: Wanted = shared.value
        codes, parts, begun = wanted.codes, wanted.parts, wanted.begun
        beginnings = frozenset(begun)
        analyser, known = Analyser(), {}

        def entry(word: str) -> tuple[int, list[int], list[str]]:
            own, stems = analyser.words(word)
            held = index_tokens(own + stems)
            return len(held), [codes[t] for t in held if t in codes], [t for t in held if t in parts]

        for batch in batches:
            dl, keys, tfs = [], [], []
            for text in batch.column("text").to_pylist():
                n, tf, present = 0, {}, set()
                for word, times in Counter(WORDS.findall(text or "")).items():
                    e = known.get(word)
                    if e is None:
                        if len(known) > 500_000:
                            known.clear()
                        e = known[word] = entry(word)
                    n += e[0] * times
                    for code in e[1]:
                        tf[code] = tf.get(code, 0) + times
                    present.update(e[2])
                if present:
                    stream = index_tokens(analyser.tokens(text))
                    for pair in beginnings.intersection(zip(stream, stream[1:])):
                        for key, own in begun[pair]:
                            if present.issuperset(own):
                                found = occurrences(stream, own)
                                if found:
                                    tf[codes[key]] = found
                dl.append(n)
                keys.append(list(tf))
                tfs.append(list(tf.values()))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk_id"), pa.array(dl, pa.int32()), pa.array(keys, kind), pa.array(tfs, kind)], names=["chunk_id", "dl", "keys", "tfs"]
            )

    return count


def matched(chunks: DataFrame, wanted: Wanted) -> tuple[DataFrame, int, float]:
    """((chunk_id, dl, keys, tfs), number of chunks, mean length): one pass over the texts, no shuffle."""
    shared = chunks.sparkSession.sparkContext.broadcast(wanted)
    rows = chunks.where("chunk_id is not null").select(F.col("chunk_id").cast("bigint"), F.col("text").cast("string"))
    found = keep(rows.mapInArrow(_count_wanted(shared), "chunk_id bigint, dl int, keys array<int>, tfs array<int>"))
    totals = found.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    return found, totals["n"], totals["avgdl"] or 0.0


def _best_of_lists(shared, n: int):
    """Scores of all queries for lists (chunk_id, dl, keys, tfs); a task hands on only what may be among the n best."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, weight, avgdl = shared.value
        ids = np.array(ids, np.int64)
        floor = np.zeros(len(ids))  # the n-th best of a single block so far, for each query
        for batch in batches:
            for at in range(0, batch.num_rows, LIST_ROWS):
                part = batch.slice(at, LIST_ROWS)
                own = part.column("chunk_id").to_numpy(zero_copy_only=False)
                dl = part.column("dl").to_numpy(zero_copy_only=False)
                lists = part.column("keys")
                row = np.repeat(np.arange(len(own)), lists.value_lengths().to_numpy(zero_copy_only=False))
                code = lists.flatten().to_numpy(zero_copy_only=False)
                tf = part.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                worth = weight[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / avgdl))
                order = np.argsort(code, kind="stable")
                row, worth, code = row[order], worth[order], code[order]
                here, starts = np.unique(code, return_index=True)
                spans = list(zip(here.tolist(), starts, np.append(starts[1:], len(code))))
                for first in range(0, len(ids), QUERY_ROWS):
                    last = min(first + QUERY_ROWS, len(ids))
                    s = np.zeros((last - first, len(own)))
                    for k, start, end in spans:
                        places, times = asked[k]
                        lo, hi = np.searchsorted(places, (first, last))
                        if lo < hi:
                            s[places[lo:hi, None] - first, row[None, start:end]] += times[lo:hi, None] * worth[None, start:end]
                    if len(own) > n:
                        kth = np.partition(s, len(own) - n, axis=1)[:, len(own) - n]
                        floor[first:last] = np.maximum(floor[first:last], kth)
                    # what ties with the n-th after rounding stays for the window to decide
                    i, j = np.nonzero((s > 0) & (s >= floor[first:last, None] - 2e-9))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[first + i]), pa.array(own[j]), pa.array(s[i, j])], names=["query_id", "chunk_id", "bm25"]
                    )

    return best


def top_scores(queries: DataFrame, chunks: DataFrame, n: int, source=None) -> DataFrame:
    """(query_id, chunk_id, bm25, pos): the ``n`` best chunks of each query; ties by chunk id.

    Up to ``ASKED_BOUND`` pairs of query and term, which is checked, travel to the tasks. What
    chunks hold of them comes from one pass over ``chunks`` (chunk_id, text), or from
    ``source(wanted)``, which gives the same from a stored index; every task keeps only what
    may be among its n best, so the grid of queries and chunks is never shuffled. More
    pairs take the joins of ``score``; the rows are the same.
    """
    asked = _asked(queries).select(F.col("query_id").cast("bigint").alias("query_id"), "key")
    asked = asked.groupBy("query_id", "key").agg(F.count(F.lit(1)).alias("times"))
    if asked.count() > ASKED_BOUND:
        return top(score(queries, keep(analyse_chunks(chunks))), n)
    wanted = Wanted(asked.orderBy("key", "query_id").collect())
    found, size, avgdl = (source or (lambda w: matched(chunks, w)))(wanted)
    df = np.zeros(len(wanted.codes))
    for code, count in found.select(F.explode("keys").alias("k")).groupBy("k").count().collect():  # at most the wanted terms
        df[code] = count
    idf = np.log((size - df + 0.5) / (df + 0.5))
    weight = np.where(idf <= 0, LEAST_IDF, idf)
    shared = queries.sparkSession.sparkContext.broadcast((wanted.ids, wanted.asked, weight, avgdl))
    lists = found.where(F.size("keys") > 0)
    return top(lists.mapInArrow(_best_of_lists(shared, n), "query_id bigint, chunk_id bigint, bm25 double"), n)


def top(scored: DataFrame, n: int, value: str = "bm25") -> DataFrame:
    """Adds ``pos`` from 1 and keeps the first ``n`` of each query; ties by chunk id."""
    w = Window.partitionBy("query_id").orderBy(F.round(value, 9).desc(), "chunk_id")
    return scored.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)
