"""p8 - how demanding each document's English prose is, on the graders' scale.

The words of all prose are ranked by frequency; a document's coverage rank is the size
of the smallest frequency-ranked vocabulary that covers a fixed share of its words. With
the length of its sentences and words it is calibrated on the graded documents: class
means and a pooled covariance are sums in SQL, and the level is the likeliest class.
"""

from __future__ import annotations

import html
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.leakage import RUN, WuManber, table_of, words_of
from granary.plans.runtime import collected, free, keep

MIN_WORDS = 100
SHARE = 0.9
LEVELS = (1, 2, 3, 4)
BROADCAST_WORDS = 500_000
HOT_WORDS = 1_000  # ranks that are always broadcast, as their words have a row in almost every document
PROFILE_LABELS = ("en", "eng", "english")  # of the documents that the profile is fitted on
STEPS = 4  # decimals of the scores that its floors are taken from
MARGIN = 0.5  # how far below the profile's own thousandth part a text must lie to count as another language
ITEM_CHARS = 16_000_000

# Frequent words that tell the languages of this kind of corpus apart.
ENGLISH = frozenset(
    "the a an and or of to is are was were be in on for with that this it as by from not can may will when if which their "
    "its do does has have at before after because although such than then first please most each every you they we he she "
    "i these those would should must no so but while until under whose any".split()
)
OTHER = frozenset(
    "der die das und ein eine einen einem einer kein keine jeder jede dieser diese ist sind nicht mit von den dem auch wird "
    "werden oder wenn weil aber sobald während zu im auf für le la les un une des du et est sont ce cette ces chaque aucun "
    "aucune que qui dans pour avec sur pas mais quand lorsque parce ou el los las una unos unas y es son este esta estos cada "
    "ningún ninguna que en para con por pero cuando porque del al se lo il gli della che non per uno".split()
)

_TAG_BLOCK = re.compile(r"<(script|style|pre|code|table|ul|ol|h[1-6]|head|title|nav)\b[^>]*>.*?</\1\s*>", re.S | re.I)
_TAG_BREAK = re.compile(r"</?(?:p|div|br|section|article|body|html|blockquote|tr|li)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>", re.I)
_QUOTE = re.compile(r"^\s*(?:>\s?)+")
_ENDED = re.compile(r"[.!?…:;]\W*$")
_FENCE = re.compile(r"^\s*(```|~~~)")
_NOT_PROSE = re.compile(
    r"^\s*(?:#{1,6}\s|[-*+•]\s+|\d+[.)]\s|\||\+[-=+]+\+|={3,}$|-{3,}$|\*{3,}$|//|/\*|\*/|#!|@\w[\w.\-]* wrote:|On .{5,80} wrote:"
    r"|(?:From|To|Cc|Subject|Date|Status|Author|Tags?|Labels?|Version|Re|Priority|Assignee|Reporter|Q|A):\s*\S{0,40}.{0,60}$"
    r"|[A-Za-z_][\w.\-]*\s*[:=]\s*\S*$|\[?\d{4}-\d\d-\d\d[T ]|\[?\d\d:\d\d(?::\d\d)?|(?:INFO|WARN|ERROR|DEBUG|TRACE|FATAL)\b|at [\w.$]+\()"
)
_SYMBOL = re.compile(r"[{}\[\]();=]")
_CODE = re.compile(
    r"[{};]\s*$|=>|==|!=|\)\s*[:{]\s*$|^\s*[)}\]]+[,;]?\s*$|^\s*[\w.\[\]\"']+\s*(?:=|\+=|:=)\s|^\s*[\w.]+\([^)]*\)\s*;?$"
    r"|^\s*(?:import|from|def|class|return|const|let|var|func|function|if|for|while|package|public|private|export|select|create|"
    r"insert|except|assert|raise|use|fn|struct|type|local|echo|await|elif|group by|and [a-z]\.)\b[^.]*[(){}\[\]=;]"
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_ASCII_WORD = re.compile(r"[a-z]+(?:'[a-z]+)?")  # the same in lower-case ASCII
_LINK = re.compile(r"\w+://\S+|\S+@\S+\.\w+|`[^`]*`")
_END = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+(?=[\"'“‘(\[]?[^\W\d_a-z])|(?<=[。！？])")
_ASCII_END = re.compile(r"[.!?][\"')\]]*\s+(?=[\"'(\[]?[A-Z])")  # the same in ASCII, its mark included


def _sentences(paragraph: str) -> list[str]:
    """A paragraph cut at the ends of its sentences."""
    if not paragraph.isascii():
        return _END.split(paragraph)
    out, at = [], 0
    for end in _ASCII_END.finditer(paragraph):
        out.append(paragraph[at : end.start() + 1])
        at = end.end()
    return [*out, paragraph[at:]]


def prose_paragraphs(text: str) -> list[str]:
    """Running text of a document: markup, code, logs, tables, lists and headings left out."""
    text = text.replace("\r\n", "\n").replace("\ufeff", "").replace("\u00ad", "").replace("\u200b", "")
    if "<" in text and _TAG.search(text):
        text = _TAG_BLOCK.sub("\n\n", text)
        text = html.unescape(_TAG.sub(" ", _TAG_BREAK.sub("\n\n", text)))
    out, held, fenced = [], [], False
    fences = "```" in text or "~~~" in text
    for line in [*text.split("\n"), ""]:
        if fences and _FENCE.match(line):
            fenced = not fenced
            line = ""
        if fenced:
            continue
        if line[:2].lstrip()[:1] == ">":
            line = _QUOTE.sub("", line)
        bare = line.strip()
        if (
            not bare
            or line.startswith(("    ", "\t"))
            or _NOT_PROSE.match(bare)
            or (_SYMBOL.search(bare) is not None and _CODE.search(bare) is not None)
        ):
            if held:
                out.append(" ".join(held))
                held = []
            continue
        held.append(bare)
    return out


def english_sentences(text: str | None) -> list[list[str]]:
    """Words, in lower case, of every English sentence in the prose of a text."""
    out = []
    for paragraph in prose_paragraphs(text or ""):
        if "://" in paragraph or "@" in paragraph or "`" in paragraph:
            paragraph = _LINK.sub(" ", paragraph)
        sentences, all_english, all_other = [], 0, 0
        for sentence in _sentences(paragraph):
            if not sentence or not _ENDED.search(sentence[-6:]):
                continue  # a title, a name, a cut-off line
            ascii_only = sentence.isascii()
            words = _ASCII_WORD.findall(sentence.lower()) if ascii_only else _WORD.findall(sentence.lower().replace("’", "'"))
            if len(words) < 3:
                continue
            english = sum(map(ENGLISH.__contains__, words))
            other = sum(map(OTHER.__contains__, words))
            all_english += english
            all_other += other
            if ascii_only or sum(map(str.isascii, words)) > 0.8 * len(words):
                sentences.append((words, english, other))
        sure = all_english > 2 * all_other
        out += [words for words, english, other in sentences if english > other or (english == other and sure)]
    return out


class Profile:
    """How likely letters follow each other in English: trigrams of words, smoothed."""

    def __init__(self, counts: dict[str, int], floors: tuple[float, float] = (0.0, 0.0)):
        self.counts, self.floors = counts, floors
        self.total = sum(counts.values()) + 0.5 * 20_000
        self.worth = _Worth(self)

    def word(self, word: str) -> float:
        return sum(math.log((self.counts.get(g, 0) + 0.5) / self.total) for g in trigrams(word))

    def score(self, words: list[str]) -> float:
        """Mean log-likelihood of a trigram."""
        return sum(map(self.word, words)) / max(1, sum(map(len, words)))

    def english(self, sentences: list[list[str]]) -> list[list[str]]:
        """The sentences that may be English; none if what is left of the text may not be as a whole."""
        worth, kept, above, letters = self.worth.__getitem__, [], 0.0, 0
        for words in sentences:
            beyond = sum(map(worth, words))
            if beyond >= 0:
                kept.append(words)
                above += beyond
                letters += sum(map(len, words))
        return kept if above + (self.floors[0] - self.floors[1]) * letters >= 0 else []


class _Worth(dict):
    """By how much each word lies above the floor of a sentence, all its trigrams together; remembered."""

    def __init__(self, profile: Profile):
        super().__init__()
        self.profile = profile

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = self.profile.word(word) - self.profile.floors[0] * len(word)
        return value

    def __reduce__(self):  # travels without what it remembers
        return (_Worth, (self.profile,))


def trigrams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(word))]


_READ = "doc_id bigint, english boolean, prose string, grams array<string>, counts array<bigint>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The English sentences of each document, a line each; a last row has the trigrams of those labelled English."""
    for batch in batches:
        rows, counted = [], Counter()
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "english", "text"))
        for doc, english, text in zip(*columns):
            sentences = english_sentences(text)
            if sentences:
                rows.append((doc, english, "\n".join(map(" ".join, sentences)), None, None))
                if english:
                    for words in sentences:
                        counted.update(words)
        grams: Counter = Counter()
        for word, n in counted.items():
            for g in trigrams(word):
                grams[g] += n
        rows.append((None, None, None, list(grams), list(grams.values())))
        types = (pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "english", "prose", "grams", "counts"]
        )


def read_sentences(documents: DataFrame) -> DataFrame:
    """What ``_read`` finds in the documents whose id and text are not null; each text is searched once."""
    lang = F.lower(F.col("lang").cast("string")) if "lang" in documents.columns else F.lit(None).cast("string")
    docs = documents.select(
        F.col("doc_id").cast("bigint"), F.coalesce(lang.isin(*PROFILE_LABELS), F.lit(False)).alias("english"), F.col("text").cast("string")
    )
    return docs.where("doc_id is not null and text is not null").mapInArrow(_read, _READ)


def fit_profile(read: DataFrame) -> Profile | None:
    """The trigrams of all documents whose lang says English, from what ``read_sentences`` found.

    Languages that the word lists do not know share many short words with English, not its
    letters. A sentence and a document must score no worse than a thousandth of all those
    documents' own, less ``MARGIN``; scores count in steps of 1e-4, so that a histogram has
    them all. Without a lang column or such documents there is no profile.
    """
    grams = read.where("doc_id is null").select(F.explode(F.arrays_zip("grams", "counts")).alias("u"))
    counts = {r.g: r.n for r in grams.groupBy(F.col("u.grams").alias("g")).agg(F.sum("u.counts").alias("n")).collect()}
    if not counts:
        return None
    fitted = Profile(counts)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = fitted.worth.__getitem__  # without floors as yet
        for batch in batches:
            seen: Counter = Counter()
            for prose in batch.column("prose").to_pylist():
                above, letters = 0.0, 0
                for sentence in prose.split("\n"):
                    words = sentence.split(" ")
                    own, long = sum(map(worth, words)), len(sentence) - len(words) + 1
                    seen[0, round(own / long, STEPS)] += 1
                    above += own
                    letters += long
                seen[1, round(above / letters, STEPS)] += 1
            columns = [[k for k, _ in seen], [x for _, x in seen], list(seen.values())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int64()))], names=["kind", "score", "n"]
            )

    rated = read.where("english").select("prose").mapInArrow(rate, "kind int, score double, n bigint")
    rated = rated.groupBy("kind", "score").agg(F.sum("n").alias("n")).groupBy("kind")
    floors = {r.kind: r.least - MARGIN for r in rated.agg(F.percentile("score", F.lit(0.001), F.col("n")).alias("least")).collect()}
    return Profile(counts, (floors[0], floors[1]))


class _Parts(dict):
    """The words that held-out items are matched by, for each word of a sentence; remembered."""

    def __missing__(self, word: str) -> list[str]:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = words_of(word) or [word]
        return value


_PARTS = _Parts()  # of this worker process


def _without_passages(sentences: list[list[str]], matcher: WuManber | None) -> list[list[str]]:
    """Sentences of which no more than half lies in a passage of the held-out items."""
    if matcher is None or not sentences:
        return sentences
    flat = [part for words in sentences for word in words for part in _PARTS[word]]
    ends = matcher.places(flat)
    if not ends:
        return sentences
    owner = [i for i, words in enumerate(sentences) for word in words for _ in _PARTS[word]]
    covered = Counter()
    taken = 0
    for end in ends:
        for k in range(max(taken, end - matcher.run + 1), end + 1):
            covered[owner[k]] += 1
        taken = end + 1
    return [words for i, words in enumerate(sentences) if covered[i] <= len(words) / 2]


_SCHEMA = "doc_id bigint, n_words int, n_sentences int, n_letters bigint, words array<string>, counts array<int>"


def _extract(items, profile: Profile | None = None):
    key = uuid.uuid4().hex

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = items.value
        matcher = table_of(key, held, RUN) if held else None
        for batch in batches:
            rows = []
            for doc, prose in zip(batch.column("doc_id").to_pylist(), batch.column("prose").to_pylist()):
                sentences = [sentence.split(" ") for sentence in prose.split("\n")]
                if profile is not None:
                    sentences = profile.english(sentences)
                sentences = _without_passages(sentences, matcher)
                n = sum(map(len, sentences))
                if not n:
                    continue
                counted = Counter(word for words in sentences for word in words)
                letters = sum(len(word) * c for word, c in counted.items())
                rows.append((doc, n, len(sentences), letters, list(counted), list(counted.values())))
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["doc_id", "n_words", "n_sentences", "n_letters", "words", "counts"],
            )

    return extract


def _ranks(uses: DataFrame) -> DataFrame:
    """(word, rank): 1 + the number of more frequent words; ties share a rank.

    Ranks come from the histogram of frequencies, which stays small, so no task ever
    sorts the whole vocabulary.
    """
    often = uses.groupBy("word").agg(F.sum("n").alias("often"))
    steps = often.groupBy("often").agg(F.count(F.lit(1)).alias("words"))
    w = Window.orderBy(F.desc("often")).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("often", (F.coalesce(F.sum("words").over(w), F.lit(0)) + 1).alias("rank"))
    return often.join(steps, "often").select("word", "rank")


def _with_ranks(uses: DataFrame, ranks: DataFrame) -> DataFrame:
    """Adds each word's rank: by broadcast within a checked bound; beyond it the hot words by broadcast, the rest by a join."""
    if ranks.count() <= BROADCAST_WORDS:
        return uses.join(F.broadcast(ranks), "word")
    hot = ranks.orderBy("rank", "word").limit(HOT_WORDS)
    met = uses.join(F.broadcast(hot), "word", "left")
    rest = met.where("rank is null").drop("rank").join(ranks, "word")
    return met.where("rank is not null").unionByName(rest)


def document_features(
    documents: DataFrame, items: DataFrame | None = None, min_words: int = MIN_WORDS, share: float = SHARE
) -> DataFrame:
    """(doc_id, coverage_rank, words_per_sentence, letters_per_word) of documents with enough prose.

    Passages of ``items`` (held-out material of at most ``ITEM_CHARS`` characters, which is
    checked) are left out. Null ids and texts take no part; repeated rows count once each
    in the statistics but give one row; extra columns are ignored.
    """
    spark = documents.sparkSession
    held: list[tuple[int, str]] = []
    if items is not None:
        kept = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("item_id is not null and text is not null")
        size = kept.agg(F.sum(F.length("text"))).first()[0] or 0
        if size > ITEM_CHARS:
            raise ValueError(f"held-out items of {size} characters; at most {ITEM_CHARS} are taken along")
        held = [tuple(r) for r in kept.collect()]
    with collected() as passing:
        read = keep(read_sentences(documents))
    found = read.where("doc_id is not null").select("doc_id", "prose")
    prose = keep(found.mapInArrow(_extract(spark.sparkContext.broadcast(held), fit_profile(read)), _SCHEMA))
    free(spark, passing)
    uses = lambda rows: rows.select("doc_id", F.explode(F.arrays_zip("words", "counts")).alias("u")).select(
        "doc_id", F.col("u.words").alias("word"), F.col("u.counts").alias("n")
    )
    ranks = keep(_ranks(uses(prose)))  # of all prose, that of short documents too
    prose = prose.where(F.col("n_words") >= min_words)
    w = Window.partitionBy("doc_id").orderBy("rank", "word").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("doc_id")
    covered = (
        _with_ranks(uses(prose), ranks)
        .withColumn("so_far", F.sum("n").over(w))
        .withColumn("all", F.sum("n").over(whole))
        .where(F.col("so_far") >= share * F.col("all"))
        .groupBy("doc_id")
        .agg(F.min("rank").alias("coverage_rank"))
    )
    complexity = prose.groupBy("doc_id").agg(
        F.first(F.col("n_words") / F.col("n_sentences")).alias("words_per_sentence"),
        F.first(F.col("n_letters") / F.col("n_words")).alias("letters_per_word"),
    )
    return complexity.join(covered, "doc_id").select("doc_id", "coverage_rank", "words_per_sentence", "letters_per_word")


FEATURES = ("x_0", "x_1", "x_2")


def _scaled(features: DataFrame) -> DataFrame:
    return features.select(
        "doc_id",
        F.log(F.col("coverage_rank").cast("double") + 1).alias("x_0"),
        F.log("words_per_sentence").alias("x_1"),
        F.col("letters_per_word").alias("x_2"),
    )


def consensus(grades: DataFrame) -> DataFrame:
    """(doc_id, level): the rounded median of a document's distinct marks; repeated rows count once."""
    marks = grades.select(
        F.col("doc_id").cast("bigint"), F.col("grader_id").cast("bigint"), F.col("grade").cast("int"), F.col("graded_at")
    ).where("doc_id is not null and grade between 1 and 4")
    return marks.distinct().groupBy("doc_id").agg(F.floor(F.median("grade") + 0.5).cast("int").alias("level"))


def calibrate(features: DataFrame, levels: DataFrame) -> list[tuple[int, np.ndarray, float]]:
    """(level, weights, constant) of each class: a linear discriminant from sums over the graded documents.

    Only a few sums per class reach the driver. Without grades, classes are cut at
    fixed standard values.
    """
    graded = _scaled(features).join(levels, "doc_id")
    products = [F.sum(F.col(a) * F.col(b)).alias(f"s_{i}_{j}") for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if i <= j]
    sums = graded.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(f"m_{i}") for i, x in enumerate(FEATURES)), *products
    ).orderBy("level").collect()
    d, total = len(FEATURES), sum(r["n"] for r in sums)
    within, means = np.zeros((d, d)), {}
    for r in sums:
        mean = np.array([r[f"m_{i}"] for i in range(d)]) / r["n"]
        second = np.array([[r[f"s_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        within += second - r["n"] * np.outer(mean, mean)
        means[r["level"]] = (mean, r["n"])
    if not means:
        means = {k: (np.array([5.0 + k * 0.6, 1.6 + 0.45 * k, 3.4 + 1.0 * k]), 1) for k in LEVELS}
        total, within = 4, np.eye(d)
    inverse = np.linalg.inv(within / max(total - len(means), 1) + np.diag([0.02, 0.01, 0.05]))
    out = []
    for level, (mean, n) in means.items():
        weights = inverse @ mean
        out.append((level, weights, float(-0.5 * mean @ weights + math.log((n + 1) / (total + len(means))))))
    return out


def _scores(classes: list[tuple[int, np.ndarray, float]]) -> Column:
    """The likeliest level of a row of scaled features; ties go to the lower one."""
    scores = [(level, sum((F.col(f) * float(w) for f, w in zip(FEATURES, weights)), F.lit(constant))) for level, weights, constant in classes]
    best = F.greatest(*(s for _, s in scores)) if len(scores) > 1 else scores[0][1]
    return F.coalesce(*(F.when(s >= best, F.lit(k)) for k, s in scores)).cast("int")


def held_out(documents: DataFrame, grades: DataFrame, items: DataFrame | None = None, folds: int = 5) -> DataFrame:
    """(fold, n, hits): how many graded documents get their consensus level from the grades of the other folds."""
    features, levels = keep(document_features(documents, items)), consensus(grades)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int")
    out = None
    for k in range(folds):
        classes = calibrate(features, levels.where(fold != k))
        seen = _scaled(features).where(fold == k).withColumn("guess", _scores(classes)).join(levels, "doc_id")
        part = seen.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("guess") == F.col("level")).alias("hits")).select(F.lit(k).alias("fold"), "n", "hits")
        out = part if out is None else out.unionByName(part)
    return out


def reading_levels(
    documents: DataFrame, grades: DataFrame, items: DataFrame | None = None, min_words: int = MIN_WORDS, share: float = SHARE
) -> DataFrame:
    """(doc_id, reading_level) of every document with at least ``min_words`` words of English prose.

    Equal texts get equal levels; ties between classes go to the lower level. Marks that
    are null, out of range or repeated are passed over, late ones count; with no marks at
    all fixed class centres are used.
    """
    features = keep(document_features(documents, items, min_words, share))
    classes = calibrate(features, consensus(grades))
    return _scaled(features).select("doc_id", _scores(classes).alias("reading_level"))
