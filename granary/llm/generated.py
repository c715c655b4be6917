"""p5 - files nobody wrote by hand, by belief propagation over directory trees.

Every file and directory is a node with one of five labels. A file's path and text give
evidence for each label; directories pass on what their names and files say, and a file's
label is the most likely one given its own evidence, its parents and its siblings. The
graph is a tree, so one pass from the leaves up and one from the roots down is exact;
each level of the trees is one grouped aggregation and one join over all trees.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.plans.runtime import cut

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")

# How a node's label (row) makes the labels of the files and directories in it (columns) likely.
COMPATIBLE = (
    (0.900, 0.030, 0.020, 0.030, 0.020),
    (0.080, 0.860, 0.040, 0.010, 0.010),
    (0.080, 0.100, 0.800, 0.010, 0.010),
    (0.004, 0.004, 0.002, 0.988, 0.002),
    (0.100, 0.020, 0.020, 0.010, 0.850),
)
ROOT_PRIOR = (0.96, 0.01, 0.01, 0.01, 0.01)

# What generators, bundlers and copied sources say about themselves, and names they use.
COMMENT = r"[ \t]*(?:/\*+!?|//+|#+|\*|--+|;+|<!--|\"\"\"|''')"
SAYS_GENERATED = (
    r"do not (?:edit|modify|change)(?! the \w+ of)|(?:auto-?matically|auto-?)[ -]?generated|@generated|<auto-generated"
    r"|generated (?:by|from|with)|nicht bearbeiten|ne pas modifier|no editar|changes will be lost|regenerate with"
)
SAYS_VENDORED = (
    r"copied from \S+@|vendored from|part of \w+ v\d|upstream (?:release|tarball|source|version)|project contributors"
    r"|imported (?:as is|unchanged|verbatim)|local changes: ?(?:none|\w+)"
)
# Every text that says so holds one of these, in lower case; texts without any are not searched further.
HINTS = (
    ("do not edit", "do not modify", "do not change", "generated", "nicht bearbeiten", "ne pas modifier", "no editar", "changes will be lost", "regenerate with"),
    ("copied from ", "vendored from", "part of ", "upstream ", "project contributors", "imported ", "local changes:"),
)
SAYS_BUNDLED = r"/\*!|@license|//[#@] ?sourceMappingURL="
VENDORED_DIRS = (
    r"node_modules|bower_components|third[_-]?party|site-packages|dist-packages|pods|carthage|external|externals|deps|vendored"
)
GENERATED_DIRS = r"generated|__generated__|autogen|gen-src|__snapshots__"
BUILT_DIRS = r"dist|\.next|\.nuxt|coverage|htmlcov"
GENERATED_NAMES = (
    r"_pb2(?:_grpc)?\.pyi?$|\.pb\.\w+$|\.g\.\w+$|[._](?:gen|generated|autogen)\.\w+$|\.designer\.\w+$|\.snap$"
    r"|(?:^|[-_.])(?:package-lock|npm-shrinkwrap|pnpm[._-]lock|composer\.lock|yarn\.lock|poetry\.lock|cargo\.lock|gemfile\.lock|go\.sum)(?:\.json|\.ya?ml)?$"
)
MINIFIED_NAMES = r"[.-]min\.(?:js|css|mjs)$|\.bundle(?:\.[0-9a-f]+)?\.(?:js|css)$|\.(?:js|css)\.map$|\.chunk\.(?:js|css)$|\.[0-9a-f]{8,}\.(?:js|css)$"
BLOB_NAMES = r"_dump\.sql$|\.dump\.sql$"
NOT_CODE = (
    r"(?:^|/)\.[^/]*$|\.(?:env|pem|key|crt|cer|pub|properties|ini|cfg|conf|toml|netrc|npmrc|pgpass|md|rst|txt|adoc|ya?ml)$"
    r"|(?:^|/)(?:id_rsa|id_ed25519|id_ecdsa|id_dsa)[^/]*$|(?:^|/)(?:locales?|i18n|lang|translations)/|(?:^|/)\.env[^/]*$"
)
LONG_LINE = 200
NO_ORD = 1 << 40  # where a chunk without an ord is put
# Closed comments and blank lines, one after the other; an opening mark that then follows is never closed in the text.
_CLOSED = r"(?:\s++|\uFEFF|/\*.*?\*/|<!--.*?-->|\"\"\".*?\"\"\"|'{3}.*?'{3}|(?://|#|--|;|\*)[^\n]*+)*+"
_OPENING, _CLOSING = r"(?:/\*|<!--|\"\"\"|'{3})", r"(?:\*/|-->|\"\"\"|'{3})"
_INSIDE = rf"(?:[^*\-\"']++|(?!{_CLOSING}).)*+(?:\z|{_CLOSING}{_CLOSED}"  # to the end of a comment begun before the text
LEADS = (  # the leading comments of a text that starts outside a comment, and of one that starts inside
    rf"(?s)\A{_CLOSED}(?:{_OPENING}.*)?",
    rf"(?s)\A{_INSIDE}(?:{_OPENING}.*)?)",
)
STAYS_OPEN = (rf"(?s)\A{_CLOSED}{_OPENING}", rf"(?s)\A{_INSIDE}{_OPENING})")


def _each(name: str) -> list[Column]:
    """The five columns of a name, one for each label."""
    return [F.col(f"{name}_{i}") for i in range(len(LABELS))]


def _text_evidence(chunks: DataFrame) -> DataFrame:
    """(f, sums over all texts of a file, where its texts say what it is)."""
    t = F.col("text")
    # what several columns read is computed first, in a projection of its own
    chunks = chunks.select(
        "*",
        F.regexp_replace(t, r"(?m)^.{0,%d}$" % (LONG_LINE - 1), "").alias("_lines"),  # what stays are the long lines
        F.lower(t).alias("_low"),
        *(F.regexp_extract(t, lead, 0).alias(f"_lead_{i}") for i, lead in enumerate(LEADS)),
    )
    chunks = chunks.select("*", *(reduce(or_, (F.contains("_low", F.lit(hint)) for hint in hints)).alias(f"_may_{i}") for i, hints in enumerate(HINTS)))
    lines, leads = F.col("_lines"), [F.col("_lead_0"), F.col("_lead_1")]
    kept = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    line = r"(?im)^" + COMMENT + r"[^\n]*?(?:{})"
    in_head = r"(?is)\A(?:[^\n]*\n){{0,14}}?" + COMMENT + r"[^\n]*?(?:{})"
    to_end = r"[^\n]*+(?:\n(?:[ \t\r]*+(?=\n|\z)|(?:" + COMMENT + r"|[ \t]*+-->)[^\n]*+))*+\s*\z"
    # of a leading block comment every line speaks, of a leading docstring only what its first line says
    in_lead = r"(?im)^(?:" + COMMENT + r"|[ \t]*+(?!\"\"\"|'{{3}}))[^\n]*?(?:{})"
    docstrings = lambda x: F.regexp_replace(x, r"(?s)(\"\"\"|'{3})([^\n]*+)\n.*?(?:\1|\z)", "$1$2\n")
    says = ((F.col("_may_0"), SAYS_GENERATED), (F.col("_may_1"), SAYS_VENDORED))
    both = lambda x, pattern: F.array(*(F.when(hinted, x.rlike(pattern.format(said))).otherwise(False) for hinted, said in says))
    whole = [F.length(x) == F.length(t) for x in leads]
    marks = F.struct(
        both(t, in_head).alias("head"),
        F.array(*(both(docstrings(x), in_lead) for x in leads)).alias("lead"),  # by whether the text starts inside a comment
        F.array(*whole).alias("whole"),
        F.array(*(F.when(all_of_it, t.rlike(x)).otherwise(False) for all_of_it, x in zip(whole, STAYS_OPEN))).alias("open"),
        both(t, line + to_end).alias("tail"),
        both(t, line).alias("any"),
    )
    place = F.struct(F.coalesce("ord", F.lit(NO_ORD)).alias("ord"), F.coalesce("chunk_id", F.lit(-1)).alias("chunk_id"))
    per_chunk = chunks.select(
        "f",
        place.alias("place"),
        F.length(t).alias("chars"),
        F.length(F.regexp_replace(lines, r"\s+", "")).alias("long_chars"),
        (F.length(lines) - F.length(F.replace(lines, F.lit(" "), F.lit("")))).alias("long_spaces"),
        (F.length(lines) - F.length(F.regexp_replace(lines, r"[(){}\[\];=.?:]", ""))).alias("long_marks"),
        (
            kept(
                r"(?m)^[ \t]*(?:(?:[-+]?(?:0x)?[0-9a-fA-F.]++[ \t]*+[,;][ \t]*+){4,}+(?:[-+]?(?:0x)?[0-9a-fA-F.]++)?"
                r"|[\"']?[A-Za-z0-9+/]{60,199}={0,2}[\"']?[ \t]*[+,\\;)]*)[ \t\r]*$"
            )
            # of the long lines, runs of characters that encoded data is made of
            + F.length(lines)
            - F.length(F.regexp_replace(lines, r"[A-Za-z0-9+/=\\]{160,}+", ""))
        ).alias("blob_chars"),
        kept(r"(?mi)^[ \t]*(?:insert into \S+ (?:\([^)\n]*\) )?values[^\n]*|\([^\n]*\)[,;])$").alias("insert_chars"),
        marks.alias("marks"),
        t.rlike(SAYS_BUNDLED).cast("int").alias("bundled"),
        t.contains("-----BEGIN ").cast("int").alias("armoured"),
    )
    # of chunks delivered twice the last counts; rows are narrow here, and an ord that is null is no one's repetition
    kept = [c for c in per_chunk.columns if c != "f"]
    again = F.when(F.col("place.ord") == NO_ORD, F.col("place.chunk_id"))
    once = per_chunk.groupBy("f", F.col("place.ord").alias("ord"), again.alias("again"))
    per_chunk = once.agg(F.max_by(F.struct(*kept), F.col("place.chunk_id")).alias("x")).select("f", "x.*")
    per_file = per_chunk.groupBy("f").agg(
        *(F.sum(c).alias(c) for c in ("chars", "long_chars", "long_spaces", "long_marks", "blob_chars", "insert_chars")),
        F.array_sort(F.collect_list(F.struct("place", "marks"))).alias("marked"),
        F.max("bundled").alias("bundled"),
        F.max("armoured").alias("armoured"),
    )
    return per_file.withColumn("says", _spoken_for(F.col("marked.marks"))).drop("marked")


def _spoken_for(marks: Column) -> Column:
    """Where a file's texts, in their order, hold markers: struct of (start, end, anywhere), each an array by kind."""
    either = lambda a, b: F.zip_with(a, b, lambda x, y: x | y)
    none = F.array(F.lit(False), F.lit(False))

    def step(so_far: Column, x: Column) -> Column:
        inside = F.when(so_far["open"], 1).otherwise(0)
        leading = so_far["leading"]
        return F.struct(
            F.when(leading, either(so_far["start"], F.element_at(x["lead"], inside + 1))).otherwise(so_far["start"]).alias("start"),
            F.when(F.element_at(x["whole"], inside + 1), either(so_far["end"], x["tail"])).otherwise(x["tail"]).alias("end"),
            either(so_far["anywhere"], x["any"]).alias("anywhere"),
            (leading & F.element_at(x["whole"], inside + 1)).alias("leading"),
            (leading & F.element_at(x["whole"], inside + 1) & F.element_at(x["open"], inside + 1)).alias("open"),
        )

    begun = F.struct(
        F.element_at(marks, 1)["head"].alias("start"), none.alias("end"), none.alias("anywhere"), F.lit(True).alias("leading"), F.lit(False).alias("open")
    )
    return F.aggregate(marks, begun, step)


def _file_evidence(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(f, root, parent, depth, e_0..e_4): log-likelihoods of a file's path and text for each label."""
    path = F.lower(F.regexp_replace(F.coalesce("path", F.lit("")), r"\\", "/"))
    known = files.withColumn("p", path).join(texts, "f", "left")
    base = F.regexp_extract("p", r"([^/]*)$", 1)
    chars = F.greatest(F.coalesce("chars", F.lit(0)), F.lit(1))
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / chars
    long_chars = F.greatest(F.coalesce("long_chars", F.lit(0)), F.lit(1))
    minified = (share("long_chars") > 0.3) & (F.col("long_spaces") / long_chars < 0.08) & (F.col("long_marks") / long_chars > 0.12)
    blob = (share("blob_chars") > 0.6) & (F.coalesce("armoured", F.lit(0)) == 0)  # keys and certificates are no data
    dump = share("insert_chars") > 0.7
    at = lambda where, kind: F.col("says")[where][kind]
    only_end = lambda kind: at("end", kind) & ~at("start", kind)
    only_within = lambda kind: at("anywhere", kind) & ~at("start", kind) & ~at("end", kind)
    not_code = F.col("p").rlike(NOT_CODE) & ~base.rlike(GENERATED_NAMES)
    signs = [  # condition, and what it adds to each label's log-likelihood
        (base.rlike(GENERATED_NAMES), (0, 14, 0, 0, 0)),
        (base.rlike(MINIFIED_NAMES), (0, 6, 17, 0, 0)),
        (base.rlike(BLOB_NAMES), (0, 0, 0, 0, 10)),
        (at("start", 0), (0, 14, 0, 0, 0)),
        (at("start", 1), (0, 0, 0, 14, 0)),
        (only_end(0), (0, 11, 0, 0, 0)),
        (only_end(1), (0, 0, 0, 11, 0)),
        (only_within(0), (0, 3, 0, 0, 0)),
        (only_within(1), (0, 0, 0, 2, 0)),
        (minified, (0, 2, 16, 2, 0)),
        (minified & (F.col("bundled") == 1), (0, 0, 1, 0, 0)),
        (blob, (0, 0, 0, 0, 15)),
        (dump & ~blob, (0, 0, 0, 0, 15)),
        (not_code, (24, 0, 0, 0, 0)),
        (F.coalesce("chars", F.lit(0)) == 0, (2, 0, 0, 0, 0)),
    ]
    unsigned = (0.0, -5.0, -8.0, -3.0, -7.0)  # code without any sign: how likely each label writes such
    signs = [(F.coalesce(condition, F.lit(False)), adds) for condition, adds in signs]
    evidence = [
        sum((F.when(condition, F.lit(float(adds[i]))).otherwise(0.0) for condition, adds in signs if adds[i]), F.lit(unsigned[i])).alias(f"e_{i}")
        for i in range(len(LABELS))
    ]
    parent = F.regexp_replace(F.regexp_replace("p", r"/?[^/]*$", ""), r"/+", "/")
    return known.select("f", "root", parent.alias("dir"), *evidence)


def _dir_evidence(dirs: DataFrame) -> DataFrame:
    """Adds e_0..e_4 of the directories' own names."""
    name, before = F.regexp_extract("dir", r"([^/]*)$", 1), F.regexp_extract("dir", r"([^/]*)/[^/]*$", 1)
    # "vendor/<name>" holds other people's code, a module called vendor among one's own does not
    of_vendor = (before == "vendor") & ~F.regexp_replace("dir", r"/?[^/]*/[^/]*$", "").rlike(r"(?:^|/)src$")
    signs = [
        (name.rlike(f"^(?:{VENDORED_DIRS})$"), (0, 0, 0, 12, 0)),
        (of_vendor, (0, 0, 0, 12, 0)),
        (name.rlike(f"^(?:{GENERATED_DIRS})$"), (0, 6, 0, 0, 0)),
        (name.rlike(f"^(?:{BUILT_DIRS})$"), (0, 5, 7, 0, 0)),
    ]
    columns = [
        sum((F.when(condition, F.lit(float(adds[i]))).otherwise(0.0) for condition, adds in signs if adds[i]), F.lit(0.0)).alias(f"e_{i}")
        for i in range(len(LABELS))
    ]
    return dirs.select("root", "dir", "depth", *columns)


N = range(len(LABELS))


def _spoken(nodes: DataFrame, of: str, to: str, *kept: str) -> DataFrame:
    """Adds to_0..to_4: what a child with log-beliefs of_0..of_4 says about its parent's label."""
    near = nodes.select(*kept, F.greatest(*_each(of)).alias("_top"), *_each(of))
    likely = near.select(*kept, *_each(of), *(F.exp(F.col(f"{of}_{i}") - F.col("_top")).alias(f"_p_{i}") for i in N))
    said = [F.log(sum((F.lit(COMPATIBLE[p][i]) * F.col(f"_p_{i}") for i in N), F.lit(0.0))).alias(f"{to}_{p}") for p in N]
    return likely.select(*kept, *_each(of), *said)


def _judged(nodes: DataFrame, parents: DataFrame, of: str, to: str, *kept: str) -> DataFrame:
    """(kept, to_0..to_4): own log-beliefs and what the parent believes without this child's share."""
    met = _spoken(nodes, of, "_m", *kept).join(parents, ["root", "up"])
    rest = met.select(*kept, *_each(of), *((F.col(f"t_{i}") - F.col(f"_m_{i}")).alias(f"_r_{i}") for i in N))
    rest = rest.withColumn("_top", F.greatest(*_each("_r")))
    rest = rest.select(*kept, *_each(of), *(F.exp(F.col(f"_r_{i}") - F.col("_top")).alias(f"_q_{i}") for i in N))
    heard = [F.log(sum((F.lit(COMPATIBLE[p][i]) * F.col(f"_q_{p}") for p in N), F.lit(0.0))) for i in N]
    return rest.select(*kept, *((F.col(f"{of}_{i}") + heard[i]).alias(f"{to}_{i}") for i in N))


def _messages(nodes: DataFrame, of: str) -> DataFrame:
    """(root, dir, m_0..m_4): each parent's sum over its children; partial sums before the shuffle."""
    sent = _spoken(nodes, of, "m", "root", "up")
    return sent.groupBy("root", F.col("up").alias("dir")).agg(*(F.sum(f"m_{i}").alias(f"m_{i}") for i in N))


def label_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, label, confidence, own): the most likely label of every file, and the one by its own evidence alone.

    Labels are handwritten, generated, minified, vendored and blob. Rows with a null
    file_id take no part; repeated rows of a file count once (the smallest path); a null
    path lies in its root's top directory, a file without text is judged by its path, an
    empty one stays handwritten unless its place says otherwise. Of chunks delivered
    twice, the one with the larger chunk_id counts. Settings, keys, locales and notes are handwritten. Extra columns
    are ignored, and empty tables give an empty result.
    """
    own = files.select(
        F.col("file_id").cast("bigint").alias("f"), F.col("root_id").cast("bigint").alias("root"), F.col("path").cast("string").alias("path")
    ).where("f is not null")
    own = own.groupBy("f").agg(F.min(F.struct("path", "root")).alias("x")).select("f", F.coalesce("x.root", F.lit(-1)).alias("root"), "x.path")
    pieces = chunks.select(
        F.col("file_id").cast("bigint").alias("f"), F.col("ord").cast("bigint"), F.col("chunk_id").cast("bigint"), F.col("text").cast("string")
    ).where("f is not null and text is not null")
    leaves = _file_evidence(own, _text_evidence(pieces))
    alone = [F.col(f"e_{i}") + math.log(ROOT_PRIOR[i]) for i in N]
    leaves = cut(leaves.withColumn("own", _likeliest(alone)))

    # every directory on the way to a file, the root's top directory "" included
    parts = F.filter(F.split("dir", "/"), lambda x: x != "")
    on_way = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda n: F.array_join(F.slice("parts", 1, n), "/"))
    found = leaves.select("root", "dir").distinct().withColumn("parts", parts)
    dirs = found.select("root", F.explode(on_way).alias("dir")).distinct()
    dirs = _dir_evidence(dirs.withColumn("depth", F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))))
    leaves = leaves.withColumn("up", F.array_join(parts, "/"))
    heard = _messages(leaves, "e")
    from_files = [F.coalesce(F.col(f"m_{i}"), F.lit(0.0)) for i in N]
    dirs = dirs.join(heard, ["root", "dir"], "left").select(
        "root", "dir", "depth", F.regexp_replace("dir", r"/?[^/]*$", "").alias("up"), *((F.col(f"e_{i}") + from_files[i]).alias(f"b_{i}") for i in N)
    )
    dirs = cut(dirs)
    deepest = dirs.agg(F.max("depth")).first()[0] or 0

    levels = {deepest: dirs.where(F.col("depth") == deepest)}
    for depth in range(deepest - 1, -1, -1):  # leaves to roots
        here = dirs.where(F.col("depth") == depth).join(_messages(levels[depth + 1], "b"), ["root", "dir"], "left")
        levels[depth] = cut(
            here.select("root", "dir", "up", *((F.col(f"b_{i}") + F.coalesce(F.col(f"m_{i}"), F.lit(0.0))).alias(f"b_{i}") for i in N))
        )
    total = levels[0].select("root", "dir", *((F.col(f"b_{i}") + math.log(ROOT_PRIOR[i])).alias(f"t_{i}") for i in N))
    beliefs = total
    for depth in range(1, deepest + 1):  # roots to leaves
        total = cut(_judged(levels[depth], total.withColumnRenamed("dir", "up"), "b", "t", "root", "up", "dir").drop("up"))
        beliefs = beliefs.unionByName(total)
    # a filter on the label must not be pushed into the sums above: it would repeat them for every use of a belief
    judged = cut(_judged(leaves, beliefs.withColumnRenamed("dir", "up"), "e", "s", "root", "up", "f", "own"))
    best = F.greatest(*_each("s"))
    weight = sum((F.exp(x - best) for x in _each("s")), F.lit(0.0))
    return judged.select(F.col("f").alias("file_id"), _likeliest(_each("s")).alias("label"), (1 / weight).alias("confidence"), "own")


def _likeliest(beliefs: list[Column]) -> Column:
    best = F.greatest(*beliefs)
    return F.coalesce(*(F.when(x == best, F.lit(name)) for x, name in zip(beliefs, LABELS)))


def not_handwritten(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("label") != "handwritten").select("file_id")
