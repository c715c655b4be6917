"""Which files are taken up, and their listing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.config import Config

# Extensions, names without one, and directories that are left out.
EXTENSIONS = (
    ".js .mjs .cjs .jsx .ts .mts .cts .tsx .py .pyi .go .rs .java .kt .kts .scala .c .h .cc .cpp .cxx .hpp .cs "
    ".rb .php .swift .lua .pl .pm .r .jl .ex .exs .erl .hrl .clj .cljs .hs .ml .fs .fsx .dart .sh .bash .zsh .fish .ps1 "
    ".md .mdx .txt .rst .adoc .json .jsonc .yaml .yml .toml .ini .cfg .xml .csv .html .htm .css .scss .less .vue .svelte "
    ".sql .graphql .gql .proto .tf .cmake .dockerfile .pdf .docx"
).split()
SPECIAL_NAMES = (
    "dockerfile makefile cmakelists.txt rakefile gemfile podfile justfile taskfile brewfile .gitignore .dockerignore .env.example"
).split()
EXCLUDED_DIRS = (
    "node_modules .git .svn .hg dist build out coverage .next .nuxt .cache .turbo .vercel .venv venv env "
    "__pycache__ .pytest_cache .mypy_cache target vendor bin obj .idea .vscode .DS_Store tmp temp logs"
).split()


def extensions(config: Config) -> list[str]:
    """The default list with the settings' additions and removals, dots added."""
    dotted = lambda names: [n if n.startswith(".") else f".{n}" for n in names]
    removed = set(dotted(config.exclude_extensions))
    return sorted({*EXTENSIONS, *dotted(config.extra_extensions)} - removed)


def glob_to_regex(pattern: str) -> str:
    """A glob as an anchored regular expression; without a slash it is held against the last name alone."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(glob_to_regex(p)[1:-1].removeprefix("(?:.*/)?") for p in pattern[i + 1 : end].split(",")) + ")", end + 1
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return ("^" if "/" in pattern else "^(?:.*/)?") + out + "$"


def normal_path(path: Column | str) -> Column:
    return F.regexp_replace(F.col(path) if isinstance(path, str) else path, r"\\", "/")


def wanted(path: Column, config: Config) -> Column:
    """S2-S5 for one relative path: known type or name, no excluded directory on the way, no exclude pattern."""
    base = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    ext = F.regexp_extract(base, r"^.+(\.[^.]*)$", 1)
    dirs = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    kept = (base.isin(SPECIAL_NAMES) | ext.isin(extensions(config))) & ~F.arrays_overlap(dirs, F.array(*map(F.lit, EXCLUDED_DIRS)))
    ways = F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda n: F.array_join(F.slice(F.split(path, "/"), 1, n), "/"))
    for pattern in config.exclude_patterns:
        rule = glob_to_regex(pattern)
        hit = lambda w: w.rlike(rule) | F.concat(w, F.lit("/")).rlike(rule)  # noqa: B023, E731
        kept = kept & ~F.exists(F.slice(ways, 1, F.size(ways) - 1), hit) & ~path.rlike(rule)
    return kept


def listing(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """(path, size, mtime, content) of the files to index under a root; a single file is taken as it is.

    Size limits reach the scan; a NUL among the first 8192 bytes marks a binary file (S7),
    other than .pdf and .docx.
    """
    config = config or Config()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    whole = F.regexp_replace("path", r"^file:/*", "/")
    base = "/" + root.split("://", 1)[-1].removeprefix("file:").strip("/")
    relative = F.when(whole == base, F.regexp_extract(whole, r"([^/]*)$", 1)).otherwise(F.expr(f"substring(p, {len(base) + 2})"))
    rows = found.withColumn("p", whole).withColumn("single", F.col("p") == base).withColumn("rel", relative)
    head = F.decode(F.substring("content", 1, 8192), "ISO-8859-1")
    binary = (F.locate("\u0000", head) > 0) & ~F.lower("rel").rlike(r"\.(?:pdf|docx)$")
    fits = F.col("length").between(1, config.max_file_bytes) & wanted(F.col("rel"), config) & ~binary
    return rows.where(F.col("single") | fits).select(
        F.col("rel").alias("path"), F.col("length").alias("size"), (F.col("modificationTime").cast("double") * 1000).alias("mtime"), "content"
    )
