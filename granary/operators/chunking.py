"""Line chunks at natural breaks (G1-G3): Arrow batches, rows where they lie."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import BLANK, BLANK_CHARS, col

# Fixed value: what a line that starts a construct looks like.
CONSTRUCT = (
    r"^([BLANK]*(export[BLANK]+)?(default[BLANK]+)?(async[BLANK]+)?(function|class|interface|enum|struct|impl|trait|def |fn |func "
    r"|public |private |protected |static |package |func\()|#{1,6}[BLANK]|[BLANK]*/\*\*|[BLANK]*\"\"\"|[BLANK]*''')"
).replace("[BLANK]", f"[{BLANK}]")
MAX_CHARS = 6000
_PY_BLANK = BLANK.replace("\\x0B", "\\v")
_CONSTRUCT = re.compile(CONSTRUCT.replace(BLANK, _PY_BLANK))
_BLANK_LINE = re.compile(f"[{_PY_BLANK}]*")


def is_break(line: Column | str, before: Column | str) -> Column:
    """A chunk may start at a line after a blank one, or at one that starts a construct and isn't blank."""
    blank = lambda c: col(c).rlike(f"^[{BLANK}]*$")
    return F.when(col(before).isNull(), False).when(blank(before), True).otherwise(col(line).rlike(CONSTRUCT) & ~blank(line))


def break_points(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, line_no): all break lines of each text, counted from 0; trailing blank lines are dropped first."""
    text = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = text.withColumn("_size", F.length(F.rtrim("text", F.lit(BLANK_CHARS))))
    rest = F.regexp_extract(F.expr("substring(text, _size + 1)"), r"\A[^\n]*+", 0)  # blanks at the end of the last line stay
    kept = F.concat(F.expr("substring(text, 1, _size)"), rest)
    lines = text.select(F.col(id_col), F.posexplode(F.split(kept, "\n")).alias("line_no", "line"))
    before = F.lag("line").over(Window.partitionBy(id_col).orderBy("line_no"))
    return lines.withColumn("before", before).where(is_break("line", "before")).select(id_col, "line_no")


def chunk_text(text: str | None, target: int = 80, least: int = 25, overlap: int = 8, whole: bool = True) -> list[tuple[str, int, int]]:
    """(text, first line, last line) of each chunk; lines from 1, both ends included.

    A chunk ends at the last break between ``least`` and ``target`` lines, or at the
    target; while it holds more than 6,000 characters its lines are halved, and a single
    longer line is cut there: its rest follows in further chunks of the same line, or is
    dropped if not ``whole``. The next chunk starts ``overlap`` lines before its end.
    """
    lines = (text or "").split("\n")
    blank = [_BLANK_LINE.fullmatch(line) is not None for line in lines]
    size = next((i + 1 for i in range(len(lines) - 1, -1, -1) if not blank[i]), 0)
    starts = [i for i in range(1, size) if blank[i - 1] or (not blank[i] and _CONSTRUCT.match(lines[i]))]
    ends = [0, *accumulate(len(line) + 1 for line in lines[:size])]
    out, at = [], 0
    while at < size:
        stop = min(at + target, size)
        if stop < size:
            i = bisect_right(starts, at + target) - 1
            if i >= 0 and starts[i] >= max(at + least, at + 1):
                stop = starts[i]
        while stop - at > 1 and ends[stop] - ends[at] - 1 > MAX_CHARS:
            stop = at + (stop - at) // 2
        piece = "\n".join(lines[at:stop])
        for first in range(0, len(piece) if whole else 1, MAX_CHARS):
            part = piece[first : first + MAX_CHARS]
            if not all(map(_BLANK_LINE.fullmatch, part.split("\n"))):
                out.append((part, at + 1, stop))
        if stop >= size:
            break
        at = max(at + 1, stop - overlap)
    return out


def chunk_lines(df: DataFrame, id_col: str, text_col: str = "text", target: int = 80, least: int = 25, overlap: int = 8, whole: bool = True) -> DataFrame:
    """(id_col, ord, start_line, end_line, text); null, empty and blank texts give no row."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (i, n, first, last, piece)
                for i, text in zip(frame["id"], frame["text"])
                for n, (piece, first, last) in enumerate(chunk_text(text, target, least, overlap, whole))
            ]
            yield pd.DataFrame(rows, columns=["id", "ord", "start_line", "end_line", "text"]).astype({"id": "Int64"})

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(cut, "id bigint, ord int, start_line int, end_line int, text string")
    return out.withColumnRenamed("id", id_col)


def _common_run(before: list[str], after: list[str]) -> int:
    """How many lines, at most, both end ``before`` and begin ``after``; in time linear in the lines."""
    fallback, k = [0] * len(after), 0
    for i in range(1, len(after)):
        while k and after[i] != after[k]:
            k = fallback[k - 1]
        k += after[i] == after[k]
        fallback[i] = k
    k = 0
    for line in before[-len(after) :]:
        while k and (k == len(after) or line != after[k]):
            k = fallback[k - 1]
        k += line == after[k]
    return k


def joined(texts: list[str]) -> str:
    """The text that consecutive chunks were cut from: each pair overlaps in its longest common run of lines.

    A chunk of a text with \\r\\n line ends has lost the \\r of its last line, so lines are compared without.
    """
    out: list[str] = []
    bare: list[str] = []
    for text in texts:
        lines = text.split("\n")
        plain = [line.removesuffix("\r") for line in lines]
        k = _common_run(bare, plain) if out else 0
        if out and not k and len(out) > 1 and out[-2].endswith("\r") and not out[-1].endswith("\r"):
            out[-1] += "\r"
        del out[len(out) - k :], bare[len(bare) - k :]
        out += lines
        bare += plain
    return "\n".join(out)
