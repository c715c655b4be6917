"""p3 - oversized items cut into pieces under the limits, at natural boundaries.

A text's possible cuts carry strengths (after a blank line, before a construct, at a
line end, inside a long line after white space or punctuation). A sparse table answers
"the strongest cut in this range, the rightmost of equals" in constant time, so each
piece takes the best cut of the window its limits permit and the next one starts some
lines before that cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import BLANK_CHARS

# The white space of the blank-line rule, NBSP and U+FEFF included.
WS = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
_WS = re.compile("[" + WS.replace("\\x0B", "\\v") + "]*")
_SPACE = re.compile("[" + WS.replace("\\x0B", "\\v").replace("\\n", "") + "]")
_CONSTRUCT = re.compile(
    r"\s*(?:#{1,6}\s|/\*\*|\"\"\"|'''|@\w|(?:export|public|private|protected|static|async|default|abstract|final)\b"
    r"|(?:def|class|func|fn|function|interface|enum|struct|impl|trait|type|create|insert|package)\b)"
)
BLANK_BEFORE, CONSTRUCT, LINE_END, PUNCTUATION, SPACE = 5, 4, 3, 2, 1


def is_oversized(text, max_lines: int = 80, max_chars: int = 6000):
    """Column: more than ``max_chars`` code points, or lines once trailing blank ones are dropped.

    Only texts with more line ends than ``max_lines`` allow are trimmed; all steps are linear.
    """
    ends = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    kept = F.rtrim(text, F.lit(BLANK_CHARS))
    return (F.length(text) > max_chars) | ((ends(text) >= max_lines) & (ends(kept) >= max_lines))


class BoundaryIndex:
    """Sparse table over boundary strengths; ``strongest(i, j)`` is the rightmost maximum of [i, j]."""

    def __init__(self, strength: np.ndarray, widest: int):
        # strength first, place second: one maximum decides both and breaks ties rightward
        rank = strength.astype(np.int64) * (len(strength) + 1) + np.arange(len(strength))
        self.size, self.levels = len(strength) + 1, [rank]
        span = 1
        while 2 * span <= min(widest, len(rank)):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[: len(last) - span], last[span:]))
            span *= 2

    def strongest(self, i: int, j: int) -> int:
        level = (j - i + 1).bit_length() - 1
        row = self.levels[level]
        return int(max(row[i], row[j - (1 << level) + 1])) % self.size


def boundaries(text: str, max_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset, line index, strength) of every place where a cut may fall, the end included."""
    offset, line, strength = [], [], []
    at, n, blank = 0, 0, False
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end + 1
        offset.append(at)
        line.append(n)
        strength.append(BLANK_BEFORE if blank else CONSTRUCT if _CONSTRUCT.match(text, at, end) else LINE_END)
        if end - at > max_chars:
            for i in range(at + 1, end):
                before = text[i - 1]
                if before.isalnum() or before == "_":
                    continue
                offset.append(i)
                line.append(n)
                strength.append(SPACE if _SPACE.match(before) else PUNCTUATION if before in ";,})]" else 0)
        blank = _WS.match(text, at, end).end() >= end
        at, n = end, n + 1
    offset.append(len(text))
    line.append(n)
    strength.append(BLANK_BEFORE)
    return np.array(offset, np.int64), np.array(line, np.int64), np.array(strength, np.int8)


def split_text(
    text: str, max_lines: int = 80, max_chars: int = 6000, overlap: int = 8, min_lines: int = 25
) -> list[tuple[int, int, int, int]]:
    """(start, end, first line, last line) of each piece; offsets in code points, lines from 1.

    Every piece holds at most ``max_lines`` lines and ``max_chars`` code points, together
    they cover the text, and a piece starts ``overlap`` lines before the end of the last
    one, or as many as leave room for new lines (half of either limit). A cut inside a
    line longer than ``max_chars`` has no overlap. Without any boundary in reach the cut
    falls at the limit itself.
    """
    if not text:
        return []
    offset, line, strength = boundaries(text, max_chars)
    index = BoundaryIndex(strength, int(min(len(offset), max(max_chars, max_lines) + 1)))
    total_lines = int(line[-1])
    pieces, start, covered = [], 0, 0
    while True:
        start_line = int(line[np.searchsorted(offset, start, side="right") - 1])
        # the last boundary that both limits permit, and the first worth taking
        by_chars = int(np.searchsorted(offset, start + max_chars, side="right")) - 1
        first_of_line = int(np.searchsorted(line, start_line + max_lines, side="left"))
        last = min(by_chars, first_of_line, len(offset) - 1)
        least = int(np.searchsorted(offset, covered, side="right"))
        if last == len(offset) - 1:
            end, end_line = len(text), total_lines
        elif last < least:
            end = start + max_chars
            end_line = int(line[np.searchsorted(offset, end - 1, side="right") - 1]) + 1
        else:
            far = int(np.searchsorted(line, start_line + min_lines, side="left"))
            half = int(np.searchsorted(offset, start + max_chars // 2, side="left"))
            end_at = index.strongest(max(least, min(last, far, half)), last)
            end = int(offset[end_at])
            end_line = int(line[np.searchsorted(offset, end - 1, side="right") - 1]) + 1
        pieces.append((start, end, start_line + 1, end_line))
        if end >= len(text):
            return pieces
        covered, start = end, end
        back = int(np.searchsorted(offset, end, side="left"))
        whole = back < len(offset) and offset[back] == end and strength[back] >= LINE_END
        if whole:
            for lines in range(min(overlap, max_lines // 2), 0, -1):
                target = int(np.searchsorted(line, int(line[back]) - lines, side="left"))
                if line[target] == line[back] - lines and offset[target] > pieces[-1][0] and end - offset[target] <= max_chars // 2:
                    start = int(offset[target])
                    break


def split_oversized(
    df: DataFrame,
    id_col: str = "chunk_id",
    text_col: str = "text",
    max_lines: int = 80,
    max_chars: int = 6000,
    overlap: int = 8,
    min_lines: int = 25,
) -> DataFrame:
    """(id, piece, start_line, end_line, start_char, piece_text) of every item beyond a limit.

    ``start_char`` is the piece's offset in the text, in code points from 0. Lines are those of the stored text, counted from 1, whatever the row's own line
    columns say; a text within both limits, empty or null gives no row. Repeated rows
    give repeated pieces, a null id is kept, and other columns are ignored. Texts are
    cut where they lie: there is no shuffle.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (i, number, first, last, start, text[start:end])
                for i, text in zip(frame["id"], frame["text"])
                for number, (start, end, first, last) in enumerate(split_text(text, max_lines, max_chars, overlap, min_lines))
            ]
            out = pd.DataFrame(rows, columns=["id", "piece", "start_line", "end_line", "start_char", "piece_text"])
            out["id"] = out["id"].astype("Int64")
            yield out

    items = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return items.where(is_oversized(F.col("text"), max_lines, max_chars)).mapInPandas(
        cut, "id bigint, piece int, start_line int, end_line int, start_char int, piece_text string"
    )


def rebuilt(pieces: DataFrame) -> DataFrame:
    """(id, hash, chars, lines, widest_lines, longest_chars) of split items, put together again from their pieces.

    Each piece gives what the ones before it have not covered. One item's pieces meet in a
    group, as they do in the item itself. Repeated rows of a piece count once.
    """
    spans = pieces.withColumn("stop_char", F.col("start_char") + F.length("piece_text")).dropDuplicates(["id", "piece"])
    before = Window.partitionBy("id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("seen", F.coalesce(F.max("stop_char").over(before), F.lit(0)))
    fresh = F.expr("substring(piece_text, seen - start_char + 1)")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", fresh.alias("t")))), lambda x: x["t"]), "")
    return (
        spans.groupBy("id")
        .agg(
            whole.alias("whole"),
            F.max(F.col("end_line") - F.col("start_line") + 1).alias("widest_lines"),
            F.max(F.length("piece_text")).alias("longest_chars"),
            F.max("end_line").alias("lines"),
        )
        .select("id", F.sha1(F.encode("whole", "UTF-8")).alias("hash"), F.length("whole").alias("chars"), "lines", "widest_lines", "longest_chars")
    )
