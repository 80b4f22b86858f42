"""Pieces of oversized texts, cut at balanced targets that snap to nearby boundaries."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.operators.once import once_each


def boundary_strength(text: str) -> np.ndarray:
    """Strength of a cut before each position: 5 blank line, 4 line end, 3 sentence end, 2 clause end, 1 white space, 0 none, -1 inside a character with marks."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    s = np.zeros(n + 1, np.int8)
    if not n:
        return s
    space = np.isin(points, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]) | ((points >= 0x2000) & (points <= 0x200A))
    line = points == 10
    after_space = np.concatenate(([False], space))
    # the last solid character before each position
    solid = np.where(~space, np.arange(n), -1)
    last = np.concatenate(([-1], np.maximum.accumulate(solid)))
    before = np.where(last >= 0, points[np.maximum(last, 0)], 0)
    closing = np.isin(before, [ord(c) for c in "\"')]}»”’"])
    inner = np.where(last >= 1, points[np.maximum(last - 1, 0)], 0)
    ender = np.where(closing, inner, before)
    starts = np.concatenate((~space, [True]))  # the position begins a solid character, or the end
    cut = after_space & starts
    s[cut] = 1
    s[cut & np.isin(before, [ord(c) for c in ",;:–—"])] = 2
    s[cut & np.isin(ender, [ord(c) for c in ".!?。！？…"])] = 3
    lines = np.concatenate(([0], np.cumsum(line)))
    breaks = lines - lines[last + 1]
    s[cut & (breaks == 1)] = 4
    s[cut & (breaks > 1)] = 5
    for i in np.flatnonzero(points > 0x2FF):
        if unicodedata.combining(c := chr(points[i])) or c in "‍️":
            s[i] = -1
    s[n] = 6
    return s


def piece_bounds(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of the pieces, as few as limit and overlap allow.

    Each but the first starts at the last word's beginning that is at least `overlap` before the end of the one before
    it, if that is at most a quarter of the overlap further back; else exactly `overlap` before.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)]
    strength = boundary_strength(text)
    pieces = -(-(n - overlap) // (limit - overlap))
    while True:
        # with no slack for the starts the least number of pieces always fits
        for slack in sorted({min(overlap // 4, (limit - overlap) // 2) >> k for k in range(8)} | {0}, reverse=True):
            bounds = _placed(strength, n, pieces, limit, overlap, slack)
            if bounds and all(b - a <= limit for a, b in bounds):
                return bounds
        pieces += 1


def _placed(strength: np.ndarray, n: int, pieces: int, limit: int, overlap: int, slack: int) -> list[tuple[int, int]] | None:
    """Balanced targets, each snapped to the strongest boundary near it that leaves room for all pieces behind it."""
    step = (n - overlap) / pieces
    reach = int(step / 4)
    bounds, start = [], 0
    for k in range(1, pieces):
        target = round(overlap + k * step)
        # what is left must fit into the pieces behind, and this one into the limit
        least = max(n - (pieces - k) * (limit - overlap - slack), start + overlap + slack + 1)
        most = min(start + limit, n - 1)
        if least > most:
            return None
        lo, hi = max(target - reach, least), min(target + reach, most)
        if lo > hi:
            lo = hi = least if target < least else most
        at = np.arange(lo, hi + 1)
        end = int(at[np.lexsort((np.abs(at - target), -strength[at]))[0]])
        bounds.append((start, end))
        start = _start(strength, end - overlap, slack)
    return [*bounds, (start, n)]


def _start(strength: np.ndarray, at: int, slack: int) -> int:
    """The last beginning of a word from at - slack to at; else the last place there that isn't inside a character with marks; else at."""
    near = strength[max(at - slack, 1) : at + 1]
    for good in (near > 0, near >= 0):
        if good.any():
            return at - int(np.argmax(good[::-1]))
    return at


def split_oversized(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", section_col: str = "section", limit: int = 2400, overlap: int = 200) -> DataFrame:
    """id, piece_no (from 1), n_pieces, section, window_start, window_end, text: the pieces of each distinct (id, section, text).

    window_start and window_end are code points in the item's text. Texts up to the limit are one
    piece, as they stand; an empty text is one empty piece; null texts give no piece. Pieces never
    exceed the limit, consecutive ones share exactly `overlap` code points, and joining them
    without the shared parts gives the text back. Extra columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    rows = once_each(df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(section_col).alias("section"), F.col(text_col).alias("text")))
    schema = "id string, piece_no int, n_pieces int, section string, window_start int, window_end int, text string"
    short = rows.where(F.length("text") <= limit).select(F.col("id").cast("string"), F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), "section", F.lit(0).alias("window_start"), F.length("text").alias("window_end"), "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, section, text in zip(pdf["id"], pdf["section"], pdf["text"], strict=True):
                bounds = piece_bounds(text, limit, overlap)
                out += [(i, k, len(bounds), section, a, b, text[a:b]) for k, (a, b) in enumerate(bounds, 1)]
            yield pd.DataFrame(out, columns=["id", "piece_no", "n_pieces", "section", "window_start", "window_end", "text"])

    long = rows.where(F.length("text") > limit).withColumn("id", F.col("id").cast("string")).mapInPandas(cut, schema)
    return short.unionByName(long)
