"""Held-out items in a corpus, by Wu-Manber search over words.

The patterns are all runs of min_words consecutive words of the items. A table of shifts,
by the hash of a block of two words, tells how far the search may move on from a block that
does not end a pattern. All texts of a batch move in lockstep, so each step is one look-up
for an array of positions. A shift of 0 leads to the bucket of patterns that end in this
block and begin with the right one; then all words are compared directly, by their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm._words import by_size, mix, sorted_unique, words
from evispark.session import checkpointed

#: Least and most address bits of the table of shifts; it has about eight entries for each word of the items.
SHIFT_BITS = (16, 24)
#: Most items (and characters of them) searched at once; more are searched in further passes.
ITEMS_AT_ONCE, CHARS_AT_ONCE = 100_000, 50_000_000


class Items(NamedTuple):
    """What is sent to the tasks: hash and item of each word of all items, 12 bytes a word."""

    words: np.ndarray
    text: np.ndarray  # number of the item each word is from
    ids: np.ndarray
    m: int


class Patterns(NamedTuple):
    shift: np.ndarray  # by the low bits of a block's hash
    bucket: np.ndarray  # sorted keys of the patterns' last and first blocks
    start: np.ndarray  # first word of each pattern, in the same order
    items: Items


def _blocks(h: np.ndarray) -> np.ndarray:
    """Hash of the words i - 1 and i at i; 0 at the first."""
    out = np.zeros(len(h), np.uint64)
    out[1:] = mix(h[:-1] * np.uint64(3) + h[1:])
    return out


def _key(last: np.ndarray, first: np.ndarray) -> np.ndarray:
    return mix(last * np.uint64(5) + first)


def item_words(items: list[tuple[int, str]], min_words: int) -> Items:
    """items: (id, text). Items of fewer words have no pattern."""
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    w = words([t for _, t in items], alnum=True)
    return Items(w.hash, w.doc.astype(np.int32), np.array([i for i, _ in items], np.int64), min_words)


def build_patterns(items: Items) -> Patterns:
    """Every run of m words of an item is a pattern; equal ones of one item count once, and no run is stored but by where it starts."""
    m, block = items.m, _blocks(items.words)
    start = np.flatnonzero(items.text[m - 1 :] == items.text[: len(items.text) - m + 1]) if len(items.text) >= m else np.empty(0, np.int64)
    bits = min(max(int(8 * len(start) + 1).bit_length(), SHIFT_BITS[0]), SHIFT_BITS[1])
    shift = np.full(1 << bits, m - 1, np.int32)
    low = (block & np.uint64(len(shift) - 1)).astype(np.int64)
    for q in range(1, m):  # later blocks allow less, and overwrite
        shift[low[start + q]] = m - 1 - q
    key = _key(block[start + m - 1], block[start + 1])
    order = np.argsort(key, kind="stable")
    return Patterns(shift, key[order], start[order].astype(np.int32), items)


def search(texts: list[str], p: Patterns) -> set[tuple[int, int]]:
    """(row, item) of each text that holds a pattern."""
    w = words(texts, alnum=True)
    m, block, end = p.items.m, _blocks(w.hash), np.cumsum(w.counts)
    low = (block & np.uint64(len(p.shift) - 1)).astype(np.int64)
    row = np.flatnonzero(w.counts >= m)
    pos = (end - w.counts)[row] + m - 1
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    while len(row):
        step = p.shift[low[pos]]
        stop = step == 0
        if stop.any():
            hits.append((row[stop], pos[stop]))
        pos = pos + np.maximum(step, 1)
        on = pos < end[row]
        row, pos = row[on], pos[on]
    if not hits or not len(p.bucket):
        return set()
    row, pos = np.concatenate([r for r, _ in hits]), np.concatenate([q for _, q in hits])
    key = _key(block[pos], block[pos - m + 2])
    lo = np.searchsorted(p.bucket, key, side="left")
    n = np.searchsorted(p.bucket, key, side="right") - lo
    row, pos, lo, n = row[n > 0], pos[n > 0], lo[n > 0], n[n > 0]
    found: list[np.ndarray] = []
    cum = np.cumsum(n)
    at = 0
    while at < len(row):  # bounded stretches of candidates
        to = max(at + 1, int(np.searchsorted(cum, (cum[at - 1] if at else 0) + (1 << 20), side="right")))
        each = np.repeat(np.arange(at, to), n[at:to])
        start = p.start[lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(n[at:to]) - n[at:to], n[at:to])].astype(np.int64)
        first = pos[each] - m + 1
        same = np.ones(len(each), bool)
        for k in range(m):  # every word
            same &= w.hash[first + k] == p.items.words[start + k]
        found.append(sorted_unique((row[each][same].astype(np.uint64) << np.uint64(32)) | p.items.text[start[same]].astype(np.uint64)))
        at = to
    pairs = sorted_unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
    return set(zip((pairs >> np.uint64(32)).astype(np.int64).tolist(), p.items.ids[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)].tolist(), strict=True))


class Sent(NamedTuple):
    serial: int  # differs between the searches of a session
    items: Broadcast


_serial = count()
_built: dict[int, Patterns] = {}


def _patterns(sent: Sent) -> Patterns:
    """The tables of the items sent, built once in each worker."""
    if sent.serial not in _built:
        _built.clear()
        _built[sent.serial] = build_patterns(sent.items.value)
    return _built[sent.serial]


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = 12) -> DataFrame:
    """item_id, doc_id of items and documents that share min_words consecutive words.

    Words are runs of a-z and 0-9 in the lower-cased text. Null ids and texts match nothing, nor do
    texts of fewer words. The items must be the small side: they are read to the driver as word hashes, in
    passes of bounded size that are broadcast, and each pass searches all documents. Repeated rows count once.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    todo = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("long"), F.col(item_text)).distinct()
    found = None
    for k, own in enumerate(_passes(todo)):
        if k:  # further passes: what came before is written, so that the plan doesn't grow
            found = checkpointed(found)
        sent = docs.sparkSession.sparkContext.broadcast(item_words(own, min_words))  # at most CHARS_AT_ONCE characters
        part = rows.mapInArrow(_scan(Sent(next(_serial), sent)), "item_id long, doc_id long").distinct()
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _scan(sent: Sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _patterns(sent)
        each = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for batch in by_size(each, 1):
            hits = sorted(search([t for _, t in batch], p))
            yield pa.RecordBatch.from_arrays([pa.array([i for _, i in hits], pa.int64()), pa.array([batch[r][0] for r, _ in hits], pa.int64())], ["item_id", "doc_id"])

    return scan


def _passes(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    batch: list[tuple[int, str]] = []
    size = 0
    for item, text in items.toLocalIterator():
        if batch and (len(batch) >= ITEMS_AT_ONCE or size + len(text) > CHARS_AT_ONCE):
            yield batch
            batch, size = [], 0
        batch.append((item, text))
        size += len(text)
    yield batch


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, item_set, n_docs of every item, 0 where nothing leaked."""
    per = found.groupBy("item_id").agg(F.count("*").alias("n"))
    return items.select("item_id", "item_set").distinct().join(per, "item_id", "left").select("item_id", "item_set", F.coalesce("n", F.lit(0)).alias("n_docs"))
