"""Near-duplicate texts by a blocked sparse product of the document by n-gram incidence.

The incidence matrix (a row for each distinct word sequence, a column for each hashed word
n-gram) is cut into column blocks. If two rows have a Jaccard similarity of at least t,
their overlap is at least t/(1+t) of the sum of their sizes, so in at least one block
the overlap reaches the same share of their sizes there. In a block only
size - ceil(t*size) + 1 columns of a row, the rarest first, are multiplied; a product
is dropped if the sizes, the positions of the shared column or a 64-bit parity map of
the block's rows show that the overlap stays below that share. All three bounds are
exact: no pair at or above t is lost. Pairs that pass are checked on whole texts.

Rows of very different sizes are cut into different numbers of blocks; a row enters every size
class that holds a size between its own and its own divided by t, so it meets each row it can be
alike to. Column frequencies come from a fixed-size count sketch over all rows. They order the
columns, and a column of many entries is cut into blocks of rows, each pair of which is a
product of its own; so an error there costs time, never a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm._words import ALNUM_WORD, Words, by_size, mix, sequence_hash, sorted_unique, windows, words
from evispark.operators.components import connected_components
from evispark.session import checkpointed

SKETCH_BITS = 21
SLICES = 32
#: Rows of at most FIRST_SIZE columns are cut into FIRST_BLOCKS blocks, FACTOR times longer ones into FACTOR times as many: a block's row then has about 13 to 40 columns, which suits 64 bits.
FIRST_SIZE, FIRST_BLOCKS, FACTOR, CLASSES = 160, 4, 3, 9
#: A task multiplies one of so many groups of blocks, or a share of its columns; shares are made so that a task gets about TASK_ENTRIES entries.
BLOCK_GROUPS, TASK_ENTRIES = 16, 4_000_000
#: Of a column with more entries than this, each block of about as many rows is multiplied with each other block.
HEAVY_ENTRIES = 30_000
#: Greatest size and position in a block that an entry's byte holds; bounds aren't applied to larger blocks.
LARGEST = 254
#: Bits of a column's level, its logarithmic frequency.
LEVEL_BITS = 6
#: Members of a group that are paired in one block; of larger groups each pair of blocks is paired on its own.
GROUP_BLOCK = 4096
#: Most candidate links whose ids are broadcast to fetch the texts; of more they are joined by a shuffle.
BROADCAST_LINKS = 200_000


def _grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    at, h = windows(w, n)
    return w.doc[at].astype(np.uint64), h


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Words of the texts in the last column, each text once for a task's batch."""
    rows = ((t,) for b in batches for t in b.column(b.num_columns - 1).to_pylist())
    for batch in by_size(rows, 0):
        yield words(list(dict.fromkeys(t for (t,) in batch)), alnum=True)


def _with_uid(rows: DataFrame, keep: str) -> DataFrame:
    """uid of each row's text beside the column `keep` (id or text)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for batch in by_size(each, 1):
            uid = sequence_hash(words([t for _, t in batch], alnum=True))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in batch], pa.string()), pa.array(uid, pa.int64())], [keep, "uid"])

    return rows.select(F.col(keep).cast("string"), "text").mapInArrow(add, f"{keep} string, uid long") if keep != "text" else rows.select(F.col("text").alias("t"), "text").mapInArrow(add, "text string, uid long")


class _Sketch(NamedTuple):
    level: np.ndarray  # of each cell
    row_blocks: np.ndarray  # of a column, by level
    entries: float  # of all rows


def _frequency_sketch(rows: DataFrame, n: int) -> _Sketch:
    """Level (0 to 63, logarithmic) of the summed frequency of each cell of columns, over all rows."""
    cells = 1 << SKETCH_BITS
    step = cells // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.uint32)
        for w in _batches(batches):
            _, h = _grams(w, n)
            total += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=cells).astype(np.uint32)
        level = np.minimum(255, np.round(16 * np.log2(1 + total))).astype(np.uint8)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([level[i * step : (i + 1) * step].tobytes() for i in range(SLICES)], pa.binary())], ["slice", "cells"])

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(step)
        for cells_ in part["cells"]:
            total += np.exp2(np.frombuffer(cells_, np.uint8) / 16.0) - 1
        level = np.minimum((1 << LEVEL_BITS) - 1, np.round(1.5 * np.log2(1 + total))).astype(np.uint8)
        return pd.DataFrame({"slice": [key[0]], "cells": [level.tobytes()], "entries": [total.sum()]})

    parts = rows.select("text").mapInArrow(count, "slice int, cells binary").groupBy("slice").applyInPandas(add, "slice int, cells binary, entries double")
    levels, entries = np.zeros(cells, np.uint8), 0.0
    for r in parts.collect():  # SLICES rows of a fixed size
        levels[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(r["cells"], np.uint8)
        entries += r["entries"]
    # a cell holds entries of other columns too: only what stands out from the average cell is one column's
    usual, most = entries / cells, np.exp2((np.arange(1 << LEVEL_BITS) + 0.5) / 1.5)
    heavy = most > max(HEAVY_ENTRIES, 4 * usual)
    return _Sketch(levels, np.where(heavy, np.ceil((most - usual) / HEAVY_ENTRIES), 1).astype(np.int64), entries)


def _size_class(size: np.ndarray) -> np.ndarray:
    return np.searchsorted([FIRST_SIZE * FACTOR**k for k in range(CLASSES - 1)], size)


class _Entries(NamedTuple):
    """The multiplied entries (column, position in its block's row, head) and the rows' blocks (row, size, parity); entries are in the order of their heads."""

    gram: np.ndarray
    at: np.ndarray
    head: np.ndarray
    part: np.ndarray
    row: np.ndarray
    size: np.ndarray
    parity: np.ndarray


def _block_entries(w: Words, uids: np.ndarray, n: int, t: float, sketch: _Sketch, splits: int) -> _Entries:
    """Of a batch's rows; splits: shares of a group's columns."""
    turn = mix(uids.view(np.uint64)) >> np.uint64(20)  # by which rows fall into blocks
    doc, h = _grams(w, n)
    once = sorted_unique((doc << np.uint64(48)) | (h >> np.uint64(16)))
    sizes = np.bincount((once >> np.uint64(48)).astype(np.int64), minlength=len(w.counts))
    own, upper = _size_class(sizes), _size_class(np.ceil(sizes / t))
    level = sketch.level[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    found: list[_Entries] = []
    heads = 0
    for k in range(CLASSES):
        use = ((own <= k) & (k <= upper))[doc.astype(np.int64)]
        if not use.any():
            continue
        g = mix(h[use] + np.uint64(k))
        block = ((g >> np.uint64(32)) * np.uint64(FIRST_BLOCKS * FACTOR**k)) >> np.uint64(32)
        # order within a row: block, frequency, hash; 10 + 16 + 6 + 32 bits
        key = sorted_unique((doc[use] << np.uint64(54)) | (block << np.uint64(38)) | (level[use] << np.uint64(32)) | (g & np.uint64((1 << 32) - 1)))
        part = key >> np.uint64(38)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        size = np.diff(np.append(first, len(key)))
        parity = np.bitwise_xor.reduceat(np.uint64(1) << ((key >> np.uint64(3)) & np.uint64(63)), first)
        head = np.repeat(np.arange(len(first)), size)
        at = np.arange(len(key)) - first[head]
        take = at < (size - np.ceil(t * size - 1e-9).astype(np.int64) + 1)[head]
        head, at = head[take], at[take]
        column = mix((key[take] & np.uint64((1 << 54) - 1)) + np.uint64(k << 54))
        group = ((part & np.uint64(0xFFFF)).astype(np.int64)[first] + FIRST_BLOCKS * (FACTOR**k - 1) // (FACTOR - 1)) % BLOCK_GROUPS
        share = (column >> np.uint64(32)).astype(np.int64) % splits
        part, row = group[head] * splits + share, (key[first] >> np.uint64(54)).astype(np.uint16)
        blocks = sketch.row_blocks[((key[take] >> np.uint64(32)) & np.uint64((1 << LEVEL_BITS) - 1)).astype(np.int64)]
        if blocks.max(initial=1) > 1:
            each = np.repeat(np.arange(len(head)), blocks)
            head, at, column, part, blocks = head[each], at[each], column[each], part[each], blocks[each]
            other = np.arange(len(each)) - np.searchsorted(each, each)
            mine = (turn[row[head]] % blocks.astype(np.uint64)).astype(np.int64)
            pair = mix(column + (np.minimum(mine, other) * blocks + np.maximum(mine, other)).astype(np.uint64))
            column = np.where(blocks > 1, pair, column)
            part = np.where(blocks > 1, (pair >> np.uint64(32)).astype(np.int64) % (BLOCK_GROUPS * splits), part)
        found.append(_Entries(column.astype(np.uint32), np.minimum(at, LARGEST).astype(np.uint8), head + heads, part, row, np.minimum(size, LARGEST + 1).astype(np.uint8), parity))
        heads += len(first)
    return _joined(found)


def _joined(found: list[_Entries]) -> _Entries:
    if not found:
        return _Entries(*(np.empty(0, k) for k in (np.uint32, np.uint8, np.int64, np.int64, np.uint16, np.uint8, np.uint64)))
    return _Entries(*(np.concatenate(x) for x in zip(*found, strict=True)))


_HEAD = (("row", np.uint16), ("count", np.uint32), ("size", np.uint8), ("parity", np.uint64))


def _pack(uids: np.ndarray, e: _Entries) -> pa.RecordBatch:
    """A message for each task: the blocks' rows that have entries there, and the entries."""
    order = np.argsort(e.part.astype(np.uint16 if len(e.part) and e.part.max() < 1 << 16 else np.int64), kind="stable")
    part, head, gram, at = e.part[order], e.head[order], e.gram[order], e.at[order]
    cut = np.append(np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))), len(part))
    ids, heads, body = [], [], []
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        own = head[lo:hi]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        count, own = np.diff(np.append(first, len(own))), own[first]
        row = e.row[own]
        used = sorted_unique(row)
        ids.append(uids[used].tobytes())
        heads.append(b"".join(x.astype(k).tobytes() for (_, k), x in zip(_HEAD, (np.searchsorted(used, row), count, e.size[own], e.parity[own]), strict=True)))
        body.append(gram[lo:hi].tobytes() + at[lo:hi].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]], pa.int32()), pa.array(ids, pa.binary()), pa.array(heads, pa.binary()), pa.array(body, pa.binary())], ["part", "uids", "heads", "body"])


def _unpack(ids: bytes, heads: bytes, body: bytes) -> tuple[np.ndarray, ...]:
    """uid, gram, at, size, parity of each entry."""
    n, off, fields = len(heads) // sum(np.dtype(k).itemsize for _, k in _HEAD), 0, []
    for _, k in _HEAD:
        fields.append(np.frombuffer(heads, k, n, off))
        off += n * np.dtype(k).itemsize
    row, count, size, parity = fields
    m = len(body) // 5
    uid = np.frombuffer(ids, np.int64)[row]
    return np.repeat(uid, count), np.frombuffer(body, np.uint32, m), np.frombuffer(body, np.uint8, m, 4 * m), np.repeat(size, count), np.repeat(parity, count)


def _multiply(gram: np.ndarray, row: np.ndarray, at: np.ndarray, size: np.ndarray, parity: np.ndarray, t: float, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Pairs of rows (lesser << 32 | greater) that share a column and pass the bounds; entries are sorted by column."""
    first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    last = np.append(first[1:], len(gram))
    rest = np.repeat(last, last - first) - np.arange(len(gram)) - 1  # partners behind each entry
    cum = np.cumsum(rest)
    needs = np.ceil(t / (1 + t) * np.arange(512) - 1e-9).astype(np.int16)  # least overlap by the sum of two sizes
    left = size - at
    large = size > LARGEST  # neither size nor position is known
    left[large] = np.iinfo(left.dtype).max
    free = bool(large.any())
    lo = 0
    while lo < len(gram):
        base = cum[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(cum, base + most, side="right")))
        n = rest[lo:hi]
        if n.any():
            i = np.repeat(np.arange(lo, hi), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            need = needs[size[i] + size[j]]
            if free:
                need = np.where(large[i] | large[j], np.int16(0), need)
            ok = np.flatnonzero((left[i] >= need) & (left[j] >= need))
            i, j, need = i[ok], j[ok], need[ok]
            apart = np.bitwise_count(parity[i] ^ parity[j])
            ok = np.flatnonzero((size[i] + size[j] - apart >= 2 * need) | (need == 0))
            i, j = row[i[ok]], row[j[ok]]
            yield (np.minimum(i, j) << np.uint64(32)) | np.maximum(i, j)
        lo = hi


def _candidates(rows: DataFrame, n: int, t: float, sketch: _Sketch, splits: int) -> DataFrame:
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids: list[np.ndarray] = []
        held: list[_Entries] = []
        heads = rows_held = 0
        for w in _batches(batches):
            own = sequence_hash(w)
            e = _block_entries(w, own, n, t, sketch, splits)
            held.append(e._replace(head=e.head + heads, row=e.row + np.uint16(rows_held)))
            heads += len(e.row)
            rows_held += len(w.counts)
            uids.append(own)
            if rows_held > 12_000:
                yield _pack(np.concatenate(uids), _joined(held))
                uids, held, heads, rows_held = [], [], 0, 0
        if uids:
            yield _pack(np.concatenate(uids), _joined(held))

    def product(part: pd.DataFrame) -> pd.DataFrame:
        uid, gram, at, size, parity = (np.concatenate(x) for x in zip(*(_unpack(*m) for m in zip(part["uids"], part["heads"], part["body"], strict=True)), strict=True))
        known = sorted_unique(uid)
        key = (gram.astype(np.uint64) << np.uint64(32)) | np.searchsorted(known, uid).astype(np.uint64)
        order = np.argsort(key)
        key = key[order]
        once = np.concatenate(([True], key[1:] != key[:-1]))
        order, key = order[once], key[once]
        row = key & np.uint64(0xFFFFFFFF)
        at, size, parity = at[order].astype(np.int16), size[order].astype(np.int16), parity[order]
        held: list[np.ndarray] = []
        kept = 0
        for pair in _multiply(key >> np.uint64(32), row, at, size, parity, t):
            held.append(pair)
            kept += len(pair)
            if kept > 1 << 22:
                held = [sorted_unique(np.concatenate(held))]
                kept = 0
        pairs = sorted_unique(np.concatenate(held)) if held else np.empty(0, np.uint64)
        a, b = known[(pairs >> np.uint64(32)).astype(np.int64)], known[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        return pd.DataFrame({"uid_a": np.minimum(a, b), "uid_b": np.maximum(a, b)})

    return (
        rows.select("text")
        .mapInArrow(entries, "part int, uids binary, heads binary, body binary")
        .groupBy("part")
        .applyInPandas(product, "uid_a long, uid_b long")
        .groupBy("uid_a", "uid_b")
        .agg(F.count("*").alias("blocks"))
    )


def _grams_of(text: str, n: int) -> set[tuple[str, ...]]:
    w = ALNUM_WORD.findall(text.lower())
    return set(zip(*(w[i:] for i in range(n)), strict=False))


def near_duplicate_links(rows: DataFrame, members: DataFrame, n: int, threshold: float) -> DataFrame:
    """uid_a, uid_b, jaccard of the pairs of different word sequences that are alike; rows: id, text; members: id, uid."""
    sketch = _frequency_sketch(rows, n)
    wanted = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2, sketch.entries // TASK_ENTRIES
    splits = max(1, int(max(wanted)) // BLOCK_GROUPS)
    cand = checkpointed(_candidates(rows, n, threshold, sketch, splits))
    few = cand.count() <= BROADCAST_LINKS
    small = F.broadcast if few else lambda x: x
    uids = cand.select(F.explode(F.array("uid_a", "uid_b")).alias("uid")).distinct()
    ids = members.join(small(uids), "uid", "left_semi").groupBy("uid").agg(F.min("id").alias("id")).select("id")
    # an id may have several texts, so the uid is taken anew; what isn't a candidate falls out of the joins below
    texts = _with_uid(rows.join(small(ids), "id", "left_semi"), "text").groupBy("uid").agg(F.first("text").alias("text"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, set] = {}
        for b in batches:
            a_id, b_id, a_text, b_text = (b.column(i).to_pylist() for i in range(4))
            score = []
            for x, y, tx, ty in zip(a_id, b_id, a_text, b_text, strict=True):
                gx, gy = (known.get(k) or known.setdefault(k, _grams_of(text, n)) for k, text in ((x, tx), (y, ty)))
                common = len(gx & gy)
                score.append(common / max(1, len(gx) + len(gy) - common))
                if len(known) > 500:
                    known.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64())], ["uid_a", "uid_b", "jaccard"])

    a, b = (texts.select(F.col("uid").alias(f"uid_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    return (
        cand.select("uid_a", "uid_b").join(a, "uid_a").join(b, "uid_b")
        .select("uid_a", "uid_b", "text_a", "text_b")
        .mapInArrow(exact, "uid_a long, uid_b long, jaccard double")
        .where(F.col("jaccard") >= threshold)
    )


def _prepared(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    enough = F.lower(F.col(text_col)).rlike(f"(?s)^(?:[^a-z0-9]*+[a-z0-9]++){{{max(min_words, 1)}}}")
    return df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & enough).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))


def near_duplicate_groups(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, min_words: int = 60) -> DataFrame:
    """A row for each distinct (id, text): id, uid, group_id, n_links.

    Rows with null id or text, or fewer than min_words words, are left out. Texts of equal
    words in equal order share a uid and a group; n_links counts a text's links to others.
    A text without any is its own group. An empty table gives no rows; other columns are
    ignored. Word sequences are told apart by a 64-bit hash.
    """
    rows = _prepared(df, id_col, text_col, min_words)
    members = checkpointed(_with_uid(rows, "id").distinct())
    links = checkpointed(near_duplicate_links(rows, members, n, threshold))
    degree = links.select(F.explode(F.array("uid_a", "uid_b")).alias("uid")).groupBy("uid").agg(F.count("*").alias("n_links"))
    groups = connected_components(links.select(F.col("uid_a").alias("src"), F.col("uid_b").alias("dst"))).join(degree.withColumnRenamed("uid", "node"), "node")
    return (
        members.join(groups.withColumnRenamed("node", "uid"), "uid", "left")
        .select("id", "uid", F.coalesce("component", "uid").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def labelled(groups: DataFrame) -> DataFrame:
    """groups with group_id replaced by the least id of the group."""
    least = groups.groupBy("group_id").agg(F.min("id").alias("label"))
    return groups.join(least, "group_id").select("id", "uid", F.col("label").alias("group_id"), "n_links")


def group_pairs(groups: DataFrame) -> DataFrame:
    """id_a < id_b of one group, all of them, copies included; their number grows with the square of the group.

    The members of a large group are cut into blocks, and each pair of blocks is a key of its own.
    """
    return _pairs(groups.select("id", "group_id").distinct())


def representative_pairs(groups: DataFrame) -> DataFrame:
    """id_a < id_b of one group, between the least ids of its different word sequences; with the membership (id, uid) no link is lost."""
    return _pairs(groups.groupBy("group_id", "uid").agg(F.min("id").alias("id")).select("id", "group_id").distinct())


def _pairs(members: DataFrame) -> DataFrame:
    size = members.groupBy("group_id").agg(F.count("*").alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / GROUP_BLOCK).cast("int")
    m = checkpointed(members.join(size, "group_id").select("id", "group_id", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    a = m.select("group_id", F.col("own").alias("low"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("high"), F.col("id").alias("x"))
    b = m.select("group_id", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("low"), F.col("own").alias("high"), F.col("id").alias("y"))
    met = a.join(b, ["group_id", "low", "high"]).where((F.col("low") < F.col("high")) & (F.col("x") != F.col("y")) | (F.col("x") < F.col("y")))
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
