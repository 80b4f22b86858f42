"""Long exact runs of words shared between records, by anchors at difference-cover positions.

With a difference cover D of period v, any two positions i and j have an offset below v that
moves both onto D modulo v. So if only windows of w = L - v + 1 words that begin at cover
positions are hashed, any common run of L words holds a window hashed on both sides.
Anchors are joined by hash; in each pair of records that shares one, the windows around shared
anchors are extended into runs, and the runs compared to the letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.llm._words import Words, by_size, sorted_unique, windows, words
from evispark.session import checkpointed

# Perfect difference sets by period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

#: Least and most address bits of the filter of the smaller side's anchors: it has about 16 bits for each anchor up to 32 MB; beyond, it only filters less.
FILTER_BITS = (18, 28)
SLICES = 32
BROADCAST_IDS = 1_000_000
#: An anchor of at least so many entries of the right side, and of a quarter of a task's share, is spread over several tasks; so there are at most four such anchors for each task.
HOT_ENTRIES = 50_000


def cover_of(min_words: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and window for runs of min_words words; the period is at most half of it."""
    period = max((v for v in COVERS if 2 * v <= min_words), default=0)
    if not period:
        return 1, (0,), min_words
    return period, COVERS[period], min_words - period + 1


def _anchors(texts: list[str], min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct anchors of each text."""
    period, cover, width = cover_of(min_words)
    w = words(texts, alnum=False)
    at, h = windows(w, width)
    first = np.concatenate(([0], np.cumsum(w.counts)))[:-1]
    doc = w.doc[at]
    take = np.isin((at - first[doc]) % period, cover)
    return doc[take], h[take]


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def _is_set(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    for batch in by_size(rows, 1):
        once = dict(batch)
        yield list(once), list(once.values())


def _anchor_filter(side: DataFrame, min_words: int) -> np.ndarray:
    """Bits, packed, that are set for each anchor of side."""
    period, cover, _ = cover_of(min_words)
    letters = side.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    wanted = 16 * (letters / 6) * len(cover) / period
    bits_ = min(max(int(np.ceil(np.log2(max(wanted, 2)))), FILTER_BITS[0]), FILTER_BITS[1])
    step = (1 << bits_) // 8 // SLICES

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << bits_, bool)
        for _, texts in _batches(batches):
            for p in _places(_anchors(texts, min_words)[1], bits_):
                bits[p] = True
        if bits.any():
            packed = np.packbits(bits)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([packed[i * step : (i + 1) * step].tobytes() for i in range(SLICES)], pa.binary())], ["slice", "bits"])

    def either(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": [key[0]], "bits": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in part["bits"]]).tobytes()]})

    out = np.zeros((1 << bits_) // 8, np.uint8)
    for r in side.select("uid", "text").mapInArrow(mark, "slice int, bits binary").groupBy("slice").applyInPandas(either, "slice int, bits binary").collect():  # SLICES rows of at most 1 MB
        out[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return out


def _packed(side: DataFrame, which: int, min_words: int, parts: int, known: np.ndarray | None) -> DataFrame:
    """Messages to each task: uids, and the anchors as (hash, index of the uid)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids: list[int] = []
        rows, hashes = [], []

        def message() -> pa.RecordBatch:
            own, row, h = np.array(uids, np.int64), np.concatenate(rows), np.concatenate(hashes)
            place = ((h >> np.uint64(40)) % np.uint64(parts)).astype(np.uint16)
            order = np.argsort(place, kind="stable")
            row, h, place = row[order], h[order], place[order]
            cut = np.append(np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))), len(place))
            ids, body = [], []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                used = sorted_unique(row[lo:hi])
                ids.append(own[used].tobytes())
                body.append(h[lo:hi].tobytes() + np.searchsorted(used, row[lo:hi]).astype(np.uint16).tobytes())
            n = len(ids)
            return pa.RecordBatch.from_arrays([pa.array(place[cut[:-1]], pa.int32()), pa.array([which] * n, pa.int32()), pa.array(ids, pa.binary()), pa.array(body, pa.binary())], ["part", "side", "uids", "body"])

        for ids, texts in _batches(batches):
            doc, h = _anchors(texts, min_words)
            if known is not None:
                a, b = _places(h, len(known).bit_length() + 2)
                hit = _is_set(known, a) & _is_set(known, b)
                doc, h = doc[hit], h[hit]
            rows.append(doc + len(uids))
            hashes.append(h)
            uids += ids
            if len(uids) > 30_000:
                if any(map(len, rows)):
                    yield message()
                uids, rows, hashes = [], [], []
        if any(map(len, rows)):
            yield message()

    return side.select("uid", "text").mapInArrow(pack, "part int, side int, uids binary, body binary")


def _hot_anchors(messages: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of hot anchors in order, their entries on the right side, and the entries a task takes of one."""
    right = messages.where("side = 1")
    entries = right.agg(F.sum(F.octet_length("body")).alias("n")).first()["n"] or 0
    least = max(HOT_ENTRIES, entries // 10 // parts // 4)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for body in pdf["body"]:
                h = np.sort(np.frombuffer(body, np.uint64, len(body) // 10))
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                n = np.diff(np.append(first, len(h)))
                some = n > min(100, least // 10)
                yield pd.DataFrame({"h": h[first[some]].view(np.int64), "n": n[some]})

    hot = right.select("body").mapInPandas(local, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()
    h = np.array([r["h"] for r in hot], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r["n"] for r in hot], np.int64)[order], least


def _spread(messages: DataFrame, parts: int) -> DataFrame:
    """messages with the entries of hot anchors spread over tasks: the right side's in shares, the left side's copied to each of them."""
    hot, count, share = _hot_anchors(messages, parts)
    if not len(hot):
        return messages
    tasks = np.minimum(-(-count // share), parts)

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = 0
        for pdf in batches:
            out = []
            for part, side, ids, body in zip(pdf["part"], pdf["side"], pdf["uids"], pdf["body"], strict=True):
                n = len(body) // 10
                h, row = np.frombuffer(body, np.uint64, n), np.frombuffer(body, np.uint16, n, 8 * n)
                at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                is_hot = hot[at] == h
                keep = ~is_hot
                if keep.any():
                    out.append((part, side, ids, h[keep].tobytes() + row[keep].tobytes()))
                h, row, wide = h[is_hot], row[is_hot], tasks[at[is_hot]]
                if side == 1:
                    turn += 1
                    to = (np.arange(len(h)) + turn) % wide if len(h) else wide
                    each = np.arange(len(h))
                else:
                    each = np.repeat(np.arange(len(h)), wide)
                    to = np.arange(len(each)) - np.repeat(np.cumsum(wide) - wide, wide)
                place = (part + to) % parts
                for p in sorted_unique(place):
                    own = each[place == p]
                    out.append((int(p), side, ids, h[own].tobytes() + row[own].tobytes()))
            yield pd.DataFrame(out, columns=["part", "side", "uids", "body"])

    return messages.mapInPandas(move, "part int, side int, uids binary, body binary")


def _candidate_pairs(left: DataFrame, right: DataFrame, min_words: int) -> DataFrame:
    parts = max(12, min(30_000, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    known = _anchor_filter(left, min_words)

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for which in (0, 1):
            uid, h = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for ids, body in zip(part["uids"][part["side"] == which], part["body"][part["side"] == which], strict=True):
                n = len(body) // 10
                h.append(np.frombuffer(body, np.uint64, n))
                uid.append(np.frombuffer(ids, np.int64)[np.frombuffer(body, np.uint16, n, 8 * n)])
            sides.append((np.concatenate(uid), np.concatenate(h)))
        (a, ha), (b, hb) = sides
        order = np.argsort(ha)
        a, ha = a[order], ha[order]
        known_a, known_b = sorted_unique(a), sorted_unique(b)
        ia = np.searchsorted(known_a, a)
        found = np.empty(0, np.uint64)
        ib = np.searchsorted(known_b, b)
        lo, hi = np.searchsorted(ha, hb, side="left"), np.searchsorted(ha, hb, side="right")
        n = hi - lo
        cum = np.cumsum(n)
        total, held, size, most = int(cum[-1]) if len(cum) else 0, [], 0, 1 << 20
        for begin in range(0, total, most):
            k = np.arange(begin, min(total, begin + most))
            r = np.searchsorted(cum, k, side="right")
            left_at = lo[r] + (k - (cum[r] - n[r]))
            held.append(sorted_unique((ia[left_at].astype(np.uint64) << np.uint64(32)) | ib[r].astype(np.uint64)))
            size += len(held[-1])
            if size > 1 << 22:
                held, size = [sorted_unique(np.concatenate(held))], 0
        if held:
            found = sorted_unique(np.concatenate(held))
        return pd.DataFrame({"uid_l": known_a[(found >> np.uint64(32)).astype(np.int64)], "uid_r": known_b[(found & np.uint64(0xFFFFFFFF)).astype(np.int64)]})

    both = checkpointed(_packed(left, 0, min_words, parts, None).unionByName(_packed(right, 1, min_words, parts, known)))
    return _spread(both, parts).groupBy("part").applyInPandas(meet, "uid_l long, uid_r long").distinct()


class _Text(NamedTuple):
    """A text's anchors (first word and hash), its windows of min_words (hashes), and the order of the latter's hashes."""

    at: np.ndarray
    anchors: np.ndarray
    windows: np.ndarray
    order: np.ndarray
    n_words: int


def _texts(w: Words, min_words: int) -> list[_Text]:
    """Of a batch's texts."""
    period, cover, width = cover_of(min_words)
    end = np.cumsum(w.counts)
    first = end - w.counts
    at, h = windows(w, width)
    local = at - first[w.doc[at]]
    take = np.isin(local % period, cover)
    at, h, local = at[take], h[take], local[take]
    full_at, full = windows(w, min_words)
    cut, full_cut = np.searchsorted(at, np.append(first, end[-1:])), np.searchsorted(full_at, np.append(first, end[-1:]))
    out = []
    for k, n in enumerate(w.counts.tolist()):
        own = full[full_cut[k] : full_cut[k + 1]]
        out.append(_Text(local[cut[k] : cut[k + 1]], h[cut[k] : cut[k + 1]], own, np.argsort(own, kind="stable"), n))
    return out


def _chained(a: _Text, b: _Text, skip: np.ndarray) -> list[tuple[int, int, int]]:
    """Start in a, start in b and number of windows of runs that hold each window of a that b has too, but those to skip; a run goes on as long as it can."""
    ha, hb = a.windows, b.windows
    todo = np.flatnonzero(~skip)
    # of each window of a the first window of b with the same hash
    first = b.order[np.minimum(np.searchsorted(hb, ha[todo], sorter=b.order), len(hb) - 1)]
    met = hb[first] == ha[todo]
    runs: list[tuple[int, int, int]] = []
    end = -1
    for i, j in zip(todo[met].tolist(), first[met].tolist(), strict=True):
        if i < end:
            continue
        most = min(len(ha) - i, len(hb) - j)
        # compare in growing stretches, so that a short run costs little
        n, step = 1, 64
        while n < most:
            same = ha[i + n : i + min(n + step, most)] == hb[j + n : j + min(n + step, most)]
            if not same.all():
                n += int(same.argmin())
                break
            n += len(same)
            step *= 2
        runs.append((i, j, n))
        end = i + n
    return runs


def _anchored(a: _Text, b: _Text, reach: int) -> np.ndarray:
    """Windows of a that hold an anchor b has too; reach: places an anchor may take in a window."""
    n = len(a.windows)
    hit = a.at[np.isin(a.anchors, b.anchors)]
    edge = np.zeros(n + reach + 1, np.int64)
    np.add.at(edge, np.maximum(hit - reach, 0), 1)
    np.add.at(edge, hit + 1, -1)
    return np.cumsum(edge)[:n] > 0


def _common(a: _Text, b: _Text, min_words: int) -> list[tuple[int, int, int]]:
    na, nb = len(a.windows), len(b.windows)
    if not na or not nb:
        return []
    reach = min_words - cover_of(min_words)[2]
    open_a = _anchored(a, b, reach)
    if not open_a.any():
        return []
    runs = _chained(a, b, ~open_a)
    # what stands more than once in b: the places that no run has reached yet
    edge = np.zeros(nb + 1, np.int64)
    for _, j, n in runs:
        edge[j] += 1
        edge[j + n] -= 1
    left = _anchored(b, a, reach) & (np.cumsum(edge)[:nb] == 0)
    if left.any():
        runs += [(i, j, n) for j, i, n in _chained(b, a, ~left)]
    return [(i, j, n + min_words - 1) for i, j, n in runs]


def common_runs(a: str, b: str, min_words: int) -> list[tuple[int, int, int]]:
    """Start in a, start in b and length of common runs of at least min_words words of two texts, enough to hold each word that stands in any; time and number grow with the texts' lengths.

    Only windows of min_words around shared anchors are extended, each with its first partner in the other text, as far as it goes.
    """
    return _common(*_texts(words([a, b], alnum=False), min_words), min_words)


def shared_runs(left: DataFrame, right: DataFrame, min_words: int = 30) -> DataFrame:
    """uid_l, uid_r, runs array<struct<l, r, n>>, words_l, words_r of each pair of texts that share min_words consecutive words; runs hold every shared word of both, see common_runs.

    left, right: uid long (64-bit hash of the text), text; the left side should be the smaller. Words are split at
    white space and equal to the letter. Null, empty and shorter texts match nothing; equal texts share a uid and come once.
    """
    left, right = (x.where(F.col("text").isNotNull()).select("uid", "text") for x in (left, right))
    pairs = checkpointed(_candidate_pairs(left, right, min_words))
    few = pairs.count() <= BROADCAST_IDS

    def texts(side: DataFrame, c: str) -> DataFrame:
        ids = pairs.select(F.col(f"uid_{c}").alias("uid")).distinct()
        own = side.join(F.broadcast(ids) if few else ids, "uid", "left_semi")
        return own.groupBy("uid").agg(F.first("text").alias(f"text_{c}")).withColumnRenamed("uid", f"uid_{c}")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("uid_l", pa.int64()), ("uid_r", pa.int64()), ("runs", pa.list_(pa.struct([("l", pa.int32()), ("r", pa.int32()), ("n", pa.int32())]))), ("words_l", pa.int32()), ("words_r", pa.int32())])
        each = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
        for rows in by_size(each, 3):
            out: dict[str, list] = {k: [] for k in kind.names}
            known = list(dict.fromkeys(t for r in rows for t in r[2:]))
            own = dict(zip(known, _texts(words(known, alnum=False), min_words), strict=True))
            split: dict[str, list[str]] = {}
            for x, y, tx, ty in rows:
                runs = _common(own[tx], own[ty], min_words)
                if not runs:
                    continue
                wx, wy = (split.get(t) or split.setdefault(t, t.split()) for t in (tx, ty))
                if not all(wx[i : i + n] == wy[j : j + n] for i, j, n in runs):  # to the letter
                    raise ValueError("two different words have one hash")
                for k, v in zip(out, (x, y, [{"l": i, "r": j, "n": n} for i, j, n in runs], own[tx].n_words, own[ty].n_words), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=kind)

    joined = pairs.join(texts(left, "l"), "uid_l").join(texts(right, "r"), "uid_r").select("uid_l", "uid_r", "text_l", "text_r")
    return joined.mapInArrow(extend, "uid_l long, uid_r long, runs array<struct<l int, r int, n int>>, words_l int, words_r int")


def gold_snippets(drafts: DataFrame) -> DataFrame:
    """draft_id, span_no (from 0), uid, text of each distinct gold span with a snippet."""
    return (
        drafts.select(F.col("id").alias("draft_id"), F.posexplode("gold_spans").alias("span_no", "span"))
        .select("draft_id", "span_no", F.xxhash64("span.snippet").alias("uid"), F.col("span.snippet").alias("text"))
        .where("text is not null and draft_id is not null")
        .distinct()
    )


def snippet_matches(drafts: DataFrame, chunks: DataFrame, min_words: int = 30) -> DataFrame:
    """draft_id, span_no, chunk_id, uid_l, uid_r, runs, words_l, words_r: gold spans and chunks that share a run, a row for each pair of different texts."""
    spans = gold_snippets(drafts)
    rows = chunks.where("text is not null and chunk_id is not null").select("chunk_id", F.xxhash64("text").alias("uid"), "text")
    runs = checkpointed(shared_runs(spans, rows, min_words))
    left = spans.select(F.col("uid").alias("uid_l"), "draft_id", "span_no").distinct()
    right = rows.select(F.col("uid").alias("uid_r"), "chunk_id").distinct()
    return runs.join(left, "uid_l").join(right, "uid_r").select("draft_id", "span_no", "chunk_id", "uid_l", "uid_r", "runs", "words_l", "words_r")


def shared_words(matches: DataFrame, keys: list[str], side: str) -> DataFrame:
    """keys, n_partners, shared_words, words: how many words of each record lie in some shared run, each counted once. side: l or r; the record's text is told by uid.

    The runs' intervals are made distinct and merged in the order of their starts; a record has at most as many as its words allow.
    """
    keys, other = [*keys, "uid"], ["chunk_id"] if side == "l" else ["draft_id", "span_no"]
    m = matches.withColumn("uid", F.col(f"uid_{side}"))
    each = m.select(*keys, F.explode("runs").alias("x")).select(*keys, F.col(f"x.{side}").alias("a"), (F.col(f"x.{side}") + F.col("x.n")).alias("b")).groupBy(*keys, "a").agg(F.max("b").alias("b"))
    before = F.max("b").over(Window.partitionBy(*keys).orderBy("a").rowsBetween(Window.unboundedPreceding, -1))
    covered = each.withColumn("_to", F.coalesce(before, F.lit(0))).groupBy(*keys).agg(F.sum(F.greatest(F.col("b") - F.greatest("a", "_to"), F.lit(0))).alias("shared_words"))
    return m.groupBy(*keys).agg(F.countDistinct(*other).alias("n_partners")).join(covered, keys)


def share_report(spans: DataFrame, chunks: DataFrame, matches: DataFrame) -> DataFrame:
    """kind (span or chunk), record, uid, n_partners, shared_words, words, share of every gold span and chunk with a text, 0 where nothing is shared; share is null without words.

    spans: see gold_snippets; chunks: chunk_id, text; matches: see snippet_matches. A record with several texts has a row for each.
    """
    count = F.size(F.filter(F.split("text", r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")).alias("words")
    left = spans.select("draft_id", "span_no", "uid", count).join(shared_words(matches, ["draft_id", "span_no"], "l"), ["draft_id", "span_no", "uid"], "left").withColumn("record", F.concat_ws("#", "draft_id", "span_no")).withColumn("kind", F.lit("span"))
    own = chunks.where("text is not null and chunk_id is not null").select("chunk_id", F.xxhash64("text").alias("uid"), count).distinct()
    right = own.join(shared_words(matches, ["chunk_id"], "r"), ["chunk_id", "uid"], "left").withColumn("record", F.col("chunk_id")).withColumn("kind", F.lit("chunk"))
    cols = ["kind", "record", "uid", F.coalesce("n_partners", F.lit(0)).alias("n_partners"), F.coalesce("shared_words", F.lit(0)).alias("shared_words"), "words"]
    out = left.select(*cols).unionByName(right.select(*cols))
    return out.withColumn("share", F.when(F.col("words") > 0, F.col("shared_words") / F.col("words")))
