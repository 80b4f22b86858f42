"""Mixing sources to target shares of tokens, by entropy balancing.

Each document gets a rate w = min(max_repeats, exp(lambda * tokens / mean tokens)), the
rates nearest to 1 in entropy whose tokens meet the source's constraint. The lambdas solve
a convex dual by damped Newton steps; each step's sums are one aggregate over the
(source, tokens) counts of all documents, so nothing but a few numbers for each target
reaches the driver. Rates are then rounded into whole copies by systematic sampling over the
documents in the order of their sizes, so that neighbours in the order, which are of about the same
size, round up and down in turn and the tokens come out as the rates want them, not just the copies. What the
rounding leaves over is settled by single copies of the documents that fit it best.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispark.llm._words import by_size
from evispark.operators.once import once_each
from evispark.operators.ranks import running_sum
from evispark.session import checkpointed

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern of this public vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Most rows of the targets table; it is read to the driver.
MOST_TARGETS = 10_000


@lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens of each document with a text that isn't empty; the whole text is encoded."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        each = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        for rows in by_size(each, 2):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([len(encode(r[2])) for r in rows], pa.int64())], ["doc_id", "source", "tokens"])

    rows = once_each(docs.where("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("long"), "source", "text"))
    return rows.mapInArrow(count, "doc_id long, source string, tokens long")


def token_budgets(targets: list[tuple[str, float, int, int]], total: float) -> dict[str, float]:
    """Tokens wanted of each source; targets: (source, share, max_repeats, tokens there are).

    A source that can't reach its share even at max_repeats gives all it can; what it lacks
    is spread over the others in proportion to their shares, as far as they reach.
    """
    left, open_, out = total, {s: (w, r * n) for s, w, r, n in targets if w > 0 and r * n > 0}, {s: 0.0 for s, *_ in targets}
    while open_:
        weight = sum(w for w, _ in open_.values())
        full = [s for s, (w, most) in open_.items() if left * w / weight >= most]
        if not full:
            return out | {s: left * w / weight for s, (w, _) in open_.items()}
        for s in full:
            out[s] = float(open_.pop(s)[1])
            left -= out[s]
    return out


def balancing_rates(counts: DataFrame, budgets: dict[str, float], repeats: dict[str, int], tolerance: float = 1e-7, most_steps: int = 200) -> dict[str, tuple[float, float]]:
    """(lambda, mean tokens) of each source with a budget below what max_repeats gives; counts: source, tokens, n. Raises where most_steps don't suffice."""
    spark = counts.sparkSession
    stats = {r["source"]: (r["docs"], r["tokens"]) for r in counts.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("tokens")).alias("tokens")).collect()}
    live = {s: b for s, b in budgets.items() if s in stats and 0 < b < repeats[s] * stats[s][1] * (1 - 1e-12)}
    mean = {s: stats[s][1] / stats[s][0] for s in live}
    lam = dict.fromkeys(live, 0.0)
    bound = {s: [-500.0, 500.0] for s in live}
    kind = T.StructType([T.StructField("source", T.StringType()), T.StructField("lam", T.DoubleType()), T.StructField("mean", T.DoubleType()), T.StructField("most", T.DoubleType())])
    todo = set(live)
    for _ in range(most_steps):
        if not todo:
            break
        now = spark.createDataFrame([(s, lam[s], mean[s], float(repeats[s])) for s in sorted(todo)], kind)
        x = F.col("tokens") / F.col("mean")
        e = F.exp(F.least(F.col("lam") * x, F.lit(700.0)))
        sums = counts.join(F.broadcast(now), "source").groupBy("source").agg(F.sum(F.col("n") * F.least(e, "most") * x).alias("g"), F.sum(F.when(e < F.col("most"), F.col("n") * e * x * x).otherwise(0.0)).alias("h"))
        for r in sums.collect():  # a row for each target
            s, want = r["source"], live[r["source"]] / mean[r["source"]]
            gap = r["g"] - want
            if abs(gap) <= tolerance * want:
                todo.discard(s)
                continue
            bound[s][int(gap > 0)] = lam[s]
            lo, hi = bound[s]
            step = lam[s] - gap / r["h"] if r["h"] > 0 else np.nan
            # a Newton step that leaves the bracket of the convex dual is replaced by its middle
            lam[s] = float(step) if lo < step < hi else (lo + hi) / 2
    if todo:
        raise ValueError(f"rates of {sorted(todo)} didn't converge")
    return {s: (lam[s], mean[s]) for s in live}


def mix_sources(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER, seed: int = 1) -> DataFrame:
    """doc_id, source, tokens, rate, copies of each document of a listed source; copies may be 0.

    targets: source, target_share, max_repeats. total_tokens: size wanted, else the tokens of all
    documents of listed sources. Documents with a null or unlisted source and null or empty
    texts are left out; repeated rows count once; a target of a source without documents is
    spread over the others. An empty table gives no rows; extra columns are ignored.
    """
    goal = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.select("source", "target_share", "max_repeats").where("source is not null").limit(MOST_TARGETS + 1).collect()}
    if len(goal) > MOST_TARGETS:
        raise ValueError("too many targets")
    listed = F.broadcast(targets.select("source").where("source is not null").distinct())
    counted = checkpointed(token_counts(docs.join(listed, "source", "left_semi"), tokenizer))
    counts = checkpointed(counted.groupBy("source", "tokens").agg(F.count("*").alias("n")))
    there = {r["source"]: r["t"] for r in counts.groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")).alias("t")).collect()}
    total = float(total_tokens if total_tokens is not None else sum(there.values()))
    repeats = {s: r for s, (_, r) in goal.items()}
    budgets = token_budgets([(s, w, r, there.get(s, 0)) for s, (w, r) in sorted(goal.items())], total)
    solved = balancing_rates(counts, budgets, repeats)
    kind = T.StructType([T.StructField("source", T.StringType()), T.StructField("lam", T.DoubleType()), T.StructField("mean", T.DoubleType()), T.StructField("most", T.DoubleType())])
    rows = [(s, *solved[s], float(repeats[s])) if s in solved else (s, None, 1.0, float(repeats[s]) if budgets[s] > 0 else 0.0) for s in sorted(goal)]
    tilt = docs.sparkSession.createDataFrame(rows, kind)
    rate = F.when(F.col("lam").isNull(), F.col("most")).otherwise(F.least(F.exp(F.least(F.col("lam") * F.col("tokens") / F.col("mean"), F.lit(700.0))), F.col("most")))
    rated = counted.join(F.broadcast(tilt), "source").select("doc_id", "source", "tokens", rate.alias("rate"), F.col("most").cast("int").alias("_most")).withColumn("_at", F.xxhash64("doc_id", F.lit(seed)))
    run = running_sum(rated, ["source"], [F.col("tokens"), F.col("_at"), F.col("doc_id")], F.col("rate"), "_before")
    copies = (F.floor(F.col("_before") + F.col("rate") + 0.5) - F.floor(F.col("_before") + 0.5)).cast("int")
    rounded = checkpointed(run.select("doc_id", "source", "tokens", "rate", "_most", "_at", F.least(copies, "_most").alias("copies")))
    return _settled(rounded, {s: budgets[s] for s in solved}).select("doc_id", "source", "tokens", "rate", "copies")


def _settled(rounded: DataFrame, budgets: dict[str, float]) -> DataFrame:
    """rounded with a few copies more or fewer, so that each source's tokens end nearest to its budget.

    In each round a source that is off by more than half its smallest usable document takes one copy of the largest
    document that isn't larger than what is missing, or gives one back; the gap at least halves in most rounds.
    """
    used = {r["source"]: r["used"] for r in rounded.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used")).collect()}
    gap = {s: b - used[s] for s, b in budgets.items() if s in used}
    changed: dict[tuple[str, int], int] = {}
    spark = rounded.sparkSession
    # how many documents of each size can take or give a copy; the sizes are far fewer than the documents
    sizes = checkpointed(rounded.groupBy("source", "tokens").agg(F.sum((F.col("copies") < F.col("_most")).cast("long")).alias("up"), F.sum((F.col("copies") > 0).cast("long")).alias("down")))
    open_ = {s for s, g in gap.items() if abs(g) >= 1}
    while open_:
        want = spark.createDataFrame([(s, float(gap[s])) for s in sorted(open_)], "source string, gap double")
        taken = spark.createDataFrame([(s, n, c) for (s, n), c in changed.items()] or [("", -1, 0)], "source string, tokens long, used long")
        near = sizes.join(F.broadcast(want), "source").join(F.broadcast(taken), ["source", "tokens"], "left")  # a row for each open source and each change made
        free = F.when(F.col("gap") > 0, F.col("up") - F.coalesce("used", F.lit(0))).otherwise(F.col("down") + F.coalesce("used", F.lit(0)))
        fit = near.where((free > 0) & (F.abs(F.abs("gap") - F.col("tokens")) < F.abs("gap")))
        best = {r["source"]: r["tokens"] for r in fit.groupBy("source").agg(F.min_by("tokens", F.struct(F.abs(F.abs("gap") - F.col("tokens")), "tokens")).alias("tokens")).collect()}
        for s in list(open_):
            if s not in best:
                open_.discard(s)
                continue
            way = 1 if gap[s] > 0 else -1
            changed[s, best[s]] = changed.get((s, best[s]), 0) + way
            gap[s] -= way * best[s]
            if abs(gap[s]) < 1:
                open_.discard(s)
    if not changed:
        return rounded
    moves = spark.createDataFrame([(s, n, c) for (s, n), c in changed.items() if c] or [("", -1, 0)], "source string, tokens long, _move long")
    able = rounded.join(F.broadcast(moves), ["source", "tokens"]).where(F.when(F.col("_move") > 0, F.col("copies") < F.col("_most")).otherwise(F.col("copies") > 0))
    # the first by hash among the documents of one size, cut to the most that move in any before the shuffle
    place = F.row_number().over(Window.partitionBy("source", "tokens").orderBy("_at", "doc_id"))
    chosen = able.withColumn("_rn", place).where(F.col("_rn") <= max(map(abs, changed.values()))).where(F.col("_rn") <= F.abs("_move"))
    chosen = chosen.select("source", "tokens", "doc_id", F.signum("_move").cast("int").alias("_by"))
    return rounded.join(F.broadcast(chosen), ["source", "tokens", "doc_id"], "left").withColumn("copies", F.col("copies") + F.coalesce("_by", F.lit(0)))


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, docs, tokens, used_tokens, actual_share, most_copies of each target."""
    per = mixed.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    total = per.agg(F.sum("used_tokens").alias("total"))
    out = targets.select("source", "target_share", "max_repeats").join(per, "source", "left").crossJoin(F.broadcast(total))  # one row
    zero = F.lit(0)
    return out.select("source", "target_share", "max_repeats", F.coalesce("docs", zero).alias("docs"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce("used_tokens", zero).alias("used_tokens"), (F.coalesce("used_tokens", zero) / F.col("total")).alias("actual_share"), F.coalesce("most_copies", zero).alias("most_copies"))
