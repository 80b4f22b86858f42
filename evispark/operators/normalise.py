"""Corpus normalisation: quality gates, ordered deduplication, near-duplicate openings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions.text import fingerprint, prefix_fingerprint, record_key
from evispark.session import checkpointed

DATE = r"^\d{4}-\d{2}-\d{2}$"


def drop_reason(text: Column, date: Column, least_chars: int = 200) -> Column:
    """too_short, then bad_date, else null."""
    return F.when(text.isNull() | (F.length(text) < least_chars), "too_short").when(~F.coalesce(date.rlike(DATE), F.lit(False)), "bad_date")


def ordered_dedupe(rows: DataFrame, seq: str, keys: tuple[str, str] = ("key", "fp")) -> DataFrame:
    """seq, reason (null: kept, duplicate_key or duplicate_text) as reading the rows in order of seq would give.

    A row is dropped if a kept row before it has its key, or else its text; dropped rows register
    neither. Rounds: keep the rows that come first in both their groups, drop those that share a
    group with a kept row, and go on with the rest; each round only groups and joins by key, until none is left. seq is unique, keys aren't null.
    """
    k, f = keys
    left = checkpointed(rows.select(seq, k, f))
    kept = None
    while True:  # the first row left is kept in each round, so `left` shrinks
        first_k = left.groupBy(k).agg(F.min(seq).alias("_k"))
        first_f = left.groupBy(f).agg(F.min(seq).alias("_f"))
        now = left.join(first_k, k).join(first_f, f).where((F.col(seq) == F.col("_k")) & (F.col(seq) == F.col("_f"))).select(seq, k, f)
        now = checkpointed(now)
        kept = now if kept is None else kept.unionByName(now)
        left = checkpointed(left.join(now.select(k), k, "left_anti").join(now.select(f), f, "left_anti"))
        if left.isEmpty():
            break
        if now.isEmpty():
            raise ValueError("rows with a null key or text can't be ordered")
    by_key = kept.select(k, F.col(seq).alias("_by_key"))
    by_fp = kept.select(f, F.col(seq).alias("_by_fp"))
    out = rows.select(seq, k, f).join(by_key, k, "left").join(by_fp, f, "left")
    before_k = F.col("_by_key") < F.col(seq)
    return out.select(seq, F.when(before_k, "duplicate_key").when(F.col("_by_fp") < F.col(seq), "duplicate_text").alias("reason"))


def normalise(corpus: DataFrame, seq: str, doc_id: str = "doc_id", section: str = "section", text: str = "text", date: str = "date") -> DataFrame:
    """corpus with reason: null for the rows that stay."""
    gated = corpus.withColumn("_gate", drop_reason(F.col(text), F.col(date)))
    passed = gated.where("_gate is null").select(seq, F.coalesce(record_key(F.col(doc_id), F.col(section)), F.lit("")).alias("key"), fingerprint(F.col(text)).alias("fp"))
    return gated.join(ordered_dedupe(passed, seq), seq, "left").withColumn("reason", F.coalesce("_gate", "reason")).drop("_gate")


def near_duplicate_openings(kept: DataFrame, text: str = "text") -> DataFrame:
    """openings, extra: groups of rows whose first 500 normalised characters are equal, and the rows beyond the first of each."""
    groups = kept.groupBy(prefix_fingerprint(F.col(text)).alias("p")).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("openings"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))


def newest_per_group(rows: DataFrame, groups: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in the given order."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def last_wins(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row for each key, the last in the given order; a pre-aggregated max, no sort of the groups."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def quarter_sample(rows: DataFrame, stratum: str, ts: str, per_stratum: int, tie: str) -> DataFrame:
    """The newest per_stratum // quarters + 1 rows of each stratum and calendar quarter, over the quarters there are."""
    q = rows.where(F.col(ts).isNotNull()).withColumn("quarter", F.date_trunc("quarter", ts))
    bounds = q.agg(F.min("quarter").alias("a"), F.max("quarter").alias("b")).select((F.floor(F.months_between("b", "a") / 3) + 1).alias("quarters"))
    w = Window.partitionBy(stratum, "quarter").orderBy(F.col(ts).desc(), tie)
    ranked = q.crossJoin(F.broadcast(bounds)).withColumn("_rn", F.row_number().over(w))  # one row
    return ranked.where(F.col("_rn") <= F.floor(F.lit(per_stratum) / F.col("quarters")) + 1).drop("_rn", "quarters")


def stratified_pick(rows: DataFrame, stratum: str, order: str, quota: int, required: DataFrame | None = None) -> DataFrame:
    """Required rows (by `order` value) and then the first of each stratum up to its quota."""
    must = required.select(order).distinct().withColumn("_must", F.lit(0)) if required is not None else rows.select(order).limit(0).withColumn("_must", F.lit(0))
    w = Window.partitionBy(stratum).orderBy(F.coalesce("_must", F.lit(1)), order)
    return rows.join(must, order, "left").withColumn("_rn", F.row_number().over(w)).where((F.col("_must") == 0) | (F.col("_rn") <= quota)).drop("_rn", "_must")


def round_robin(rows: DataFrame, strata: list[str], order: str, n: int) -> DataFrame:
    """n rows, taken in turn from the strata."""
    w = Window.partitionBy(*strata).orderBy(order)
    return rows.withColumn("turn", F.row_number().over(w)).orderBy("turn", *strata).limit(n)


def proportional_sample(rows: DataFrame, stratum: str, key: str, n: int, required: DataFrame) -> DataFrame:
    """The required rows (key), and of the others so many of each stratum, the first by hash, as its share of n rounds down to; n is the feature's limit."""
    total = rows.agg(F.count("*").alias("_total"))
    quota = rows.groupBy(stratum).agg(F.count("*").alias("_n")).crossJoin(F.broadcast(total)).select(stratum, F.floor(F.lit(n) * F.col("_n") / F.col("_total")).alias("_quota"))  # one row
    must = required.select(key).distinct()
    w = Window.partitionBy(stratum).orderBy(F.md5(key), key)
    others = rows.join(must, key, "left_anti").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)  # cut before the shuffle
    return others.join(quota, stratum).where("_rn <= _quota").select(rows.columns).unionByName(rows.join(must, key, "left_semi"))


def _long(chunks: DataFrame, least_chars: int) -> DataFrame:
    return chunks.where((F.length("text") > least_chars) & (F.col("ticker") != "") & F.col("section").isNotNull() & F.col("chunk_id").isNotNull())


def _first() -> Column:
    return F.min(F.struct(F.md5("chunk_id"), "chunk_id"))["chunk_id"].alias("chunk_id")


def temporal_pairs(chunks: DataFrame, least_chars: int = 1200) -> DataFrame:
    """ticker, section, early, late, chunk_id_a, chunk_id_b: a passage, the first by hash, of the first and of the last year of each issuer's section; sections of one year have none."""
    year = F.substring("date", 1, 4).alias("year")
    reps = checkpointed(_long(chunks, least_chars).where("date is not null").groupBy("ticker", "section", year).agg(_first()))
    ends = reps.groupBy("ticker", "section").agg(F.min(F.struct("year", "chunk_id")).alias("a"), F.max(F.struct("year", "chunk_id")).alias("b")).where("a.year < b.year")
    return ends.select("ticker", "section", F.col("a.year").alias("early"), F.col("b.year").alias("late"), F.col("a.chunk_id").alias("chunk_id_a"), F.col("b.chunk_id").alias("chunk_id_b"))


def cross_entity_pairs(chunks: DataFrame, least_chars: int = 1200, rounds: int = 3) -> DataFrame:
    """section, round, chunk_id_a, chunk_id_b: in each round the issuers of a section are put in another order by hash and paired, each with its passage that comes first by hash."""
    reps = _long(chunks, least_chars).groupBy("section", "ticker").agg(_first())
    each = reps.select("section", "ticker", "chunk_id", F.explode(F.array(*[F.lit(r) for r in range(rounds)])).alias("round"))
    w = Window.partitionBy("section", "round").orderBy(F.md5(F.concat_ws("|", "ticker", "section", F.col("round").cast("string"))))
    placed = each.withColumn("i", F.row_number().over(w) - 1).withColumn("b", F.lead("chunk_id").over(w))
    return placed.where("i % 2 = 0 and b is not null").select("section", "round", F.col("chunk_id").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))
