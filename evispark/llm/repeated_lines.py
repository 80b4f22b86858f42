"""Lines repeated across one site's documents, as blocks of a graph of consecutive lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.operators.components import connected_components
from evispark.operators.once import once_each
from evispark.session import checkpointed

#: Most nodes that are broadcast to mark their occurrences; more are joined by a shuffle.
BROADCAST_NODES = 200_000


def line_occurrences(df: DataFrame, min_chars: int = 20, max_chars: int = 200) -> DataFrame:
    """id, uid (64-bit hash of the text), doc, lines array<struct<no, node>> of each distinct chunk: the lines that count, by number from 1.

    A node is the 64-bit hash of (ticker, or source where ticker is null) and the line with all but a-z and 0-9 dropped.
    """
    site = F.coalesce(F.concat(F.lit("t:"), "ticker"), F.concat(F.lit("s:"), F.coalesce("source", F.lit(""))))
    rows = df.where("text is not null and chunk_id is not null").select("chunk_id", "doc_id", site.alias("site"), "text")
    one = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("no"), x.alias("x"), F.length(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).alias("n")))
    fit = F.filter(one, lambda s: s["n"].between(min_chars, max_chars))
    keyed = F.transform(fit, lambda s: F.struct(s["no"].alias("no"), F.regexp_replace(F.lower(s["x"]), "[^a-z0-9]+", "").alias("k")))
    named = rows.select(F.col("chunk_id").alias("id"), F.xxhash64("text").alias("uid"), F.xxhash64("doc_id").alias("doc"), "site", F.filter(keyed, lambda s: s["k"] != "").alias("lines")).where(F.size("lines") > 0)
    return named.select("id", "uid", "doc", F.transform("lines", lambda s: F.struct(s["no"].alias("no"), F.xxhash64(named["site"], s["k"]).alias("node"))).alias("lines"))


def boilerplate_blocks(occurrences: DataFrame, min_docs: int = 6) -> DataFrame:
    """node, docs, block: the connected parts of the graph of lines standing in at least min_docs documents of a site.

    Edges join consecutive lines that follow each other in as many documents; a line without any is a block of its own.
    """
    nodes = occurrences.select("doc", F.explode("lines.node").alias("node")).groupBy("node").agg(F.countDistinct("doc").alias("docs")).where(F.col("docs") >= min_docs)
    nodes = checkpointed(nodes)
    follow = F.transform(F.filter(F.zip_with("lines", F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["b"].isNotNull() & (p["b"]["no"] == p["a"]["no"] + 1)), lambda p: F.struct(p["a"]["node"].alias("src"), p["b"]["node"].alias("dst")))
    edges = occurrences.select("doc", F.explode(follow).alias("e")).select("doc", "e.src", "e.dst")
    edges = edges.groupBy("src", "dst").agg(F.countDistinct("doc").alias("docs")).where(F.col("docs") >= min_docs).select("src", "dst")
    alone = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    return connected_components(edges.unionByName(alone)).join(nodes, "node").select("node", "docs", F.col("component").alias("block"))


def repeated_lines(df: DataFrame, min_docs: int = 6, min_chars: int = 20, max_chars: int = 200) -> DataFrame:
    """id, uid, line_no, docs, block of each occurrence of a line repeated in at least min_docs doc_ids of one site.

    df: chunk_id, doc_id, ticker, source, text. Lines are the parts between line feeds; only lines of
    min_chars to max_chars characters without outer white space count. Null texts and ids
    give no rows, a null doc_id supports nothing, repeated rows count once.
    """
    occ = checkpointed(line_occurrences(df, min_chars, max_chars).distinct())
    nodes = checkpointed(boilerplate_blocks(occ, min_docs))
    each = occ.select("id", "uid", F.explode("lines").alias("l")).select("id", "uid", F.col("l.no").alias("line_no"), F.col("l.node").alias("node"))
    small = nodes.count() <= BROADCAST_NODES
    return each.join(F.broadcast(nodes) if small else nodes, "node").select("id", "uid", "line_no", "docs", "block").distinct()


def without_repeated_lines(df: DataFrame, found: DataFrame) -> DataFrame:
    """chunk_id, text without the found lines, n_removed: a row for each distinct (chunk_id, text); null texts stay null."""
    drop = found.groupBy("id", "uid").agg(F.array_sort(F.collect_set("line_no")).alias("drop"))  # at most the lines of one text
    rows = once_each(df.select("chunk_id", "text")).withColumn("uid", F.xxhash64("text"))
    joined = rows.join(drop, (rows["chunk_id"] == drop["id"]) & (rows["uid"] == drop["uid"]), "left").select("chunk_id", "text", "drop")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.coalesce(F.array_contains("drop", i + 1), F.lit(False))), "\n")
    return joined.select("chunk_id", F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce(F.size("drop"), F.lit(0)).alias("n_removed"))


def block_report(found: DataFrame) -> DataFrame:
    """block, lines (different places in the texts), texts, docs (of its most frequent line): what each block of standing lines covers."""
    return found.groupBy("block").agg(F.count("*").alias("lines"), F.countDistinct("id", "uid").alias("texts"), F.max("docs").alias("docs"))
