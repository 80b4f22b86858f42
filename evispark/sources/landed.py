"""Landed source files: filing lists, index pages, exhibits, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.operators.normalise import newest_per_group

RECORD = "doc_id string, source string, ticker string, form string, date string, section string, url string, text string"


def read_records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Line-delimited JSON with a declared schema, so no pass infers it; a damaged line gives nulls."""
    return spark.read.schema(schema).json(path)


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def select_filings(filings: DataFrame, as_of: Column, annual: int = 3, quarterly: int = 6, current_days: int = 548) -> DataFrame:
    """Of each ticker the newest annual and quarterly reports, and the current reports of the last days. filings: ticker, form, date, accession, primary_doc."""
    own = filings.where(F.col("form").isin("10-K", "10-Q", "8-K") & F.col("primary_doc").isNotNull() & (F.col("primary_doc") != ""))
    order = [F.col("date").desc(), F.col("accession").desc()]
    k = newest_per_group(own.where("form = '10-K'"), ["ticker"], order, annual)
    q = newest_per_group(own.where("form = '10-Q'"), ["ticker"], order, quarterly)
    c = own.where("form = '8-K'").where(F.try_to_date(F.col("date")) >= F.date_sub(as_of, current_days))
    return k.unionByName(q).unionByName(c)


def filing_names(filings: DataFrame, host: str) -> DataFrame:
    """filings with url and doc_id (TICKER_FORM_DATE_SEQ)."""
    bare = F.replace("accession", F.lit("-"), F.lit(""))
    url = F.concat_ws("/", F.lit(host), F.col("cik"), bare, F.col("primary_doc"))
    name = F.concat_ws("_", F.col("ticker"), F.replace("form", F.lit("-"), F.lit("")), F.col("date"), F.element_at(F.split("accession", "-"), -1))
    return filings.withColumn("url", url).withColumn("doc_id", name)


def exhibit_links(pages: DataFrame, kind: str = "EX-13", page: str = "html") -> DataFrame:
    """accession, seq, href of the rows of an index table whose fourth cell begins with kind."""
    rows = pages.select("accession", F.posexplode(F.regexp_extract_all(F.col(page), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("seq", "row"))
    cells = rows.withColumn("cells", F.regexp_extract_all(F.col("row"), F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)))
    own = cells.where(F.startswith(F.trim(F.regexp_replace(F.coalesce(F.get("cells", F.lit(3)), F.lit("")), "<[^>]+>", "")), F.lit(kind)))
    href = F.regexp_replace(F.regexp_extract("row", r"""(?i)href\s*=\s*["']([^"']+)["']""", 1), r"^/ix\?doc=", "")
    return own.select("accession", "seq", href.alias("href")).where("href <> ''")


def with_exhibits(filings: DataFrame, exhibits: DataFrame) -> DataFrame:
    """filings (accession, text) with each exhibit's text appended in order; missing ones are skipped."""
    joined = exhibits.where("text is not null").groupBy("accession").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("more"))  # one filing's exhibits
    out = filings.join(joined, "accession", "left")
    return out.withColumn("text", F.when(F.col("more").isNull(), F.col("text")).otherwise(F.concat_ws(" ", "text", "more"))).drop("more")


def discover_documents(pages: DataFrame, patterns: dict[str, str], since: str, page: str = "html") -> DataFrame:
    """kind, date, url of the distinct links that match a pattern with a group of eight digits, from `since` on."""
    found = None
    for kind, pattern in patterns.items():
        one = pages.select(F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all(F.col(page), F.lit(pattern), F.lit(0))).alias("url"))
        found = one if found is None else found.unionByName(one)
    digits = F.regexp_extract("url", r"(\d{8})", 1)
    date = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    return found.select("kind", date.alias("date"), "url").where(F.col("date") >= since).distinct().orderBy("date", "kind", "url")


def quarter_bounds(spark: SparkSession, start: str, end: str) -> DataFrame:
    """first, last: the calendar quarters that touch start .. end."""
    days = spark.range(1).select(F.explode(F.sequence(F.date_trunc("quarter", F.lit(start).cast("date")).cast("date"), F.lit(end).cast("date"), F.expr("interval 3 month"))).alias("first"))
    return days.select(F.col("first").cast("string").alias("first"), F.date_sub(F.add_months("first", 3), 1).cast("string").alias("last"))


def length_floor(rows: DataFrame, source: str = "source", text: str = "text", floors: dict[str, int] | None = None) -> DataFrame:
    """Rows whose text reaches their source's least length."""
    floors = floors or {"edgar": 500, "fomc": 500, "cfpb": 200}
    least = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in floors.items() for x in kv]), F.coalesce(source, F.lit(""))), F.lit(0))
    return rows.where(F.length(text) >= least)


def latest_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
