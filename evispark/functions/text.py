"""Text columns: tokens, n-grams, figures, fingerprints, headers, sentences, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns.
LEXICAL_TOKEN = r"[a-z0-9$][a-z0-9.$%-]*"
METRIC_WORD = r"[a-z0-9]+"
FIGURE = r"\d+(?:\.\d+)?"
CITATION = r"\[S(\d+)\]"
HEADING = r"^\s*(?:#{1,6}\s|\*{1,2}[^*]+\*{1,2}\s*:?\s*$|[-*+]\s*$|\d+[.)]\s*$)"
#: Words of a run that counts as evidence.
NGRAM = 10


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def lexical_tokens(c: Column) -> Column:
    return _all(F.lower(c), LEXICAL_TOKEN)


def metric_words(c: Column) -> Column:
    return _all(F.lower(c), METRIC_WORD)


def word_ngrams(words: Column, n: Column | int) -> Column:
    """Distinct runs of n words; of at most n words, one run of all; of none, none."""
    n = F.lit(n) if isinstance(n, int) else n
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) <= n, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(runs))


def figures(c: Column) -> Column:
    """Distinct numbers without thousands separators and without trailing zeros after a point."""
    plain = _all(F.replace(c, F.lit(",")), FIGURE)
    return F.array_distinct(F.transform(plain, lambda x: F.when(x.contains("."), F.regexp_replace(F.regexp_replace(x, "0+$", ""), r"\.$", "")).otherwise(x)))


def contradicts(a: Column, b: Column) -> Column:
    """Both sets of figures hold some and share none."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def normalised(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fingerprint(c: Column) -> Column:
    return F.sha2(normalised(F.lower(c)), 256)


def prefix_fingerprint(c: Column, n: int = 500) -> Column:
    return F.sha2(F.substring(normalised(F.lower(c)), 1, n), 256)


def slug(c: Column) -> Column:
    full = F.when(c.isNull() | (c == ""), F.lit("unknown")).otherwise(c)
    return F.regexp_replace(F.regexp_replace(F.lower(full), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def chunk_id(doc_id: Column, section: Column, index: Column) -> Column:
    return F.format_string("%s_%s_%03d", doc_id, slug(section), index)


def record_key(doc_id: Column, section: Column) -> Column:
    return F.concat_ws("_", doc_id, section)


def tighten_money(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"([$(])\s+(?=[\d.(])", "$1"), r"(?<=[\d.])\s+([%)])", "$1")


def html_to_text(c: Column, most_digits: int = 200) -> Column:
    """Visible text of HTML: hidden parts, scripts, styles and tables of more than most_digits digits go; entities become characters."""
    c = F.regexp_replace(c, r"(?is)<ix:hidden\b.*?</ix:hidden>", " ")
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    c = F.regexp_replace(c, r"""(?is)<(\w+)\b[^>]*style\s*=\s*["'][^"']*display\s*:\s*none[^"']*["'][^>]*>.*?</\1\s*>""", " ")
    c = F.regexp_replace(c, rf"(?is)<table\b(?:(?!</table>)\D)*+(?:\d(?:(?!</table>)\D)*+){{{most_digits + 1},}}+</table>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"</?[A-Za-z][^<>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&#160;", " "), ("&mdash;", "—"), ("&#8217;", "’"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return tighten_money(normalised(c))


def article_text(c: Column) -> Column:
    """Text of the element with id article, else content, else body, else all."""
    inner = [F.regexp_extract(c, rf"""(?is)<div\b[^>]*\bid\s*=\s*["']{name}["'][^>]*>(.*?)</div>""", 1) for name in ("article", "content")]
    body = F.regexp_extract(c, r"(?is)<body\b[^>]*>(.*?)</body>", 1)
    first = F.coalesce(*[F.when(x != "", x) for x in (*inner, body)], c)
    return normalised(F.regexp_replace(F.regexp_replace(first, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]+>", " "))


def sentences(c: Column, most_words: int = 400, cut_words: int = 250) -> Column:
    """Sentences, trimmed, none empty; one of more than most_words words is cut every cut_words words."""
    parts = F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")

    def cut(s: Column) -> Column:
        w = F.split(s, r"\s+")
        starts = F.sequence(F.lit(1), F.size(w), F.lit(cut_words))
        return F.when(F.size(w) > most_words, F.transform(starts, lambda i: F.array_join(F.slice(w, i, cut_words), " "))).otherwise(F.array(s))

    return F.flatten(F.transform(parts, cut))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def claim_sentences(c: Column) -> Column:
    """Sentences of more than four words that aren't headings."""
    parts = F.transform(F.split(c, r"(?<=[.!?])\s+|\n+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: (word_count(s) > 4) & ~s.rlike(HEADING))


def citations(c: Column) -> Column:
    return _all(c, CITATION, 1)


def question_overlap(question: Column, snippet: Column) -> Column:
    """Share of the question's distinct words in the snippet; 0 without words."""
    q = F.array_distinct(metric_words(question))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, metric_words(snippet))) / F.size(q))


def question_key(c: Column) -> Column:
    return F.array_join(F.array_sort(metric_words(c)), " ")


def verbatim(snippet: Column, passage: Column, least_words: int = 10) -> Column:
    """The snippet has least_words words and stands in the passage as a run of words."""
    s, p = metric_words(snippet), metric_words(passage)
    pad = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    return (F.size(s) >= least_words) & pad(p).contains(pad(s))


def zip3(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(\d{3})", 1), F.lit(""))


def json_from_prose(reply: Column, schema: str) -> Column:
    """The outermost braces of a reply parsed as JSON, or null."""
    return F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), schema)


# Readable names of issuers, sections and forms.
ISSUERS = {"JPM": "JPMorgan Chase", "BAC": "Bank of America", "C": "Citigroup", "WFC": "Wells Fargo", "GS": "Goldman Sachs", "COF": "Capital One", "SYF": "Synchrony Financial", "DFS": "Discover Financial", "AXP": "American Express", "USB": "U.S. Bancorp"}
SECTIONS = {"item_1a_risk_factors": "Item 1A, Risk Factors", "item_7_mda": "Item 7, Management's Discussion and Analysis", "item_7a_market_risk": "Item 7A, Quantitative and Qualitative Disclosures About Market Risk", "full_document": ""}
FORMS = {"complaint": "consumer complaint", "10-K": "annual report (10-K)", "10-Q": "quarterly report (10-Q)", "8-K": "current report (8-K)", "minutes": "meeting minutes", "statement": "policy statement"}
# Section headings of an annual report.
SECTION_PATTERNS = {
    "item_1a_risk_factors": r"item\s*1a[\.\s\-–—:]*risk\s*factors(.*?)item\s*1b",
    "item_7_mda": r"item\s*7[\.\s\-–—:]*management.{0,10}s\s*discussion(.*?)item\s*7a",
    "item_7a_market_risk": r"item\s*7a[\.\s\-–—:]*quantitative(.*?)item\s*8",
}


def _named(c: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.coalesce(c, F.lit("")))


def context_header(source: Column, ticker: Column, form: Column, date: Column, section: Column) -> Column:
    """One line that tells who, what, when and where; for the text to embed, never for the stored text."""
    filled = lambda c, other: F.when(c.isNull() | (c == ""), F.lit(other)).otherwise(c)
    date, kind = filled(date, "undated"), F.coalesce(_named(form, FORMS), filled(form, "filing"))
    product = F.lower(F.trim(F.coalesce(section, F.lit(""))))
    about = F.when(product != "", F.concat(F.lit(" about a "), product)).otherwise(F.lit(""))
    name = _named(ticker, ISSUERS)
    who = F.when(source == "fomc", F.lit("Federal Open Market Committee")).when(name.isNotNull(), F.concat(name, F.lit(" ("), ticker, F.lit(")"))).otherwise(filled(ticker, "Unknown issuer"))
    place = F.coalesce(_named(section, SECTIONS), F.replace(F.coalesce(section, F.lit("")), F.lit("_"), F.lit(" ")))
    where = F.when(place != "", F.concat(F.lit(", "), place)).otherwise(F.lit(""))
    return F.when(source == "cfpb", F.concat(F.lit("Consumer complaint to the CFPB"), about, F.lit(", "), date, F.lit("."))).otherwise(F.concat(who, F.lit(" "), kind, F.lit(", "), date, where, F.lit(".")))


def sections(c: Column, least_chars: int = 5000, patterns: dict[str, str] | None = None) -> Column:
    """array<struct<name, text>>: the longest match of each heading pattern if it is long enough, else the whole text as full_document."""
    found = []
    for name, p in (patterns or SECTION_PATTERNS).items():
        bodies = F.regexp_extract_all(c, F.lit(f"(?is){p}"), F.lit(1))
        longest = F.array_max(F.transform(bodies, lambda b, i: F.struct(F.length(b).alias("n"), (-i).alias("i"), b.alias("b"))))["b"]
        found.append(F.struct(F.lit(name).alias("name"), F.when(F.length(longest) > least_chars, longest).alias("text")))
    some = F.filter(F.array(*found), lambda s: s["text"].isNotNull())
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.struct(F.lit("full_document").alias("name"), c.alias("text"))))
