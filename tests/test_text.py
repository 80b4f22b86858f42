"""Text functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from evispark.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_ngrams_of_short_and_long_texts(spark):
    g = lambda t, n: one(spark, t, lambda c: T.word_ngrams(T.metric_words(c), n))
    assert g("a b c d", 3) == ["a b c", "b c d"]
    assert g("a b", 3) == ["a b"]
    assert g("", 3) == []
    assert g("a a a a", 3) == ["a a a"]


def test_figures_drop_separators_and_trailing_zeros(spark):
    assert sorted(one(spark, "1,234 and 5.0 and 5.50, 7", T.figures)) == ["1234", "5", "5.5", "7"]
    assert one(spark, "5,6", T.figures) == ["56"]


@pytest.mark.parametrize(("raw", "want"), [("Item 1A. Risk", "item_1a_risk"), (None, "unknown"), ("", "unknown"), ("--A--", "a")])
def test_slug(spark, raw, want):
    assert one(spark, raw, T.slug) == want


def test_chunk_id_keeps_more_than_three_digits(spark):
    assert one(spark, 1234, lambda c: T.chunk_id(F.lit("D"), F.lit("Full doc"), c), "int") == "D_full_doc_1234"


def test_tighten_money(spark):
    assert one(spark, "$ 1.2 and ( 1,234 ) and 5.25 %", T.tighten_money) == "$1.2 and (1,234) and 5.25%"


def test_html_drops_hidden_parts_and_tables_of_figures(spark):
    table = "<table>" + "<tr><td>123</td></tr>" * 80 + "</table>"
    html = f"<p>Kept &amp; read</p><script>no</script><ix:hidden>no</ix:hidden><div style='display:none'>no</div>{table}<table><tr><td>12</td></tr></table>"
    assert one(spark, html, T.html_to_text) == "Kept & read 12"


def test_article_body(spark):
    assert one(spark, "<body><div id='article'><p>A  b</p></div>c</body>", T.article_text) == "A b"
    assert one(spark, "<body>x <b>y</b></body>", T.article_text) == "x y"


def test_sentences_cut_runaway_ones(spark):
    assert one(spark, "One. Two! Three", T.sentences) == ["One.", "Two!", "Three"]
    assert [len(s.split()) for s in one(spark, "w " * 600, T.sentences)] == [250, 250, 100]
    assert one(spark, "  ", T.sentences) == []


def test_claims_leave_out_headings_and_short_lines(spark):
    text = "# A heading of more than four words\nThis is a claim of words [S1]. Short one.\n**Bold line of five words**\nAnother claim without any mark here."
    assert len(one(spark, text, T.claim_sentences)) == 2


def test_headers(spark):
    rows = [("edgar", "JPM", "10-K", "2024-02-16", "item_7_mda"), ("fomc", None, "minutes", "2024-01-31", "full_document"), ("cfpb", None, "complaint", "2024-03-01", "Credit card"), ("edgar", "ZZZ", None, None, "other_part"), ("edgar", None, "10-Q", "2024-05-01", None)]
    df = spark.createDataFrame(rows, "source string, ticker string, form string, date string, section string")
    got = [r[0] for r in df.select(T.context_header(*[F.col(c) for c in df.columns])).collect()]
    assert got == [
        "JPMorgan Chase (JPM) annual report (10-K), 2024-02-16, Item 7, Management's Discussion and Analysis.",
        "Federal Open Market Committee meeting minutes, 2024-01-31.",
        "Consumer complaint to the CFPB about a credit card, 2024-03-01.",
        "ZZZ filing, undated, other part.",
        "Unknown issuer quarterly report (10-Q), 2024-05-01.",
    ]


def test_sections_take_the_longest_match_or_the_whole(spark):
    text = "Item 1A. Risk Factors 3 Item 1B x Item 1A. Risk Factors " + "r" * 60 + " Item 1B"
    got = one(spark, text, lambda c: T.sections(c, 50))
    assert [(s["name"], len(s["text"])) for s in got] == [("item_1a_risk_factors", 62)]
    assert one(spark, "nothing", T.sections)[0]["name"] == "full_document"


def test_verbatim_overlap_json_zip(spark):
    df = spark.createDataFrame([("one two three four five six seven eight nine ten", "x one two three four five six seven eight nine ten y")], "s string, p string")
    assert df.select(T.verbatim(F.col("s"), F.col("p"))).first()[0]
    assert one(spark, "a b c d", lambda c: T.question_overlap(c, F.lit("a b x"))) == 0.5
    assert one(spark, 'Sure: {"sub_questions": ["a"]} ok', lambda c: T.json_from_prose(c, "sub_questions array<string>")["sub_questions"]) == ["a"]
    assert one(spark, "no json", lambda c: T.json_from_prose(c, "a string")["a"]) is None
    assert one(spark, "123XX", T.zip3) == "123"
    assert one(spark, "XXXXX", T.zip3) is None
