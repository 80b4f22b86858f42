"""The markup cleaner: nothing visible is lost, code and formulas stay as they are, long texts end."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from evispark.llm import markup as mu


def _clean(text):
    return mu.clean(text)[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<p>Intro</p><noscript>enable<p>The rest of the filing...</p><p>More.</p>", "Intro\nenable\nThe rest of the filing...\nMore."),
        ("<p>a</p><noscript>hidden</noscript><p>b</p>", "a\nb"),
        ("<p>a</p><script>if (x < 1) { y('<b>') }</script><p>b</p>", "a\nb"),
        ("```\n<div class='a'>hi</div>\n```", "```\n<div class='a'>hi</div>\n```"),
        (r"Let \(a<b\) and <b>bold</b>", r"Let \(a<b\) and bold"),
        ("<ul><li>one</li><li>two<ul><li>a</li><li>b</li></ul></li></ul>", "- one\n- two\n  - a\n  - b"),
        ("<ol start='3'><li>one</li><li>two</li></ol>", "3. one\n4. two"),
        ("<table>\n<tr>\n<td></td>\n<td></td><td>2</td></tr>\n<tr><td>a</td><td></td><td>3</td></tr></table>end", " |  | 2\na |  | 3\nend"),
        ("<pre>a\n  b &lt;div&gt;</pre>t &lt;em&gt;y&lt;/em&gt;", "```\na\n  b <div>\n```\nt y"),
        ("<p>a</p> if x <b and y> z <!-- open", "a\n if x <b and y> z <!-- open"),
        ("<code>left open<p>rest</p>", "left open\nrest"),
        (r"\begin{enumerate}\item a \item b\end{enumerate}", "1. a\n2. b"),
        ("\\begin{equation}\nx & y \\\\\n\\end{equation} \\emph{\\textbf{z}}", "\\begin{equation}\nx & y \\\\\n\\end{equation} z"),
        ("|a||2|\n|--|--|--|\n|b|c||", "a |  | 2\nb | c |"),
    ],
)
def test_structure_stays(text, want):
    assert _clean(text) == want


@pytest.mark.parametrize("text", ["[1](a)", "1. foo\n---\nx", "# of shares outstanding\nx", "a <b and c> d", "``a'' and ``b''", "R&D; AT&T", "<john@x.example> wrote"])
def test_what_is_no_markup(text):
    assert mu.markups_of(text) == []


def test_headings_and_formulas_of_any_length():
    long = "word " * 60 + "end"
    assert mu.markups_of(f"{long}\n-----\nx") == ["markdown"]
    assert mu.markups_of("so $" + "a_1 + " * 60 + "\\beta$ holds") == ["latex"]


def test_the_parser_decides():
    assert mu.markups_of('<img alt="a < b">') == ["html"]
    assert mu.markups_of("<note>x</note>") == ["html"] and mu.markups_of("<note> x") == []


def test_no_visible_word_is_lost():
    rng = random.Random(11)
    for _ in range(400):
        n, out = 0, []
        for _ in range(rng.randrange(1, 30)):
            kind = rng.randrange(12)
            w = [f"w{n + i}w" for i in range(rng.randrange(1, 4))]
            n += len(w)
            text = " ".join(w)
            tag = rng.choice("p div b i span em li td tr table ul ol h2 code pre noscript template script textarea foo".split())
            out.append(
                f"<{tag}>{text}</{tag}>" if kind < 4 and tag not in ("script", "noscript", "template") else f"<{tag} class='x'>{text}" if kind == 4 else f"{text}</{tag}>" if kind == 5 and tag not in ("script", "noscript", "template")
                else f"a < b {text} & c" if kind == 6 else f"\n```\n<b>{text}</b>\n```\n" if kind == 7 else rf" \({text} < 2\) " if kind == 8 else f"**{text}** `{text}`" if kind == 9 else f"<!-- {text}" if kind == 10 else f" \\textbf{{{text}}} == {text} ==\n{{|\n| {text} || \n|}}\n"
            )
        text = "".join(out)
        # an element that is hidden because a later piece happened to close it is no loss
        if re.search(r"<!--.*?-->|<(script|noscript|template)\b.*?</\1", text, re.S):
            continue
        lost = set(re.findall(r"w\d+w", text)) - set(re.findall(r"w\d+w", _clean(text)))
        assert not lost, (text, _clean(text))


def test_texts_that_repeat_a_mark_end():
    for piece in ("<!--", '<a b="', "```\n", "`a ", "``a ` ", "''a ", "\\(", "$$a ", "$a", "{{a ", "[[a", "**a ", "_a ", "<script>", "<ol><li>", "\\begin{equation}", "&a", "\\textbf{"):
        began = time.process_time()
        mu.clean(piece * 20_000)
        assert time.process_time() - began < 5, piece


def test_repeated_rows_count_once(spark):
    df = spark.createDataFrame([("a", "x <b>y</b>", 1), ("a", "x <b>y</b>", 2), ("a", "other", 1), ("b", "x <b>y</b>", 1), ("b", None, 1)], "chunk_id string, text string, url int").withColumn("_hash", F.lit("clash"))
    assert sorted((r["id"], r["text"]) for r in mu.clean_markup(df).collect()) == [("a", "other"), ("a", "x y"), ("b", "x y")]
