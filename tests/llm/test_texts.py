"""Splitting, ranking, markup, broken pairs, mixing, text quality."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evispark.llm import broken_pairs as bp
from evispark.llm import fused_ranking as fr
from evispark.llm import markup as mu
from evispark.llm import mixing as mi
from evispark.llm import queries as q
from evispark.llm import split_oversized as so
from evispark.llm import text_quality as tq


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab c.\n,é\u0301漢", max_size=900), st.integers(20, 120), st.integers(0, 19))
def test_pieces_round_trip(text, limit, overlap):
    bounds = so.piece_bounds(text, limit, overlap)
    assert all(b - a <= limit for a, b in bounds)
    assert text[bounds[0][0] : bounds[0][1]] + "".join(text[x[1] : y[1]] for x, y in zip(bounds, bounds[1:], strict=False)) == text
    assert all(overlap <= x[1] - y[0] <= overlap + overlap // 4 for x, y in zip(bounds, bounds[1:], strict=False))
    assert len(bounds) == max(1, -(-(len(text) - overlap) // (limit - overlap)))


def test_pieces_are_as_few_as_possible_and_begin_at_words():
    rng = random.Random(2)
    begun = pieces = 0
    for _ in range(200):
        text = " ".join("x" * rng.randrange(1, 12) + rng.choice(["", "", "", ".", ",", ".\n\n"]) for _ in range(rng.randrange(450, 3000)))
        bounds = so.piece_bounds(text, 2400, 200)
        assert len(bounds) == max(1, -(-(len(text) - 200) // 2200))
        begun += sum(text[a - 1].isspace() and not text[a].isspace() for a, _ in bounds[1:])
        pieces += len(bounds) - 1
        assert all(b - a <= 2400 for a, b in bounds)
    assert begun >= 0.97 * pieces


def test_pieces_are_balanced_and_snap():
    text = " ".join(f"Sentence number {i} ends here." for i in range(200))
    bounds = so.piece_bounds(text, 2400, 200)
    assert len(bounds) == -(-(len(text) - 200) // 2200)
    assert all(text[:b].rstrip().endswith(".") for _, b in bounds)
    sizes = [b - a for a, b in bounds]
    assert max(sizes) - min(sizes) < 300


def test_split_handles_null_empty_and_clashes(spark):
    df = spark.createDataFrame([("a", None, None), ("b", "", "s"), ("c", "x" * 5000, "s"), ("c", "x" * 5000, "s"), ("d", "y" * 2400, None)], "chunk_id string, text string, section string").withColumn("piece_no", F.lit("clash"))
    got = so.split_oversized(df)
    assert {r["id"]: r["count"] for r in got.groupBy("id").count().collect()} == {"b": 1, "c": 3, "d": 1}
    assert got.where("id = 'c'").select("section").distinct().first()[0] == "s"
    assert so.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        so.split_oversized(df, limit=100, overlap=100)


def _hits(spark, rows):
    return spark.createDataFrame(rows, "query_id string, retriever string, chunk_id string, score double, rank int")


def test_leximin_equals_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for query in ("q1", "q2", None):
        for r in ("bm25", "distance", "rerank", "other"):
            for c in rng.sample("abcdefgh", 6):
                rows.append((query, r, c, rng.choice([None, float("nan"), 0.0, -0.0, 1.0, 2.0, 5.5]), None))
    rows += rows[:3]
    kinds = spark.createDataFrame([("bm25", "higher"), ("distance", "lower"), ("rerank", "higher")], "retriever string, better string")
    best = {}
    for query, r, c, s, _ in rows:
        if query is None or s is None or s != s:
            continue
        good = -s if r == "distance" else s
        best[query, r, c] = max(good, best.get((query, r, c), -1e9))
    pct, lists = {}, {}
    for (query, r, c), g in best.items():
        own = [v for (a, b, _), v in best.items() if (a, b) == (query, r)]
        pct[query, r, c] = 1.0 if len(own) == 1 else (sum(v < g for v in own) + 0.5 * (own.count(g) - 1)) / (len(own) - 1)
        lists.setdefault(query, set()).add(r)
    vec = {}
    for query, c in {(a, c) for a, _, c in best}:
        vec[query, c] = sorted(pct.get((query, r, c), 0.0) for r in lists[query])
    order = {query: sorted((c for a, c in vec if a == query), key=lambda c: ([-x for x in vec[query, c]], c)) for query in lists}
    got = fr.leximin_ranking(_hits(spark, rows), kinds).collect()
    assert {(r["query_id"], r["chunk_id"]): r["rank"] for r in got} == {(a, c): i for a, cs in order.items() for i, c in enumerate(cs, 1)}
    assert fr.leximin_ranking(_hits(spark, []), kinds).count() == 0


def test_no_scale_decides_alone(spark):
    rows = [("q", "a", "x", 1e9, 1), ("q", "a", "y", 1.0, 2), ("q", "a", "z", 0.5, 3), ("q", "b", "x", 0.1, 3), ("q", "b", "y", 0.2, 2), ("q", "b", "z", 0.3, 1)]
    kinds = spark.createDataFrame([("a", "higher")], "retriever string, better string")
    assert fr.leximin_ranking(_hits(spark, rows), kinds).where("rank = 1").first()["chunk_id"] == "y"


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("plain <5% and >3, R&D, M&A & more, {$12.50}, [S1], $5 to $7", []),
        ("a <b>bold</b> word", ["html"]),
        ("a &#160; b", ["html"]),
        ("&lt;em&gt;x&lt;/em&gt;", ["html"]),
        ("x <!-- note --> y", ["html"]),
        ("<ix:nonFraction name='a'>5</ix:nonFraction>", ["html"]),
        ("see [text](https://x.example/a)", ["markdown"]),
        ("use `code_1` here", ["markdown"]),
        ("# Heading\ntext", ["markdown"]),
        ("Title of this\n=====\ntext", ["markdown"]),
        ("a **bold word** here", ["markdown"]),
        ("- [ ] do it", ["markdown"]),
        ("| a | b |\n|---|---:|\n| 1 | 2 |", ["markdown"]),
        ("*** standing line ***\n- another one\n[a third]\n--- x ---", []),
        ("**whole line set off**", []),
        ("see note 35* and item [S2]; code A619_B9_A", []),
        ("== Heading ==\nx", ["wiki"]),
        ("Growth of 33% == plan [see Tam]", []),
        ("a [[Link|text]] b", ["wiki"]),
        ("{{cite|a=b}}", ["wiki"]),
        ("it is ''odd'' so", ["wiki"]),
        ("{| class='w'\n|-\n| a || b\n|}", ["wiki"]),
        (r"\begin{itemize}\item x\end{itemize}", ["latex"]),
        (r"a \emph{word} b", ["latex"]),
        (r"sum $\sigma^2 = 1$ b", ["latex"]),
        (r"\(x_{1} \leq 3\)", ["latex"]),
        (r"Path C:\Users\item.txt and \\server\share", []),
        ("", []),
    ],
)
def test_markup_kinds(text, kinds):
    assert mu.markups_of(text) == kinds


def test_clean_text_keeps_structure():
    clean = lambda t: mu.clean(t)[0]
    assert clean("<h2>Title</h2><p>A &amp; b</p><ul><li>one</li><li>two</li></ul><pre>x = 1</pre>") == "## Title\nA & b\n- one\n- two\n```\nx = 1\n```"
    assert clean("<table><tr><td>a</td><td>1</td></tr></table>") == "a | 1"
    assert clean("[text](https://x.example) and **bold** `c*d*`\n```sql\nselect **x**\n```") == "text and bold `c*d*`\n```\nselect **x**\n```"
    assert clean("== H ==\nsee [[A|b]] '''c''' {{convert|5|usd}}") == "## H\nsee b c 5 usd"
    assert clean(r"\section{H} \begin{itemize}\item a $\frac{1}{2}$\end{itemize} \underline{{$5}}").split("\n")[0] == "# H"
    assert r"$\frac{1}{2}$" in clean(r"\emph{a} $\frac{1}{2}$")
    assert clean("Title here\n====\nx") == "# Title here\nx"
    assert clean("as it stands  ") == "as it stands  "


def test_link_lines_outside_the_content_go():
    nav = "".join(f"<div><a href='/{i}'>Link {i}</a></div>" for i in range(6))
    body = "".join(f"<p>{'A long sentence of the article itself. ' * 6}</p>" for _ in range(5))
    out = mu.from_html(nav + body)
    assert "Link 2" not in out and out.count("article") == 30


def test_clean_markup_frames(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "x <b>y</b>" * 20000)], "chunk_id string, text string").withColumn("id", F.lit(1)).withColumn("markups", F.lit(2))
    got = {r["id"]: r for r in mu.clean_markup(df).collect()}
    assert set(got) == {"b", "c"} and got["b"]["text"] == "" and got["c"]["markups"] == ["html"]
    assert mu.clean_markup(df.limit(0)).count() == 0


FUNCTION = [("en", w) for w in "a the of and to in is was that on for by with at from it be as are not".split()] + [("es", w) for w in "el la de los que en un una por con para del se las su al".split()]


def _pairs(spark):
    rng = random.Random(3)
    rows = []
    names = ["Alder Bank", "Birch Trust", "Cedar Capital", "Dogwood Financial"]
    for k in range(240):
        a, b, n = rng.choice(names), rng.choice(names), rng.randrange(100, 999)
        question = f"How did the net income of {a} in {2015 + k % 9} compare with that of {b} by the end of the year?"
        sound = f"The net income of {a} rose to ${n} million on the back of fees in the period [S1]. At {b} it was not to recover from the {n % 90} percent fall in deposits that was reported [S2]."
        spanish = f"El margen de la entidad subió a {n} millones en el trimestre por los depósitos de la red. La cartera de los clientes cayó un {n % 90} por ciento con las oficinas."
        kind = k % 8
        answer, defect = {
            0: (sound, None), 1: (sound, None), 2: (f"${n} million [S1]", None), 3: (" ".join(sound.split()[: rng.randrange(9, 16)]) + rng.choice([" of the", ",", " ..."]), "truncated"),
            4: (rng.choice(["I am unable to answer that question from the sources.", "Sorry, I cannot help with this request. Thank you for understanding.", "There is not enough information in the material to respond."]), "refusal"),
            5: (rng.choice([question, "Question: " + question, question.lower(), question.upper(), question + " " + question]), "copied_question"), 6: (spanish, "other_language"), 7: (rng.choice([None, "", " \u200b", "N/A", "[S1]", "...", "null"]), "empty"),
        }[kind]
        rows.append(("t", f"k{k}", question, answer, False, defect))
    rows.append(("t", "no1", rows[0][2], "INSUFFICIENT_CONTEXT: nothing covers it.", True, None))
    rows.append(("t", "no2", rows[0][2], "INSUFFICIENT_CONTEXT: nothing covers it.", False, "refusal"))
    rows.append(("t", "no3", None, None, None, "empty"))
    return spark.createDataFrame(rows, "pair_table string, pair_key string, question string, answer string, abstained boolean, want string")


def test_defects_on_held_out_accuracy(spark):
    df = _pairs(spark)
    words = spark.createDataFrame(FUNCTION, "lang string, word string")
    got = bp.broken_pairs(df, words).join(df.select("pair_key", "want"), "pair_key").collect()
    wrong = [(r["pair_key"], r["want"], r["defect"], r["tags"]) for r in got if r["want"] != r["defect"]]
    assert len(got) == 243 and len(wrong) <= 5, wrong
    assert bp.broken_pairs(df.limit(0), words).count() == 0


def test_the_last_logged_row_counts(spark):
    a = spark.sql("select 'x' as trace_id, 'i' as id, 'old' as answer, false as abstained, timestamp'2024-01-01' as logged_at union all select 'x', 'i', 'new', null, timestamp'2024-01-02' union all select null, 'i', 'z', null, null")
    d = spark.createDataFrame([("i", "q?", "g"), ("i", "q?", "g")], "id string, question string, ground_truth string")
    got = {(r["pair_table"], r["pair_key"]): (r["question"], r["answer"]) for r in bp.logged_pairs(a, d).collect()}
    assert got == {("answers", "x"): ("q?", "new"), ("drafts_multihop", "i"): ("q?", "g")}


def test_crf_learns_a_chain():
    lang = bp.Languages(FUNCTION)
    parts = [["It rose in 2020.", "It fell by 5% and the"]] * 3 + [["It rose by 3%."]]
    c = bp.measure(["What was it?"] * 4, parts, bp.Vocabulary(lang, bp.NO_LEXICON))
    y, sizes = np.array([0, 4] * 3 + [0]), np.array([2, 2, 2, 1])
    m = bp.train(c.x, y, sizes, rounds=80)
    assert bp.tag(c.x, sizes, m).tolist() == y.tolist()


@pytest.fixture(scope="module")
def pair_model():
    rng = random.Random(9)
    lang = bp.Languages(FUNCTION)
    names = ["Alder Bank", "Birch Trust", "Cedar Capital", "Dogwood Financial"]
    sample = [(f"How did the income of {rng.choice(names)} in {2015 + k % 9} compare with that of {rng.choice(names)}?", f"The income rose to ${rng.randrange(100, 999)} million on the back of fees in the period. It was not to recover from the {k % 90} percent fall in deposits that was reported.") for k in range(300)]
    return bp.fit(sample, lang), lang, [q for q, _ in sample]


# none of these is among the phrases the lexicon starts from
HELD_OUT = ("I'm afraid this falls outside what I can comment on.", "None of the retrieved pages says anything about it.", "I don't know the answer to that.", "There isn't enough context here for me to respond.", "Sorry, that is not something I can provide.", "My instructions prevent me from answering this.", "We are unable to determine this from the sources.", "The question cannot be answered with the data provided.")


def test_declines_in_words_held_out_of_training(pair_model):
    m, lang, asked = pair_model
    got = bp.defects([asked[i] for i in range(len(HELD_OUT))], HELD_OUT, [False] * len(HELD_OUT), m, lang)
    assert sum(d == "refusal" for d, _ in got) >= len(HELD_OUT) - 1, got
    sound = ["No.", "Neither did.", "$5 million", "It was unable to renew 5 percent of the lines in 2020."]
    assert [d for d, _ in bp.defects([asked[0]] * 4, sound, [None] * 4, m, lang)] == [None] * 4


def test_chains_of_any_length_and_bracketed_answers(pair_model):
    m, lang, asked = pair_model
    long = " ".join(f"The income rose by {i} percent in the year." for i in range(60))
    got = bp.defects([asked[0], asked[0], None, asked[1]], [long, long + " It fell in the quarter by the", "The income rose to $120 million in the period. It was up by 5 percent.", "[the 2023 figure, 12%]"], [None] * 4, m, lang)
    assert [d for d, _ in got] == [None, "truncated", None, None]
    assert len(got[0][1]) == 60
    assert bp.is_empty("[insert answer here]") and bp.is_empty("[S1][S2]") and not bp.is_empty("[the 2023 figure, 12%]")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("ab ", max_size=30), st.lists(st.text("ab ", max_size=20), max_size=4)), max_size=5))
def test_runs_over_arrays_equal_one_by_one(rows):
    v = bp.Vocabulary(bp.Languages(FUNCTION), bp.NO_LEXICON)
    parts = [[c for c in p if c.split()] for _, p in rows]
    c = bp.measure([q for q, _ in rows], parts, v)
    want = [bp._run(q.split(), x.split()) / len(x.split()) for (q, _), p in zip(rows, parts, strict=True) for x in p]
    assert c.x[:, 1].tolist() == pytest.approx(want)


def test_too_many_words_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(bp, "MOST_WORDS", 3)
    with pytest.raises(ValueError, match="too many"):
        bp.broken_pairs(_pairs(spark), spark.createDataFrame(FUNCTION, "lang string, word string"))


def test_budgets_spread_what_is_missing():
    b = mi.token_budgets([("a", 0.5, 1, 100), ("b", 0.3, 4, 1000), ("c", 0.2, 1, 0)], 1000)
    assert b["a"] == 100 and b["c"] == 0 and b["b"] == pytest.approx(900)
    assert mi.token_budgets([("a", 1.0, 1, 10)], 1000) == {"a": 10.0}
    assert mi.token_budgets([], 5) == {}


def test_mixing_reaches_the_shares(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "a", "b", "b", "c", None, "x"]), " ".join(["word"] * rng.randrange(1, 60))) for i in range(3000)] + [(9000, "a", ""), (9001, "b", None), (0, "dup", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("tokens", F.lit("clash"))
    t = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 4), ("c", 0.19, 5), ("none", 0.01, 3)], "source string, target_share double, max_repeats int")
    mixed = mi.mix_sources(df, t)
    total = mixed.agg(F.sum("tokens")).first()[0]
    s = {r["source"]: r.asDict() | {"total": total} for r in mi.mix_shares(mixed, t).collect()}
    for k, share in (("a", 0.4), ("b", 0.4), ("c", 0.19)):
        assert abs(s[k]["used_tokens"] - share / 0.99 * s[k]["total"]) <= 60  # one document
        assert s[k]["most_copies"] <= {"a": 1, "b": 4, "c": 5}[k]
    assert s["none"]["used_tokens"] == 0
    assert mi.mix_sources(df.limit(0), t).count() == 0


def test_one_hot_size_and_few_documents_meet_their_budgets(spark):
    rows = [(i, "hot", "word " * 7) for i in range(900)] + [(1000 + i, "few", "word " * (5 + 13 * i)) for i in range(9)] + [(2000 + i, "rest", "word " * (1 + i % 40)) for i in range(600)]
    t = spark.createDataFrame([("hot", 0.35, 2), ("few", 0.06, 3), ("rest", 0.59, 1)], "source string, target_share double, max_repeats int")
    mixed = mi.checkpointed(mi.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string"), t))
    most = {"hot": 2, "few": 3, "rest": 1}
    by = {r["source"]: r for r in mi.mix_shares(mixed, t).collect()}
    total = mixed.agg(F.sum("tokens")).first()[0]
    budgets = mi.token_budgets([(r["source"], r["target_share"], r["max_repeats"], r["tokens"]) for r in by.values()], total)
    for k, r in by.items():
        assert abs(r["used_tokens"] - budgets[k]) <= 8 and r["most_copies"] <= most[k], (k, r, budgets)
    assert mixed.groupBy("doc_id").count().where("count > 1").count() == 0


def test_rates_that_do_not_converge_are_an_error(spark):
    c = spark.createDataFrame([("a", 5, 3), ("a", 9, 2)], "source string, tokens long, n long")
    with pytest.raises(ValueError, match="converge"):
        mi.balancing_rates(c, {"a": 11.0}, {"a": 1}, most_steps=1)


def test_short_sources_give_all_they_may(spark):
    df = spark.createDataFrame([(i, "big" if i else "small", "word " * 20) for i in range(100)], "doc_id long, source string, text string")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3)], "source string, target_share double, max_repeats int")
    mixed = mi.mix_sources(df, t)
    assert mixed.where("source = 'small'").first()["copies"] == 3
    assert mixed.agg(F.sum("copies")).first()[0] == pytest.approx(100, abs=2)


PROSE = "The bank said that the rate of the loan was not to be changed in the year, and that the clients who had asked for it would be told by mail. It is the view of the board that this was for the good of all. "


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (PROSE * 3, "prose"),
        (PROSE.upper() * 3, "prose"),
        (PROSE.replace(".", "").replace(",", "").lower() * 3, "prose"),
        ("\n".join(f"- Alder branch in Town {chr(65 + i)}" for i in range(20)), "list"),
        ("\n".join(f"{i}. Office of Birch Hill, May {i}, 2020" for i in range(1, 20)), "list"),
        ("\n".join(f"https://x.example/p{i}/a.htm" for i in range(20)), "list"),
        ("\n".join(f"income {i}12.5 | {i}3.1% | ({i}7) | -" for i in range(20)), "table"),
        ("net income," + ",".join(f'"{i},100.5",{i}' for i in range(40)), "table"),
        ("loading " * 60, "junk"),
        ("ERROR" * 100, "junk"),
        ("----------\n=====\n~~~~~~~" * 5, "junk"),
        ("xqzt vkpw;rr jhgq zzxw ptkl;w qqr mnbv zxcv ytrw lkjh " * 6, "junk"),
        ("", "empty"),
        (" \n ", "empty"),
    ],
)
def test_kinds_of_text(text, kind):
    c = tq._Classes(frozenset(w for _, w in FUNCTION))
    assert tq.describe([text], c)[0]["kind"] == kind


@pytest.mark.parametrize(
    "text",
    [
        "Bank poinformował, że stopa procentowa kredytu nie zmieni się w tym roku. Klienci, którzy o to pytali, dostaną list do końca miesiąca. Zarząd uważa, że to dobra decyzja dla wszystkich, bo koszty są niższe niż rok temu.",
        "De bank heeft gezegd dat de rente van de lening dit jaar niet zal worden gewijzigd. Klanten die daarom hadden gevraagd, krijgen een brief. Het bestuur is van mening dat dit voor iedereen goed is, ook voor de kleine spaarders.",
        "Банк сообщил, что ставка по кредиту в этом году не изменится. Клиенты, которые об этом просили, получат письмо. Правление считает, что это хорошо для всех.",
        "銀行は、今年の貸出金利を変更しないと発表しました。問い合わせをした顧客には書面で通知します。取締役会は、これがすべての人にとって良いことだと考えています。",
        "Η τράπεζα ανακοίνωσε ότι το επιτόκιο του δανείου δεν θα αλλάξει φέτος. Οι πελάτες που το ζήτησαν θα λάβουν επιστολή. Το συμβούλιο θεωρεί ότι αυτό είναι καλό για όλους.",
        "Banken meddelade att räntan på lånet inte kommer att ändras i år. Kunder som har frågat om det får ett brev. Styrelsen anser att det är bra för alla, och att det blir så även nästa år.",
        "La banca ha detto che il tasso del prestito non sarà cambiato in questo anno. I clienti che lo hanno chiesto avranno una lettera. Il consiglio pensa che sia un bene per tutti, e non solo per i soci.",
    ],
)
def test_prose_of_languages_without_a_profile(text):
    c = tq._Classes(frozenset(w for _, w in FUNCTION))
    assert tq.describe([text], c)[0]["kind"] == "prose"


@pytest.mark.parametrize(("text", "kind"), [("\n".join(["Варшава", "Краков", "Гданьск", "Познань", "Лодзь", "Щецин"] * 4), "list"), ("gur onax fnvq gung gur engr bs gur ybna jnf abg gb or punatrq. gur pyvragf jub unq nfxrq jbhyq or gbyq ol znvy. vg vf gur ivrj bs gur obneq.", "junk")])
def test_what_only_looks_like_unknown_prose(text, kind):
    c = tq._Classes(frozenset(w for _, w in FUNCTION))
    assert tq.describe([text], c)[0]["kind"] in (kind, "list", "junk")


def test_statistics(spark):
    words = spark.createDataFrame(FUNCTION, "lang string, word string")
    df = spark.createDataFrame([(1, "The cat is big.\nno end"), (2, ""), (3, None), (1, "The cat is big.\nno end"), (4, "w " * 100000)], "doc_id long, text string").withColumn("kind", F.lit("clash"))
    got = {r["doc_id"]: r for r in tq.text_quality(df, words).collect()}
    assert set(got) == {1, 2, 4}
    r = got[1]
    assert (r["n_words"], r["line_punctuation"]) == (6, 0.5)
    assert r["mean_word_length"] == pytest.approx((3 + 3 + 2 + 3 + 2 + 3) / 6)
    assert r["symbol_ratio"] == pytest.approx(1 / 22)
    assert r["common_words"] == pytest.approx(2 / 6)
    assert got[2]["kind"] == "empty" and got[2]["common_words"] is None
    assert got[4]["n_words"] == 100000
    assert tq.text_quality(df.limit(0), words).count() == 0


def test_every_query_with_sql_is_registered():
    assert set(q.oracle_sql()) <= set(q.queries())
    assert {f"p{n}_found" for n in range(1, 11) if n != 9} <= set(q.queries())
