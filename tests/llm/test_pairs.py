"""Near-duplicates, shared spans, leaked items, repeated lines: each against brute force."""

import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest

from evispark.llm import _words as W
from evispark.llm import leaked_items as li
from evispark.llm import near_duplicates as nd
from evispark.llm import repeated_lines as rl
from evispark.llm import shared_spans as ss


def _edited(rng, words, share):
    out = list(words)
    for i in range(len(out)):
        if rng.random() < share:
            out[i] = f"new{rng.randrange(10**6)}"
    return out


def _grams(text, n):
    w = re.findall("[a-z0-9]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}, len(w)


def _alike(texts, n, t, least):
    g = {k: _grams(v, n) for k, v in texts.items() if v is not None}
    ids = sorted(k for k, (_, w) in g.items() if w >= least)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if g[a][0] | g[b][0] and len(g[a][0] & g[b][0]) >= t * len(g[a][0] | g[b][0]) - 1e-12}


def _closure(pairs):
    group = {}
    for a, b in pairs:
        x, y = group.get(a, {a}), group.get(b, {b})
        if x is not y:
            x |= y
        for k in x:
            group[k] = x
    return {(a, b) for g in {id(v): v for v in group.values()}.values() for a in g for b in g if a < b}


@pytest.mark.parametrize(("n", "t", "heavy"), [(3, 0.6, 30), (3, 0.6, 30_000), (5, 0.8, 30_000), (3, 0.5, 30_000), (3, 0.3, 30_000), (2, 0.2, 60)])
def test_near_duplicates_equal_brute_force(spark, words_of, monkeypatch, n, t, heavy):
    monkeypatch.setattr(nd, "HEAVY_ENTRIES", heavy)  # a low one cuts many columns into blocks of rows
    monkeypatch.setattr(nd, "GROUP_BLOCK", 3)
    rng = random.Random(7)
    texts = {}
    for k in range(40):
        base = words_of(k, rng.choice([60, 70, 130, 160, 170, 300, 480, 500, 900]))
        texts[f"p{k}"] = " ".join(base[: max(60, int(len(base) * rng.choice([0.22, 0.33, 0.55])))])
        texts[f"d{k}"] = " ".join(base)
        for j, share in enumerate((0.0, 0.02, 0.05, 0.08, 0.12)):
            e = _edited(rng, base, share)
            cut = rng.randrange(0, len(e) // 4)
            texts[f"d{k}_{j}"] = ("! ".join(e[cut:] if j % 2 else e)).upper()
    texts |= {"empty": "", "null": None, "short": "a b c", "same": " ".join(["x"] * 80), "same2": " ".join(["x"] * 90)}
    rows = list(texts.items()) + [("d0", texts["d0"])]
    df = spark.createDataFrame(rows, "chunk_id string, text string").withColumn("uid", nd.F.lit("clash"))
    want = _alike(texts, n, t, 60)
    got = nd.near_duplicate_groups(df, n=n, threshold=t)
    pairs = {(r[0], r[1]) for r in nd.group_pairs(got).collect()}
    assert len(want) > 40
    assert pairs == _closure(want)


def test_a_text_and_its_third_are_linked_at_three_tenths(spark, words_of):
    w = words_of(3, 450)
    rows = [("whole", " ".join(w)), ("third", " ".join(w[:150]))]
    g = nd.near_duplicate_groups(spark.createDataFrame(rows, "chunk_id string, text string"), n=3, threshold=0.3)
    assert g.select("group_id").distinct().count() == 1
    assert {r["group_id"] for r in nd.labelled(g).collect()} == {"third"}


def test_bounds_hold_in_blocks_of_any_size():
    """Two rows of 300 columns in a block that share the last 230."""
    one = np.array([0, 0], np.uint64)
    size, at = np.array([255, 255], np.int16), np.array([70, 70], np.int16)
    got = list(nd._multiply(one, np.arange(2, dtype=np.uint64), at, size, np.zeros(2, np.uint64), 0.6))
    assert sum(map(len, got)) == 1


def test_near_duplicates_of_nothing_and_of_many_copies(spark, words_of):
    df = spark.createDataFrame([], "chunk_id string, text string")
    assert nd.near_duplicate_groups(df).count() == 0
    text = " ".join(words_of(1, 80))
    rows = [(f"c{i:03d}", text) for i in range(30)] + [("other", text.replace(" ", ", ") + " end")]
    g = nd.near_duplicate_groups(spark.createDataFrame(rows, "chunk_id string, text string"))
    assert g.select("group_id").distinct().count() == 1
    assert {(r[0], r[1]) for r in nd.representative_pairs(g).collect()} == {("c000", "other")}
    assert nd.group_pairs(g).count() == 31 * 30 // 2


def test_no_pair_of_a_group_is_lost_however_many_copies(spark, words_of):
    text = " ".join(words_of(2, 80))
    rows = [(f"c{i:03d}", text if i % 2 else text.replace(" ", ", ", i)) for i in range(104)] + [(f"e{i}", f"{text} end{i}") for i in range(3)]
    g = nd.near_duplicate_groups(spark.createDataFrame(rows, "chunk_id string, text string"))
    ids = sorted(k for k, _ in rows)
    assert {(r[0], r[1]) for r in nd.group_pairs(g).collect()} == {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]}


def test_vectorised_words_equal_the_regex():
    texts = ["Ab-c 12,3 É x", "", "a" * 3000, "\u212a\u0130z q", "tab\tand\u00a0nbsp\u2003em", "x"]
    got = W.words(texts, alnum=True)
    assert got.counts.tolist() == [len(re.findall("[a-z0-9]+", t.lower())) for t in texts]
    own = W.words(texts, alnum=False)
    assert own.counts.tolist() == [len(t.split()) for t in texts]
    a, b = W.words(["one two one"], True).hash, W.words(["zz one"], True).hash
    assert a[0] == a[2] == b[1] and a[0] != a[1]


def test_covers_meet_any_two_positions():
    for v, d in ss.COVERS.items():
        for gap in range(v):
            assert any((x + gap) % v in d for x in d)
    assert ss.cover_of(30) == (13, (0, 1, 3, 9), 18)
    assert ss.cover_of(4) == (1, (0,), 4)


@pytest.mark.parametrize("least", [5, 12, 30])
def test_shared_runs_equal_brute_force(spark, words_of, least):
    rng = random.Random(least)
    right = {f"r{k}": words_of(k, 150) for k in range(30)}
    left = {}
    for k in range(60):
        src = right[f"r{rng.randrange(30)}"]
        a, n = rng.randrange(100), rng.choice([least - 1, least, least + 1, least + 9])
        left[f"l{k}"] = words_of(500 + k, rng.randrange(20)) + src[a : a + n] + words_of(900 + k, rng.randrange(20))

    def frame(rows):
        df = spark.createDataFrame([(k, " ".join(v)) for k, v in rows.items()] + [("null", None), ("empty", "")], "id string, text string")
        return df.withColumn("uid", nd.F.xxhash64("text"))

    def runs(w):
        return {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}

    l, r = frame(left), frame(right)
    got = ss.shared_runs(l, r, least)
    ids = got.join(l.selectExpr("uid uid_l", "id l"), "uid_l").join(r.selectExpr("uid uid_r", "id r"), "uid_r").collect()
    want = {(a, b) for a, x in left.items() for b, y in right.items() if runs(x) & runs(y)}
    assert {(x["l"], x["r"]) for x in ids} == want
    for x in ids:
        for run in x["runs"]:
            assert left[x["l"]][run["l"] : run["l"] + run["n"]] == right[x["r"]][run["r"] : run["r"] + run["n"]]
            assert run["n"] >= least


def test_hot_anchors_are_spread(spark, words_of, monkeypatch):
    monkeypatch.setattr(ss, "HOT_ENTRIES", 20)
    hot = words_of(1, 40)
    right = {f"r{k}": words_of(k + 50, 10) + (hot if k % 2 else words_of(k + 500, 40)) for k in range(200)}
    r = spark.createDataFrame([(k, " ".join(v)) for k, v in right.items()], "id string, text string").repartition(4).withColumn("uid", nd.F.xxhash64("text"))
    left = spark.createDataFrame([(" ".join(hot),), (" ".join(hot[:35]),)], "text string").withColumn("uid", nd.F.xxhash64("text"))
    messages = ss._packed(left, 0, 30, 12, None).unionByName(ss._packed(r, 1, 30, 12, None))
    assert len(ss._hot_anchors(messages, 12)[0]) > 3
    got = ss.shared_runs(left, r, 30).join(r.selectExpr("uid uid_r", "id"), "uid_r")
    assert got.groupBy("uid_l").count().where("count = 100").count() == 2
    assert {x["id"] for x in got.collect()} == {k for k in right if int(k[1:]) % 2}


def _common(a, b, least):
    return ss.common_runs(" ".join(a), " ".join(b), least)


def test_runs_hold_every_shared_word():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.choice("xyz") if rng.random() < 0.3 else f"w{i % 17}" for i in range(rng.randrange(120))] for _ in range(2))
        least = rng.choice([4, 6, 9, 14])
        runs = _common(a, b, least)
        assert all(a[i : i + n] == b[j : j + n] and n >= least for i, j, n in runs)
        both = {tuple(a[i : i + least]) for i in range(len(a) - least + 1)} & {tuple(b[i : i + least]) for i in range(len(b) - least + 1)}
        for text, side in ((a, 0), (b, 1)):
            want = {p for i in range(len(text) - least + 1) if tuple(text[i : i + least]) in both for p in range(i, i + least)}
            assert {p for r in runs for p in range(r[side], r[side] + r[2])} == want


def test_a_text_of_one_repeated_word_ends():
    began = time.process_time()
    runs = _common(["x"] * 100_000, ["x"] * 70_000, 30)
    assert len(runs) < 10 and time.process_time() - began < 5
    _common([f"w{i % 50}" for i in range(100_000)], [f"w{i % 49}" for i in range(100_000)], 30)
    assert time.process_time() - began < 10


def test_maximal_runs_and_shares(spark):
    a = [f"w{i}" for i in range(40)]
    assert _common(["x", *a, "y"], ["q", *a[:39]], 30) == [(1, 1, 39)]
    assert _common(a, a, 41) == []
    drafts = spark.createDataFrame([("q", [("d", " ".join(a)), (None, None)]), ("q", [("d", " ".join(a)), (None, None)]), ("z", None)], "id string, gold_spans array<struct<doc_id string, snippet string>>")
    chunks = spark.createDataFrame([("c", " ".join(["p", *a[:35]])), ("c", " ".join(["p", *a[:35]])), ("n", None)], "chunk_id string, text string")
    m = ss.snippet_matches(drafts, chunks)
    assert [(r["draft_id"], r["span_no"], r["chunk_id"]) for r in m.collect()] == [("q", 0, "c")]
    s = ss.shared_words(m, ["draft_id", "span_no"], "l").first()
    assert (s["shared_words"], s["n_partners"]) == (35, 1)
    drafts = drafts.unionByName(spark.createDataFrame([("y", [("d", "too short"), ("d", " ")])], drafts.schema))
    got = {(r["kind"], r["record"]): (r["shared_words"], r["words"], r["n_partners"]) for r in ss.share_report(ss.gold_snippets(drafts), chunks.unionByName(spark.createDataFrame([("e", "")], chunks.schema)), m).collect()}
    assert got == {("span", "q#0"): (35, 40, 1), ("span", "y#0"): (0, 2, 0), ("span", "y#1"): (0, 0, 0), ("chunk", "c"): (35, 36, 1), ("chunk", "e"): (0, 0, 0)}
    assert ss.snippet_matches(drafts.limit(0), chunks).count() == 0


def test_leaks_equal_brute_force(spark, words_of):
    rng = random.Random(4)
    items = {k: words_of(k, rng.choice([5, 11, 12, 13, 40])) for k in range(20)}
    docs = {}
    for k in range(80):
        src = items[rng.randrange(20)]
        n = rng.choice([0, 11, 12, 13, len(src)])
        a = rng.randrange(max(1, len(src) - n))
        docs[k] = words_of(100 + k, rng.randrange(60)) + src[a : a + n] + words_of(300 + k, rng.randrange(60))
    d = spark.createDataFrame([(k, ", ".join(v).upper()) for k, v in docs.items()] + [(900, None), (901, "")], "doc_id long, text string")
    i = spark.createDataFrame([(k, "s", "-".join(v)) for k, v in items.items()] + [(77, "s", None)], "item_id long, item_set string, text string")

    def runs(w):
        return {tuple(w[j : j + 12]) for j in range(len(w) - 11)}

    want = {(a, b) for a, x in items.items() for b, y in docs.items() if runs(x) & runs(y)}
    found = li.leaked_items(d, i)
    assert {(r["item_id"], r["doc_id"]) for r in found.collect()} == want and want
    per = defaultdict(int)
    for a, _ in want:
        per[a] += 1
    assert {r["item_id"]: r["n_docs"] for r in li.leak_report(found, i).collect()} == {k: per[k] for k in [*items, 77]}
    assert li.leaked_items(d, i.limit(0)).count() == 0


def test_leaks_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(li, "ITEMS_AT_ONCE", 1)
    text = " ".join(f"w{i}" for i in range(12))
    i = spark.createDataFrame([(1, text), (2, text + " more")], "item_id long, text string")
    d = spark.createDataFrame([(5, "x " + text)], "doc_id long, text string")
    assert {tuple(r) for r in li.leaked_items(d, i).collect()} == {(1, 5), (2, 5)}


def test_a_block_that_ends_no_pattern_shifts():
    p = li.build_patterns(li.item_words([(1, " ".join(f"w{i}" for i in range(12)))], 12))
    assert p.shift.max() == 11 and p.shift.min() == 0
    assert li.search([" ".join(["z"] * 50 + [f"w{i}" for i in range(12)] + ["z"])], p) == {(0, 1)}
    assert li.search(["w0"], p) == set()
    assert li.search(["w0 " * 50], li.build_patterns(li.item_words([], 12))) == set()


def test_many_items_need_little_memory():
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(5000)]
    items = [(k, " ".join(rng.choices(pool, k=200))) for k in range(20_000)]
    began = time.process_time()
    sent = li.item_words(items, 12)
    p = li.build_patterns(sent)
    assert sum(x.nbytes for x in (sent.words, sent.text, sent.ids)) < 60e6
    assert sum(x.nbytes for x in (p.shift, p.bucket, p.start)) < 200e6
    assert time.process_time() - began < 30
    text = " ".join(rng.choices(pool, k=3000) + items[777][1].split()[50:70] + rng.choices(pool, k=3000))
    assert li.search([text], p) == {(0, 777)}


def _lines(rows, least=6):
    docs, at = defaultdict(set), []
    for cid, doc, ticker, source, text in set(rows):
        if text is None:
            continue
        for no, line in enumerate(text.split("\n"), 1):
            key = re.sub("[^a-z0-9]", "", line.lower())
            if 20 <= len(line.strip()) <= 200 and key:
                site = ("t", ticker) if ticker is not None else ("s", source)
                docs[site, key].add(doc)
                at.append((cid, no, (site, key)))
    return {(c, n) for c, n, k in at if len(docs[k]) >= least}


def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(5)
    standing = ["Forward-looking statements may prove wrong.", "Copyright of the bank, all rights reserved", "\u00a0 Share this page with your friends \u2003", "too short", "y" * 250, "-" * 30]
    rows = []
    for k in range(120):
        ticker = rng.choice(["A", "A", "B", None])
        lines = [rng.choice(standing).upper() if rng.random() < 0.3 else rng.choice(standing) for _ in range(rng.randrange(4))] + [f"An own sentence number {k} of this text"]
        rng.shuffle(lines)
        rows.append((f"c{k}", f"d{k // 2}", ticker, "cfpb" if ticker is None else "edgar", "\n".join(lines)))
    rows += [rows[0], ("n", "n", "A", "edgar", None), ("e", "e", "A", "edgar", "")]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, ticker string, source string, text string")
    found = rl.repeated_lines(df)
    want = _lines(rows)
    assert {(r["id"], r["line_no"]) for r in found.collect()} == want and want
    kept = {r["chunk_id"]: r["text"] for r in rl.without_repeated_lines(df, found).collect()}
    for cid, _, _, _, text in rows:
        assert kept[cid] == (None if text is None else "\n".join(x for n, x in enumerate(text.split("\n"), 1) if (cid, n) not in want))
    assert rl.repeated_lines(df.limit(0)).count() == 0


def test_consecutive_standing_lines_form_a_block(spark):
    two = "This is the first standing line here\nThis is the second standing line here"
    rows = [(f"c{i}", f"d{i}", "A", "edgar", two + f"\nBut this sentence is only in {i} and nowhere else") for i in range(8)]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, ticker string, source string, text string")
    assert rl.repeated_lines(df).select("block").distinct().count() == 1
    assert rl.repeated_lines(df).count() == 16
    assert [(r["lines"], r["texts"], r["docs"]) for r in rl.block_report(rl.repeated_lines(df)).collect()] == [(16, 8, 8)]


def test_large_groups_are_multiplied_in_parts():
    n = 300
    gram = np.zeros(n, np.uint64)
    row = np.arange(n, dtype=np.uint64)
    at, size = np.zeros(n, np.int16), np.full(n, 10, np.int16)
    parity = np.zeros(n, np.uint64)
    got = np.concatenate(list(nd._multiply(gram, row, at, size, parity, 0.6, most=500)))
    assert len(np.unique(got)) == n * (n - 1) // 2
