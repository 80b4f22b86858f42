"""Defects of question and answer pairs, from clauses tagged by a conditional random field.

A linear-chain CRF tags each clause of an answer as answer, refusal, echo, foreign or
unfinished; the shares of the clauses' text then decide the pair's defect. The CRF is
trained here, on a bounded sample of the pairs: sound answers as they stand, and the same
rows damaged on purpose (cut off, replaced by the question, by an answer in another
language, by a phrase that declines), so that the labels are known.

What words tell is learned too: a lexicon holds the log-odds of words and pairs of words in
declining clauses, and of last words where a text was cut. It starts from a few phrases and then
takes in the sample's own answers that the tagger finds to decline. While the tagger
is trained, a clause is scored by a lexicon that never saw its phrase, so its weights are
those for phrases it doesn't know.

All clauses of a batch are measured at once, as arrays.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
SENTINEL = "INSUFFICIENT_CONTEXT:"
#: Most pairs of the sample the tagger is trained on.
TRAIN_PAIRS = 2500
#: How often the sample's own declining answers are added to the lexicon and the tagger is trained anew.
SELF_ROUNDS = 1
#: Most function words; they are read to the driver.
MOST_WORDS = 100_000

_SOURCE = re.compile(r"\[\s*S?\d*(?:\s*,\s*S?\d+)*\s*\]?")
_BLANK = re.compile("[\\s\\u00a0\\u200b-\\u200f\\u2060\\ufeff]+")
_PLACEHOLDER = re.compile(r"(?:n/?a|none|null|nil|nan|tbd|todo|unknown|undefined|empty|no answer|answer|placeholder|-+|_+|\.{2,}|…|\?+|x{3,}|<[^>\d]*>|\[[^\]\d]*\]|\{[^}\d]*\})[.:]?", re.I)
#: Most words of a bracketed text that is a placeholder, such as [insert answer here].
PLACEHOLDER_WORDS = 5
_CLAUSE = re.compile(r"(?<=[.!?…])[\"”’)]*\s+(?=[^a-zß-ÿ])|\n+")
_WORD = re.compile(r"[^\W_]+(?:[.,]\d+)*")
_END = re.compile(r"[.!?。！？][\"”’»)\]]*$")
_OPEN_END = (",", ";", ":", "(", "-", "..", "…")

# The phrases the lexicon starts from, what may follow them, and what may precede a copied question.
DECLINES = (
    "I cannot answer this question.", "I am sorry, but I can't help with that.", "The information provided is not sufficient to answer.", "No answer can be given from these sources.",
    "I do not have enough information to respond to this request.", "As an assistant I am unable to give an opinion on this.", "The documents do not allow me to say anything about it.", "Unfortunately I am not able to provide this.",
    "It is not possible to reply to this on the basis of the passages.", "My guidelines do not let me respond.", "Nothing in the material speaks to this question.", "This cannot be determined from the context.",
    "I won't be able to help with this request.", "Insufficient context to answer.", "There is no information in the excerpts that would answer this.", "That lies beyond what I can do.", "I must decline to answer.", "I would rather not guess; please ask a professional.", "No comment can be given on it.", "I have to decline, as none of the texts covers it.", "We lack the data needed for a reply.",
    "Lo siento, no puedo responder a esta pregunta.", "Leider kann ich nicht auf diese Frage antworten.", "Désolé, je ne peux pas répondre à cette question.", "Desculpe, não posso responder a esta pergunta.",
)
COURTESIES = ("Please rephrase the question.", "Let me know if I can help with anything else.", "Thank you for your understanding.", "Please ask about another document.", "Try to ask it in another way.", "")
GAPS = ("The sources do not give a figure for the later year.", "The passages do not cover the other issuer.", "No figure for {0} is given.", "Nothing was found on {0}.")
# Sound answers that are short, or deny something without declining to answer.
SHORT = ("Yes.", "No.", "Both did.", "Neither did.", "Neither of them.", "Yes, both.")
DENIALS = ("It was unable to renew the {0} in 2020.", "The {0} cannot be redeemed before 2023.", "The {0} did not recover.", "No dividend was paid on the {0}.", "It could not sell the {0} by the end of 2019.", "There is no limit on the {0} of {1}.", "It is not possible to redeem the {0} before 2024.", "The board declined to extend the {0}.")
LEADS = ("", "", "Question: ", "You would like to know: ", "You asked: ", "The question is: ", "Q: ", "Your question: ")


class Tagger(NamedTuple):
    weight: np.ndarray  # tags x features
    step: np.ndarray  # tags x tags
    first: np.ndarray
    last: np.ndarray


class Lexicon(NamedTuple):
    """Log-odds, between -4 and 4: of words and pairs of words in declining clauses, of last words of cut texts."""

    word: dict[str, float]
    pair: dict[tuple[str, str], float]
    tail: dict[str, float]


NO_LEXICON = Lexicon({}, {}, {})


class Model(NamedTuple):
    tagger: Tagger
    lexicon: Lexicon


class Languages:
    """Function words by language."""

    def __init__(self, words: list[tuple[str, str]]) -> None:
        self.by_word: dict[str, list[str]] = {}
        for lang, word in words:
            self.by_word.setdefault(word.lower(), []).append(lang)
        self.names = sorted({lang for own in self.by_word.values() for lang in own})


class Vocabulary(dict):
    """A number for each word, and what is known of it by number; its size is bounded by starting anew."""

    MOST = 300_000

    def __init__(self, lang: Languages, lexicon: Lexicon) -> None:
        super().__init__()
        self.lang, self.lexicon = lang, lexicon
        self.renew()

    def renew(self) -> None:
        self.clear()
        self._odds, self._tail, self._digit, self._letters, self._lang = [], [], [], [], []
        place = {k: i for i, k in enumerate(self.lang.names)}
        self._share = {w: np.bincount([place[k] for k in own], minlength=len(place)) / len(own) for w, own in self.lang.by_word.items()}
        self._none = np.zeros(max(1, len(place)))
        pairs = sorted((self[a] << 32 | self[b], v) for (a, b), v in self.lexicon.pair.items())
        self.pairs, self.pair_odds = np.array([k for k, _ in pairs], np.int64), np.array([v for _, v in pairs] or [0.0])

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self._odds.append(self.lexicon.word.get(word, 0.0))
        self._tail.append(self.lexicon.tail.get(word, 0.0))
        self._digit.append(any(c.isdigit() for c in word))
        self._letters.append(not self._digit[-1])
        self._lang.append(self._share.get(word, self._none))
        return k

    def arrays(self) -> tuple[np.ndarray, ...]:
        """odds, tail odds, digits, letters, language shares by number."""
        return np.array(self._odds), np.array(self._tail), np.array(self._digit), np.array(self._letters), np.array(self._lang)


def without_sources(text: str) -> str:
    text = _SOURCE.sub(" ", text) if "[" in text else text
    return " ".join(text.split()) if text.isascii() else _BLANK.sub(" ", text).strip()


def is_empty(text: str | None) -> bool:
    """Null, blank, or nothing but a placeholder or source marks."""
    if text is None:
        return True
    bare = without_sources(text)
    if len(bare) > 200:
        return not any(c.isalnum() for c in bare)
    whole = _BLANK.sub(" ", text).strip()
    few = len(_WORD.findall(whole)) <= PLACEHOLDER_WORDS
    return not bare or few and bool(_PLACEHOLDER.fullmatch(whole) or _PLACEHOLDER.fullmatch(bare)) or not any(c.isalnum() for c in bare)


def clauses(text: str) -> list[str]:
    joined: list[str] = []
    for part in _CLAUSE.split(text):
        c = without_sources(part) if part else ""
        if not c:
            continue
        # an end that lost its marks belongs to the clause before it
        if joined and not any(map(str.isalnum, c)):
            joined[-1] += f" {c}"
        else:
            joined.append(c)
    return joined


def _run(a: list[str], b: list[str]) -> int:
    """Longest common run of words of b in a."""
    at: dict[str, list[int]] = {}
    for i, w in enumerate(a):
        at.setdefault(w, []).append(i)
    best, before = 0, {}
    for w in b:
        now = {}
        for i in at.get(w, ()):
            now[i] = before.get(i - 1, 0) + 1
            if now[i] > best:
                best = now[i]
        before = now
    return best


def _copied(question: str, parts: list[str]) -> tuple[float, float]:
    """Share of the clauses' words that are runs of the question, a run for each clause or one for all, and of the question's words in one run."""
    q, said = _WORD.findall(question.lower()), [_WORD.findall(c.lower()) for c in parts]
    total = sum(map(len, said))
    whole = _run(q, [w for c in said for w in c])
    return (max(whole, sum(_run(q, w) for w in said)) / total if total else 0.0), whole / max(1, len(q))


FEATURES = 30


class Clauses(NamedTuple):
    """Of a batch of pairs: features of all clauses, the pair of each, each pair's language (-1: unknown) and that of its answer."""

    x: np.ndarray
    own: np.ndarray
    asked: np.ndarray
    said: np.ndarray


def _sums(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each stretch of values, 0 for an empty one."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0, dtype=float)])
    return total[starts + counts] - total[starts]


def _longest_runs(q_pair: np.ndarray, q_word: np.ndarray, q_at: np.ndarray, c_pair: np.ndarray, c_word: np.ndarray, c_at: np.ndarray, c_clause: np.ndarray, n: int) -> np.ndarray:
    """Longest run of words each of n clauses shares with its pair's question: matches of words, sorted by clause and offset, broken where positions don't follow."""
    best = np.zeros(n)
    if not len(q_word) or not len(c_word):
        return best
    width = np.int64(max(q_word.max(), c_word.max()) + 1)
    qk, ck = q_pair * width + q_word, c_pair * width + c_word
    order = np.argsort(qk, kind="stable")
    qk, q_at = qk[order], q_at[order]
    lo = np.searchsorted(qk, ck)
    hits = np.searchsorted(qk, ck, side="right") - lo
    each = np.repeat(np.arange(len(ck)), hits)
    if not len(each):
        return best
    at = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(hits) - hits, hits)
    clause, place = c_clause[each], c_at[each]
    offset = q_at[at] - place
    order = np.lexsort((place, offset, clause))
    clause, offset, place = clause[order], offset[order], place[order]
    starts = np.flatnonzero(np.concatenate(([True], (clause[1:] != clause[:-1]) | (offset[1:] != offset[:-1]) | (place[1:] != place[:-1] + 1))))
    np.maximum.at(best, clause[starts], np.diff(np.append(starts, len(clause))).astype(float))
    return best


def measure(questions: Sequence[str | None], parts: Sequence[list[str]], v: Vocabulary) -> Clauses:
    """Features of the clauses of each pair."""
    if len(v) > v.MOST:
        v.renew()
    number = v.__getitem__
    flat = [c for p in parts for c in p]
    own = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    n = len(flat)
    words = [list(map(number, _WORD.findall(c.lower()))) for c in flat]
    asked = [list(map(number, _WORD.findall(q.lower()))) if q else [] for q in questions]
    if not n:
        return Clauses(np.zeros((0, FEATURES)), own, np.full(len(parts), -1), np.full(len(parts), -1))
    count, q_count = np.array([len(w) for w in words]), np.array([len(w) for w in asked])
    w, q = (np.array([k for x in xs for k in x], np.int64) for xs in (words, asked))
    start, q_start = np.cumsum(count) - count, np.cumsum(q_count) - q_count
    odds, tail, digit, letters, share = v.arrays()
    clause = np.repeat(np.arange(n), count)
    place, q_place = np.arange(len(w)) - start[clause], np.arange(len(q)) - np.repeat(q_start, q_count)
    q_pair = np.repeat(np.arange(len(asked)), q_count)
    size = np.maximum(count, 1)
    run = _longest_runs(q_pair, q, q_place, own[clause], w, place, clause, n)
    width = np.int64(max(len(v), 1))
    known = np.isin(own[clause] * width + w, q_pair * width + q)
    # languages
    of_pair = _sums(share[q], q_start, q_count) if len(q) else np.zeros((len(asked), share.shape[1]))
    lang = np.where(of_pair.max(1) > 0, of_pair.argmax(1), -1)
    of_clause = _sums(share[w], start, count)
    of_answer = np.zeros((len(parts), share.shape[1]))
    np.add.at(of_answer, own, of_clause)
    said = np.where(of_answer.max(1) > 0, of_answer.argmax(1), -1)
    mine_at = lang[own]
    mine = np.where(mine_at >= 0, of_clause[np.arange(n), mine_at], 0.0)
    rest = of_clause.copy()
    rest[np.flatnonzero(mine_at >= 0), mine_at[mine_at >= 0]] = 0
    other, has_lang = rest.max(1), mine_at >= 0
    # the lexicon
    o = odds[w]
    pair_odds = np.zeros(len(w))
    if len(v.pairs) and len(w) > 1:
        key = (w[:-1] << 32) | w[1:]
        at = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
        pair_odds[:-1] = np.where((v.pairs[at] == key) & (clause[1:] == clause[:-1]), v.pair_odds[at], 0)
    mean, pairs, strong = _sums(o, start, count) / size, _sums(pair_odds, start, count) / size, _sums((o > 1).astype(float), start, count) / size
    best, best_pair = np.zeros(n), np.zeros(n)
    np.maximum.at(best, clause, o)
    np.maximum.at(best_pair, clause, pair_odds)
    sure = np.minimum(_sums((o > 2).astype(float), start, count) + _sums((pair_odds > 2).astype(float), start, count), 6) / 6
    opening = np.where(count > 0, o[np.minimum(start, max(0, len(w) - 1))], 0) if len(w) else np.zeros(n)
    digits = _sums(digit[w], start, count)
    ended = np.array([bool(_END.search(c)) and not c.endswith("..") for c in flat])
    open_end = np.array([c.rstrip().endswith(_OPEN_END) for c in flat])
    last_word = np.where(count > 0, w[np.minimum(start + count - 1, max(0, len(w) - 1))], 0) if len(w) else np.zeros(n, np.int64)
    tail_odds = np.where(count > 0, tail[last_word], 0) if len(w) else np.zeros(n)
    tail_function = (share[last_word].sum(1) > 0) & (count > 0) if len(w) else np.zeros(n, bool)
    last, first = np.append(own[1:] != own[:-1], True), np.concatenate(([True], own[1:] != own[:-1]))
    hanging = last & (~ended | (tail_odds > 1))
    x = np.stack([
        np.ones(n), run / size, run / np.maximum(q_count[own], 1), (run / size > 0.75) & (run >= 5), _sums(known, start, count) / size,
        has_lang & (other > mine) & (other >= 1), np.where(has_lang, (other - mine) / np.maximum(_sums(letters[w], start, count), 1), 0), has_lang & (other > 2 * mine + 1),
        mean, pairs, strong, best / 4, best_pair / 4, sure, opening / 4, np.maximum(mean + pairs, 0) * (digits == 0),
        np.minimum(digits, 3) / 3, digits == 0, count <= 2, count <= 4, count <= 8,
        hanging, hanging & (count > 6), hanging & (tail_function | open_end), tail_odds / 4 * last, ended, last, first, [c.endswith("?") for c in flat], q_count[own] == 0,
    ], 1).astype(float)
    return Clauses(x, own, lang, said)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def _padded(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chains of about the same size (up to the next power of two) and the place of each of their clauses in all of them, padded with the last one."""
    starts = np.cumsum(sizes) - sizes
    for k in np.unique(np.ceil(np.log2(np.maximum(sizes, 1)))):
        chains = np.flatnonzero((np.ceil(np.log2(np.maximum(sizes, 1))) == k) & (sizes > 0))
        if len(chains):
            steps = np.arange(sizes[chains].max())
            yield chains, starts[chains][:, None] + np.minimum(steps, (sizes[chains] - 1)[:, None])


def train(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, start: Tagger | None = None, rounds: int = 120, rate: float = 0.15, penalty: float = 1e-3) -> Tagger:
    """Maximum likelihood of the chains by Adam; x, y: features and tags of the clauses of all chains, one after the other."""
    k, n = len(TAGS), len(sizes)
    groups = []
    for chains, at in _padded(sizes):
        size = sizes[chains]
        on = np.arange(at.shape[1]) < size[:, None]
        groups.append((at, on, np.eye(k)[y[at]] * on[..., None], (np.arange(len(chains)), size - 1)))
    theta = [p.copy() for p in start] if start else [np.zeros((k, x.shape[1])), np.zeros((k, k)), np.zeros(k), np.zeros(k)]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in theta]
    for r in range(1, rounds + 1):
        weight, step, first, last = theta
        every = x @ weight.T
        gaps = np.zeros_like(every)
        pair, g_first, g_last = np.zeros((k, k)), np.zeros(k), np.zeros(k)
        for at, on, hot, end in groups:
            score = every[at]
            t = at.shape[1]
            score[:, 0] += first
            score[end] += last
            alpha, beta = np.empty_like(score), np.zeros_like(score)
            alpha[:, 0] = score[:, 0]
            for j in range(1, t):
                alpha[:, j] = np.where(on[:, j, None], score[:, j] + _logsum(alpha[:, j - 1][:, :, None] + step, 1), alpha[:, j - 1])
            for j in range(t - 2, -1, -1):
                beta[:, j] = np.where(on[:, j + 1, None], _logsum(step + (score[:, j + 1] + beta[:, j + 1])[:, None, :], 2), 0)
            total = _logsum(alpha[end], 1)
            gap = np.exp(alpha + beta - total[:, None, None]) * on[..., None] - hot
            gaps[at[on]] += gap[on]
            g_first += gap[:, 0].sum(0)
            g_last += gap[end].sum(0)
            for j in range(1, t):
                m = np.exp(alpha[:, j - 1][:, :, None] + step + (score[:, j] + beta[:, j])[:, None, :] - total[:, None, None])
                pair += (m * on[:, j, None, None]).sum(0) - (hot[:, j - 1] * on[:, j, None]).T @ hot[:, j]
        for p_, g, (m1, m2) in zip(theta, [gaps.T @ x, pair, g_first, g_last], moment, strict=True):
            g = g / n + penalty * p_
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.99
            m2 += 0.01 * g * g
            p_ -= rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-8)
    return Tagger(*theta)


def tag(x: np.ndarray, sizes: np.ndarray, m: Tagger, without: int | None = None) -> np.ndarray:
    """Most likely tags of all chains' clauses, one of them ruled out if `without` names it."""
    every = x @ m.weight.T
    if without is not None:
        every[:, without] = -1e9
    out = np.zeros(len(x), np.int64)
    for chains, at in _padded(sizes):
        score, size, t = every[at], sizes[chains], at.shape[1]
        rows = np.arange(len(chains))
        score[rows, size - 1] += m.last
        best = score[:, 0] + m.first
        back = np.zeros((len(chains), t, len(TAGS)), np.int64)
        for j in range(1, t):
            go = best[:, :, None] + m.step
            back[:, j] = go.argmax(1)
            best = np.where((j < size)[:, None], go.max(1) + score[:, j], best)
        now = best.argmax(1)
        for j in range(t - 1, -1, -1):
            live = j < size
            out[at[live, j]] = now[live]
            if j:
                now = np.where(live, back[rows, j, now], now)
    return out


class _Row(NamedTuple):
    question: str
    parts: list[str]
    tags: list[int]
    fold: int


def _sound(pairs: list[tuple[str, str]], refused: np.ndarray | None, v: Vocabulary) -> list[tuple[str, int, list[str]]]:
    """Question, its language and clauses of answers without a visible defect. Before there is a tagger only short answers and those with figures count; later very short ones, such as "No.", and all it finds nothing wrong with."""
    parts = [clauses(a) for _, a in pairs]
    m = measure([q for q, _ in pairs], parts, v)
    out = []
    for i, (question, _) in enumerate(pairs):
        bare = " ".join(parts[i])
        whole = bool(_END.search(bare)) and not bare.endswith("..") or len(_WORD.findall(bare)) <= 5
        alike = m.said[i] in (m.asked[i], -1) or len(bare) < 20
        clear = not refused[i] or len(bare) < 20 if refused is not None else len(bare) < 40 or any(c.isdigit() for c in bare)
        if parts[i] and alike and whole and clear and _copied(question, parts[i])[0] < 0.6:
            out.append((question, int(m.asked[i]), parts[i]))
    return out


def _training_rows(sound: list[tuple[str, int, list[str]]], declining: list[tuple[str, list[str]]], lang: Languages, seed: int = 5) -> list[_Row]:
    """sound rows, and each damaged; declining: the sample's own answers that decline."""
    rng = random.Random(seed)
    by_lang: dict[int, list[list[str]]] = {}
    for _, own, parts in sound:
        by_lang.setdefault(own, []).append(parts)
    common = max(by_lang, key=lambda k: len(by_lang[k]), default=-1)
    spoken: dict[str, list[str]] = {}
    for word, langs in lang.by_word.items():
        for k in langs:
            spoken.setdefault(k, []).append(word)
    rows: list[_Row] = []

    def put(question: str, parts: list[str], tags: list[int], fold: int | None = None) -> None:
        rows.append(_Row(question, parts, tags, rng.randrange(2) if fold is None else fold % 2))

    for question, own, parts in sound:
        content = [w for w in " ".join(parts).split() if w.lower() not in lang.by_word] or ["it"]
        own_words = " ".join(rng.choice(content) for _ in range(rng.randrange(1, 4)))
        for _ in range(1 if own == common else 3):  # the rarer languages are few
            put(question, parts, [ANSWER] * len(parts))
        if len(parts) > 1 and rng.random() < 0.5:  # a sound answer that also names a gap
            k = rng.randrange(len(GAPS))
            put(question, [*parts, GAPS[k].format(own_words)], [ANSWER] * len(parts) + [REFUSAL], k)
        if rng.random() < 0.3:  # a sound answer that denies something
            k = rng.randrange(len(DENIALS))
            denied = [*(parts if rng.random() < 0.5 else ()), DENIALS[k].format(rng.choice(content), own_words)]
            put(question, denied, [ANSWER] * len(denied), k)
        if rng.random() < 0.2:
            put(question, [rng.choice(SHORT)], [ANSWER])
        words = parts[-1].split()
        if len(words) >= 5:
            cut = " ".join(words[: rng.randrange(3, len(words))])
            cut = (cut[: -rng.randrange(1, 3)] if rng.random() < 0.3 and len(cut) > 20 else cut).rstrip(" .!?") + rng.choice(("", "", "", " ...", ","))
            put(question, [*parts[:-1], cut], [ANSWER] * (len(parts) - 1) + [UNFINISHED])
        q = question.split()
        echo = rng.choice(LEADS) + " ".join(q[rng.choice((0, 0, 0, 1, 2)) : len(q) - rng.choice((0, 0, 0, 1, 2))])
        echo = rng.choice((echo, echo, echo.lower(), echo.upper(), echo.rstrip("?") + "."))
        echo = f"{echo} {question}" if rng.random() < 0.2 else echo
        if rng.random() < 0.7:
            put(question, own_parts := clauses(echo) or [echo], [ECHO] * len(own_parts))
        if declining and rng.random() < 0.5:
            k = rng.randrange(len(declining))
            put(question, declining[k][1], [REFUSAL] * len(declining[k][1]), k)
        else:
            k, courtesy = rng.randrange(len(DECLINES)), rng.choice(COURTESIES)
            decline = DECLINES[k]
            if rng.random() < 0.5:  # what is declined may be named, with dates and figures
                decline = decline.rstrip(".") + rng.choice((f" for the {rng.choice(content)} of {own_words}", f" about {own_words}", f" on {rng.choice(content)} {rng.randrange(1, 29)}, {rng.randrange(2018, 2026)}", f" for the year {rng.randrange(2018, 2026)}")) + "."
            put(question, [decline, *([courtesy] if courtesy else [])], [REFUSAL] * (2 if courtesy else 1), k)
        others = [k for k in by_lang if k not in (own, -1)]
        if others and rng.random() < 0.7:
            for _ in range(1 if own == common else 4):
                parts = rng.choice(by_lang[rng.choice(sorted(others)) if own == common or rng.random() < 0.5 or common not in others else common])
                if len(" ".join(parts)) > 30:
                    put(question, parts, [FOREIGN] * len(parts))
        elif own >= 0 and (strange := [k for k in sorted(spoken) if k != lang.names[own]]):
            # the sample needn't hold the other languages: function words among words of the answer
            known = spoken[rng.choice(strange)]
            parts = [" ".join(rng.choice(known) if rng.random() < 0.4 else rng.choice(content) for _ in range(rng.randrange(8, 25))).rstrip(".,") + "." for _ in range(rng.randrange(1, 4))]
            put(question, parts, [FOREIGN] * len(parts))
    # a question may be missing
    rows += [r._replace(question="") for r in rows if not {ECHO, FOREIGN} & set(r.tags) and rng.random() < 0.1]
    for k, d in enumerate(DECLINES):  # so that the tagger knows each tag, whatever the sample holds
        put("What was it?", [d], [REFUSAL], k)
    put("Which one was it in 2020?", ["Which one was it in 2020?"], [ECHO])
    put("What was it?", ["It rose by 2% in 2020."], [ANSWER])
    put("What was it?", ["It rose by more than two percent and the"], [UNFINISHED])
    return rows


def learn_lexicon(rows: list[_Row]) -> Lexicon:
    """Log-odds from the number of clauses; what stands in fewer than two clauses, or for last words in fewer than four, tells nothing."""
    counts = [[Counter(), 0, Counter(), 0] for _ in range(2)]  # grams, clauses; last words, texts: of the others and of those asked for
    for r in rows:
        for c, t in zip(r.parts, r.tags, strict=True):
            if t in (ANSWER, REFUSAL, UNFINISHED):
                w = _WORD.findall(c.lower())
                side = counts[t == REFUSAL]
                side[0].update({*w, *zip(w, w[1:], strict=False)})
                side[1] += 1
        w = _WORD.findall(r.parts[-1].lower())
        if w and r.tags[-1] in (ANSWER, UNFINISHED) and len(w) > 3:
            side = counts[r.tags[-1] == UNFINISHED]
            side[2][w[-1]] += 1
            side[3] += 1

    def odds(k: int, least: int) -> dict:
        (no, n_no), (yes, n_yes) = ((c[k], c[k + 1]) for c in counts)
        return {g: float(np.clip(np.log((yes[g] + 0.5) / (n_yes + 1)) - np.log((no[g] + 0.5) / (n_no + 1)), -4, 4)) for g in no.keys() | yes.keys() if no[g] + yes[g] >= least}

    both = odds(0, 2)
    return Lexicon({g: v for g, v in both.items() if isinstance(g, str)}, {g: v for g, v in both.items() if not isinstance(g, str)}, odds(2, 4))


def _fit(rows: list[_Row], lang: Languages, start: Tagger | None) -> Model:
    """The tagger's rows are scored by the lexicon of the other fold; the model's own lexicon is that of both."""
    x, y, sizes = [], [], []
    for fold in (0, 1):
        own = [r for r in rows if r.fold == fold]
        v = Vocabulary(lang, learn_lexicon([r for r in rows if r.fold != fold]))
        x.append(measure([r.question for r in own], [r.parts for r in own], v).x)
        y += [t for r in own for t in r.tags]
        sizes += [len(r.parts) for r in own]
    return Model(train(np.concatenate(x), np.array(y), np.array(sizes), start, 40 if start else 100), learn_lexicon(rows))


def fit_tagger(pairs: DataFrame, lang: Languages, most_pairs: int = TRAIN_PAIRS) -> Model:
    """pairs: question, answer. The sample is the rows that come first by hash, at most most_pairs."""
    sample = pairs.select("question", "answer").where("question is not null and answer is not null").distinct().orderBy(F.xxhash64("question", "answer"), "question", "answer").limit(most_pairs).collect()
    return fit([(r["question"], r["answer"]) for r in sample], lang)


def fit(sample: list[tuple[str, str]], lang: Languages, rounds: int = SELF_ROUNDS) -> Model:
    own = [(q, a) for q, a in sample if not is_empty(a)]
    model, refused, declining = None, None, []
    for _ in range(rounds + 1):
        v = Vocabulary(lang, model.lexicon if model else NO_LEXICON)
        model = _fit(_training_rows(_sound(own, refused, v), declining, lang), lang, model.tagger if model else None)
        kinds = [d for d, _ in defects([q for q, _ in own], [a for _, a in own], [None] * len(own), model, lang)]
        refused = np.array([d is not None for d in kinds], bool)
        found = {" ".join(clauses(a)): (q, clauses(a)) for (q, a), d in zip(own, kinds, strict=True) if d == "refusal" and SENTINEL not in a and len(a) >= 20}
        declining = [found[k] for k in sorted(found)]
    return model


def defects(questions: Sequence[str | None], answers: Sequence[str | None], abstained: Sequence[bool | None], m: Model, lang: Languages, v: Vocabulary | None = None) -> list[tuple[str | None, list[str]]]:
    """Of each pair its defect or None, and the tags of the answer's clauses."""
    out: list[tuple[str | None, list[str]]] = [(None, [])] * len(answers)
    todo = []
    for i, a in enumerate(answers):
        if is_empty(a):
            out[i] = "empty", []
        elif a.lstrip().startswith(SENTINEL):
            out[i] = None if abstained[i] else "refusal", []
        else:
            todo.append(i)
    parts = [clauses(answers[i]) for i in todo]
    asked = [questions[i] for i in todo]
    c = measure(asked, parts, v if v is not None else Vocabulary(lang, m.lexicon))
    sizes = np.array([len(p) for p in parts], np.int64)
    length = np.array([len(x) for p in parts for x in p], float)
    tags = tag(c.x, sizes, m.tagger)

    def covered(tags: np.ndarray) -> np.ndarray:
        size = np.zeros((len(parts), len(TAGS)))
        np.add.at(size, (c.own, tags), length)
        return size / np.maximum(size.sum(1, keepdims=True), 1)

    share = covered(tags)
    copies = np.zeros(len(parts), bool)
    again = np.zeros(len(parts), bool)
    for k in np.flatnonzero(share[:, ECHO] > 0.5):
        said, whole = _copied(asked[k], parts[k]) if asked[k] else (0.0, 0.0)
        copies[k] = said >= 0.6 and whole >= 0.6
        again[k] = not copies[k]
    if again.any():  # it opens with words of the question but says more
        tags = np.where(again[c.own], tag(c.x, sizes, m.tagger, ECHO), tags)
        share = covered(tags)
    last = np.cumsum(sizes) - 1
    for k, i in enumerate(todo):
        if not sizes[k]:
            continue
        own = [TAGS[t] for t in tags[last[k] - sizes[k] + 1 : last[k] + 1]]
        found = None
        if copies[k]:
            found = "copied_question"
        elif share[k, REFUSAL] > 0.5 and share[k, ANSWER] < 0.3:
            found = "refusal"
        elif share[k, FOREIGN] > 0.5:
            found = "other_language"
        elif own[-1] == "unfinished":
            # a short answer needs no full stop: it is cut off only if its end hangs
            end, words = parts[k][-1].rstrip(), _WORD.findall(parts[k][-1].lower())
            hangs = end.endswith(_OPEN_END) or not words or words[-1] in lang.by_word or m.lexicon.tail.get(words[-1], 0) > 1
            if len(own) > 1 or len(words) > 6 or hangs:
                found = "truncated"
        out[i] = found, own
    return out


def broken_pairs(pairs: DataFrame, common_words: DataFrame, model: Model | None = None) -> DataFrame:
    """pair_table, pair_key, defect, tags of every pair; defect is null for a sound one.

    pairs: pair_table, pair_key, question, answer, abstained, a row for each key. A null question leaves
    only the defects that need none; null answers are empty. No rows give no rows. common_words: lang, word,
    at most MOST_WORDS of them.
    """
    words = [(r["lang"], r["word"]) for r in common_words.where("lang is not null and word is not null").select("lang", "word").distinct().orderBy("lang", "word").limit(MOST_WORDS + 1).collect()]
    if len(words) > MOST_WORDS:
        raise ValueError("too many common words")
    lang = Languages(words)
    m = model or fit_tagger(pairs, lang)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(lang, m.lexicon)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                table, key, question, answer, abstained = (b.column(i)[at : at + 2000].to_pylist() for i in range(5))
                found = defects(question, answer, abstained, m, lang, v)
                yield pa.RecordBatch.from_arrays([pa.array(table, pa.string()), pa.array(key, pa.string()), pa.array([d for d, _ in found], pa.string()), pa.array([t for _, t in found], pa.list_(pa.string()))], ["pair_table", "pair_key", "defect", "tags"])

    rows = pairs.select("pair_table", F.col("pair_key").cast("string"), "question", "answer", "abstained")
    return rows.mapInArrow(judge, "pair_table string, pair_key string, defect string, tags array<string>")


def logged_pairs(answers: DataFrame, drafts: DataFrame) -> DataFrame:
    """The pairs of both tables: the last logged row of each trace_id, and each draft with its ground truth."""
    d = drafts.where("id is not null").groupBy("id").agg(F.max(F.struct("question", "ground_truth")).alias("x")).select("id", "x.question", "x.ground_truth")
    a = answers.where("trace_id is not null").groupBy("trace_id").agg(F.max_by(F.struct("id", "answer", "abstained"), F.struct("logged_at", F.coalesce("answer", F.lit("")), F.coalesce("id", F.lit("")))).alias("x")).select("trace_id", "x.*")
    logged = a.join(d.select("id", "question"), "id", "left").select(F.lit("answers").alias("pair_table"), F.col("trace_id").alias("pair_key"), "question", "answer", "abstained")
    own = d.select(F.lit("drafts_multihop").alias("pair_table"), F.col("id").alias("pair_key"), "question", F.col("ground_truth").alias("answer"), F.lit(None).cast("boolean").alias("abstained"))
    return logged.unionByName(own)
