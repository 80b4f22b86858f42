"""Per-document text statistics, and prose told from lists, tables and junk.

Each line (long ones in stretches) gets the distribution of its tokens over a few
classes: function words, other words, numbers and so on. It takes the structural
profile that is nearest by Jensen-Shannon divergence. Letter frequencies against
language profiles and the variety of words then tell damaged or repetitive text from
lists. Text of a language without function words or letters here, or of another script, is
prose if it is made as prose is: sentences of some length, mostly of small words in lower case,
vowels among the letters. A document's kind is the one that holds most of its characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm._words import by_size

CLASSES = ("function", "word", "short", "number", "dash", "code", "symbol", "url", "garbled", "mark")
KINDS = ("prose", "list", "table", "junk")

# Shares of the token classes in each structural profile.
PROFILES: tuple[tuple[str, dict[str, float]], ...] = (
    ("prose", {"function": 0.30, "word": 0.52, "short": 0.03, "number": 0.10, "dash": 0.01, "code": 0.03, "mark": 0.01}),
    ("prose", {"function": 0.20, "word": 0.62, "short": 0.02, "number": 0.12, "dash": 0.01, "code": 0.02, "mark": 0.01}),
    ("prose", {"function": 0.42, "word": 0.48, "short": 0.04, "number": 0.04, "code": 0.01, "mark": 0.01}),
    ("list", {"function": 0.01, "word": 0.94, "short": 0.02, "number": 0.01, "dash": 0.01, "mark": 0.01}),
    ("list", {"function": 0.06, "word": 0.62, "short": 0.02, "number": 0.28, "mark": 0.02}),
    ("list", {"function": 0.02, "word": 0.70, "short": 0.02, "number": 0.02, "dash": 0.08, "mark": 0.16}),
    ("list", {"function": 0.13, "word": 0.86, "number": 0.01}),
    ("list", {"function": 0.16, "word": 0.55, "short": 0.06, "number": 0.04, "mark": 0.19}),
    ("list", {"url": 0.97, "word": 0.03}),
    ("list", {"url": 0.45, "word": 0.40, "number": 0.05, "mark": 0.10}),
    ("list", {"function": 0.02, "word": 0.55, "code": 0.40, "number": 0.03}),
    ("table", {"word": 0.35, "number": 0.55, "dash": 0.10}),
    ("table", {"function": 0.01, "word": 0.55, "number": 0.40, "dash": 0.04}),
    ("table", {"word": 0.24, "number": 0.32, "dash": 0.07, "symbol": 0.37}),
    ("table", {"word": 0.15, "number": 0.78, "dash": 0.07}),
    ("table", {"word": 0.33, "number": 0.45, "dash": 0.06, "symbol": 0.16}),
    ("table", {"word": 0.20, "number": 0.30, "dash": 0.50}),
    ("junk", {"symbol": 0.98, "dash": 0.02}),
    ("junk", {"garbled": 0.98, "code": 0.02}),
    ("junk", {"garbled": 0.45, "word": 0.40, "short": 0.10, "symbol": 0.05}),
    ("junk", {"short": 0.55, "symbol": 0.33, "number": 0.10, "dash": 0.02}),
    ("junk", {"symbol": 0.60, "short": 0.20, "garbled": 0.20}),
    ("junk", {"code": 0.55, "number": 0.28, "short": 0.17}),
    ("junk", {"word": 0.55, "symbol": 0.45}),
    ("junk", {"word": 0.52, "dash": 0.48}),
)

# Letters per thousand of running text.
LETTERS: dict[str, str] = {
    "en": "a82 b15 c28 d43 e127 f22 g20 h61 i70 j2 k8 l40 m24 n67 o75 p19 q1 r60 s63 t91 u28 v10 w24 x2 y20 z1",
    "de": "a65 b19 c31 d51 e174 f17 g30 h48 i76 j3 k12 l34 m25 n98 o25 p8 q0 r70 s73 t62 u44 v7 w19 x0 y0 z11",
    "fr": "a81 b9 c33 d37 e163 f11 g9 h7 i76 j5 k1 l55 m30 n71 o54 p30 q14 r67 s79 t72 u63 v16 w1 x4 y3 z1",
    "es": "a125 b14 c47 d59 e137 f7 g10 h7 i63 j4 k0 l50 m32 n67 o87 p25 q9 r69 s80 t46 u39 v9 w0 x2 y9 z5",
    "pt": "a146 b10 c39 d50 e126 f10 g13 h13 i62 j4 k0 l28 m47 n50 o107 p25 q12 r65 s78 t47 u46 v17 w0 x2 y0 z5",
}

#: Greatest divergence (bits) of the letters from every language's, over at least LETTERS_LEAST letters, that readable text shows.
LETTERS_MOST, LETTERS_LEAST = 0.125, 80
#: Least share of different words (of different lines where lines are short) in a part of at least VARIETY_WORDS words, neither prose nor table, that isn't repetition.
VARIETY_LEAST, VARIETY_WORDS = 0.30, 20
STRETCH = 40
#: Prose of an unknown language: greatest share of known function words; least share of words in lower case; shares of short ones; shares of vowels among Latin letters; words between sentence ends.
UNKNOWN_FUNCTION, UNKNOWN_LOWER, UNKNOWN_SHORT, UNKNOWN_VOWELS, UNKNOWN_SENTENCE = 0.25, 0.7, (0.12, 0.65), (0.30, 0.58), (4, 60)
#: Prose of another script: most letters to a sentence end, least letters to a line.
SCRIPT_SENTENCE, SCRIPT_LINE = 300, 25

_URL = re.compile(r"(?:https?://|www\.|ftp://)\S+|[\w.+-]+@[\w-]+\.\w+\S*|(?:\w+/){2,}\S*")
_NUMBER = re.compile(r"[({\[$€£+-]*\d[\d.,:/-]*(?:%|\)|\}|\]|\.|,|;)*")
_WORD = re.compile(r"[^\W\d_]+(?:['’.-][^\W\d_]+)*\.?")
_TRIM = ".,;:!?()[]{}\"'“”‘’«»*_"
_CELL = re.compile(r"(?<!\d),(?=\S)|,(?=[^\s\d])")
_MARK = re.compile(r"[•◦▪‣*o–-]|\(?(?:[a-z]|[ivx]+|\d{1,3})[.)]", re.I)
_VOWEL = re.compile("[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüœ]", re.I)
_CONSONANTS = re.compile("[bcdfghjklmnpqrstvwxz]{5,}", re.I)
_ODD = re.compile(r"[^\W\d_][;:|~!^<>=*#@][^\W\d_]")
_PUNCTUATION = tuple(".!?…。！？:;")
_SYMBOL = re.compile(r"[^\w\s]")
_SENTENCE = re.compile(r"[.!?。！？।؟]+[\"'”’»)]*(?=\s|$)|[。！？]")
_OTHER_SCRIPT = re.compile("[\u0370-\u1fff\u2c00-\ud7ff\uf900-\ufdff\ufe70-\ufeff]")


def token_class(token: str, function: frozenset[str]) -> int:
    """Index into CLASSES of a white-space token."""
    bare = token.strip(_TRIM)
    low = bare.lower()
    if low in function and bare:
        return 0
    if token in ("-", "–", "—", "--"):
        return 4
    if len(token) > 4 and _URL.match(token):
        return 7
    if _NUMBER.fullmatch(token):
        return 3
    if not any(c.isalnum() for c in token):
        return 6
    if token.count(",") >= 2 and sum(c.isdigit() for c in token) * 3 > len(token):
        return 3
    if not bare:
        return 6
    if not bare.isascii() and (other := len(_OTHER_SCRIPT.findall(bare))) * 2 > len(bare):
        return 2 if other <= 2 else 1
    if any(c.isdigit() for c in bare):
        letters = sum(c.isalpha() for c in bare)
        return 5 if letters else 3
    if len(bare) > 30 or _ODD.search(bare):
        return 8
    if not _WORD.fullmatch(bare) and any(not (c.isalpha() or c in "'’-./&") for c in bare):
        odd = sum(not c.isalpha() for c in bare)
        return 8 if odd * 3 > len(bare) or any(ord(c) > 0x2FF or 0x80 <= ord(c) < 0xC0 for c in bare) else 1
    if len(bare) <= 2:
        return 2
    if any("\x80" <= c <= "¿" or c in "ÂÃâž™€œš" for c in bare) and not bare.isascii() and sum(c.isascii() for c in bare) * 2 < len(bare):
        return 8
    if len(bare) >= 4 and (not _VOWEL.search(bare) or _CONSONANTS.search(bare)) and not bare.isupper():
        return 8
    return 1


class _Classes(dict):
    """token_class, and above it (shifted by 4) the length of the bare token, with a memory of bounded size."""

    def __init__(self, function: frozenset[str]) -> None:
        super().__init__()
        self.function = function

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        k = self[token] = token_class(token, self.function) | len(token.strip(_TRIM)) << 4
        return k


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of p and each row of q."""
    p, q = p[:, None, :], q[None, :, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0)
        right = np.where(q > 0, q * np.log2(q / m), 0)
    return (left.sum(2) + right.sum(2)) / 2


def _table_of(profiles: tuple[tuple[str, dict[str, float]], ...]) -> tuple[np.ndarray, np.ndarray]:
    m = np.array([[p.get(c, 0.0) for c in CLASSES] for _, p in profiles]) + 1e-3
    return m / m.sum(1, keepdims=True), np.array([KINDS.index(k) for k, _ in profiles])


_PROFILE, _PROFILE_KIND = _table_of(PROFILES)
_LETTER = np.array([[float(x[1:]) for x in row.split()] for row in LETTERS.values()])
_LETTER /= _LETTER.sum(1, keepdims=True)
_FOLD = str.maketrans("àáâãäåçèéêëìíîïñòóôõöøùúûüýß", "aaaaaaceeeeiiiinoooooouuuuys")


def _segments(text: str) -> list[str]:
    out = []
    for line in text.split("\n"):
        if len(line) <= 300:
            if line.strip():
                out.append(line)
            continue
        tokens = line.split()
        if len(tokens) <= STRETCH * 3 // 2:
            out.append(line)
        else:
            out += [" ".join(tokens[i : i + STRETCH]) for i in range(0, len(tokens), STRETCH)]
    return out


def _letters(text: str) -> np.ndarray:
    """Counts of the letters a to z, marks folded."""
    low = text.lower()
    if not low.isascii():
        low = low.translate(_FOLD)
    return np.bincount(np.frombuffer(low.encode("ascii", "replace"), np.uint8), minlength=256)[97:123].astype(float)


def letter_divergence(text: str) -> float:
    """Of the text's letters from the nearest language's; 0 for few letters."""
    v = _letters(text)
    return float(_divergence((v / v.sum())[None], _LETTER).min()) if v.sum() >= LETTERS_LEAST else 0.0


def is_unknown_prose(lines: list[str], words: list[str], function: float) -> bool:
    """Lines made as prose is, of a language or script without a profile. words: their words as they stand; function: share of known function words."""
    text = "\n".join(lines)
    letters = sum(map(str.isalpha, text))
    ends = len(_SENTENCE.findall(text))
    if not letters or not ends:
        return False
    other = len(_OTHER_SCRIPT.findall(text))
    if other * 2 > letters:
        return letters <= SCRIPT_SENTENCE * ends and letters >= SCRIPT_LINE * len(lines)
    if function > UNKNOWN_FUNCTION or len(words) < 12:
        return False
    latin = [c for c in text.lower().translate(_FOLD) if c.isalpha()]
    vowels = sum(c in "aeiouyąęėįųūőűœæøåıșț" for c in latin) / len(latin)
    lower = sum(w[0].islower() for w in words) / len(words)
    short = sum(len(w) <= 3 for w in words) / len(words)
    return UNKNOWN_VOWELS[0] <= vowels <= UNKNOWN_VOWELS[1] and lower >= UNKNOWN_LOWER and UNKNOWN_SHORT[0] <= short <= UNKNOWN_SHORT[1] and UNKNOWN_SENTENCE[0] <= len(words) / ends <= UNKNOWN_SENTENCE[1]


_IS_SYMBOL = np.array([_SYMBOL.match(chr(i)) is not None for i in range(128)])


def _symbols(text: str) -> int:
    return int(_IS_SYMBOL[np.frombuffer(text.encode("ascii"), np.uint8)].sum()) if text.isascii() else len(_SYMBOL.findall(text))


def describe(texts: list[str], classes: _Classes) -> list[dict]:
    """Statistics and kind of each text."""
    owner, tokens_of, segs = [], [], []
    for d, text in enumerate(texts):
        for s in _segments(text):
            tokens_of.append((_CELL.sub(" ", s) if s.count(",") > s.count(", ") + 1 else s).split())
            owner.append(d)
            segs.append(s)
    own, sizes, every = np.array(owner, np.int64), np.array([len(t) for t in tokens_of], np.int64), list(chain.from_iterable(tokens_of))
    value = np.fromiter(map(classes.__getitem__, every), np.int64, len(every))
    k, seg = value & 15, np.repeat(np.arange(len(segs)), sizes)
    length = np.bincount(seg, weights=np.fromiter(map(len, every), np.int64, len(every)), minlength=len(segs))
    bare_chars = np.bincount(own[seg], weights=np.where((k != 4) & (k != 6), value >> 4, 0), minlength=len(texts))
    counts = np.bincount(seg * len(CLASSES) + k, minlength=len(segs) * len(CLASSES)).astype(float).reshape(-1, len(CLASSES))
    first = np.cumsum(sizes) - sizes
    for i, tokens in enumerate(tokens_of):
        if len(tokens) > 1 and len(tokens[0]) < 8 and _MARK.fullmatch(tokens[0]):
            counts[i, k[first[i]]] -= 1
            counts[i, 9] += 1
    kind = np.empty(0, np.int64)
    if len(counts):
        # neighbours within the text lend half their tokens
        near = counts.copy()
        for step in (1, 2):
            same = own[step:] == own[:-step]
            near[step:][same] += counts[:-step][same] / 2
            near[:-step][same] += counts[step:][same] / 2
        # a line alone counts more than its neighbours where it has enough tokens
        mixed = (counts + near) / 2
        near = mixed / np.maximum(mixed.sum(1, keepdims=True), 1)
        apart = _divergence(near, _PROFILE)
        kind = _PROFILE_KIND[apart.argmin(1)]
    bounds = np.searchsorted(own, np.arange(len(texts) + 1))
    out = []
    if not texts:
        return out
    shapes = np.zeros((len(texts), len(CLASSES)))
    np.add.at(shapes, own, counts)
    from_prose = _divergence(shapes / np.maximum(shapes.sum(1, keepdims=True), 1), _PROFILE[_PROFILE_KIND == 0]).min(1)
    letters = np.array([_letters(t) for t in texts])
    from_language = np.where(letters.sum(1) >= LETTERS_LEAST, _divergence(letters / np.maximum(letters.sum(1, keepdims=True), 1), _LETTER).min(1), 0.0)
    for d, text in enumerate(texts):
        a, b = bounds[d], bounds[d + 1]
        k, n = kind[a:b].copy(), length[a:b]
        total = counts[a:b].sum(0)
        loose = np.flatnonzero((k == 1) | (k == 3))
        if len(loose):
            # words in lines that are neither prose nor table: do they vary, and are they made of a language's letters?
            plain = [t.strip(_TRIM).lower() for i in loose for t in tokens_of[a + i] if classes[t] & 15 in (1, 8)]
            per_line = len(plain) / len(loose)
            kept = [segs[a + i] for i in loose]
            variety = len(set(plain)) / len(plain) if per_line > 5 else len(set(kept)) / len(kept)
            if len(plain) >= VARIETY_WORDS and variety < VARIETY_LEAST:
                k[loose] = 3
            elif is_unknown_prose(kept, [w for i in loose for t in tokens_of[a + i] if (w := t.strip(_TRIM)) and w[0].isalpha()], total[0] / max(1, total.sum())):
                k[loose] = 0
            elif letter_divergence(" ".join({t for i in loose for t in tokens_of[a + i]})) > LETTERS_MOST and total[7] * 4 < total.sum():
                k[loose] = 3
        chars = np.bincount(k, weights=n, minlength=len(KINDS))
        words = int(total.sum())
        lines = [x for x in text.split("\n") if x.strip()]
        shape = total / total.sum() if total.sum() else total
        solid = words - int(total[4] + total[6])
        out.append({
            "n_words": words,
            "mean_word_length": float(bare_chars[d]) / solid if solid else None,
            "symbol_ratio": _symbols(text) / len(text) if text else None,
            "line_punctuation": sum(x.rstrip().endswith(_PUNCTUATION) for x in lines) / len(lines) if lines else None,
            "common_words": float(shape[0]) if words else None,
            "prose_divergence": float(from_prose[d]) if words else None,
            "letter_divergence": float(from_language[d]),
            "kind": KINDS[int(chars.argmax())] if chars.sum() and chars.max() * 2 > chars.sum() else ("mixed" if chars.sum() else "empty"),
        })
    return out


_SCHEMA = "doc_id long, n_words long, mean_word_length double, symbol_ratio double, line_punctuation double, common_words double, prose_divergence double, letter_divergence double, kind string"


def text_quality(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_words: int = 100_000) -> DataFrame:
    """A row of statistics and the kind (prose, list, table, junk, mixed, empty) of each distinct (id, text).

    common_words: lang, word; at most most_words words, read to the driver. Null texts give no
    row; an empty or blank text is of kind empty, with null ratios. Extra columns are ignored.
    """
    known = [r["word"] for r in common_words.where("word is not null").select(F.lower("word").alias("word")).distinct().limit(most_words + 1).collect()]
    if len(known) > most_words:
        raise ValueError("too many common words")
    function = frozenset(known)
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes(function)
        each = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        kinds = {"n_words": pa.int64(), "kind": pa.string()}
        for batch in by_size(each, 1, most_rows=500):
            rows = describe([t for _, t in batch], classes)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in batch], pa.int64()), *(pa.array([r[c] for r in rows], kinds.get(c, pa.float64())) for c in names[1:])], names)

    rows = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(measure, _SCHEMA).distinct()
