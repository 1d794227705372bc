"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length.

Folding lower-cases, replaces homoglyphs and digit substitutions by the letters they imitate, and turns
everything between words into one blank. Lexicon entries are whole words or word beginnings; their weights are
smoothed log odds learnt from labelled documents. Exception phrases (given ones, and longer beginnings that
clean documents hold) cancel every entry inside the text they cover. The weighted hits and their share of the
words give the score through a logistic link.

Defined results: null and empty texts have no hits and score as such; repeated rows score alike; without
labels of both kinds the lexicon is the given seed list; an empty table gives an empty result; other columns
pass through, and a column with the score's name is replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.common import sliced, tidy
from pyspark.sql import types as T

#: Characters that imitate Latin letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h",
    "ԁ": "d", "ո": "n", "м": "m", "т": "t", "к": "k", "в": "b", "н": "h", "α": "a", "ο": "o", "ι": "i", "ν": "v",
    "ρ": "p", "τ": "t", "υ": "u", "κ": "k", "ε": "e", "ı": "i", "ł": "l", "ø": "o", "ɑ": "a", "ɡ": "g", "ʟ": "l",
}
#: Digits and signs that stand for letters inside a word.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: The lexicon before any label is seen, and phrases in which an entry is harmless.
SEEDS = ("idiot", "moron", "stupid", "pathetic", "worthless", "disgusting", "scum", "trash", "loser", "clown")
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "clownfish", "loser bracket", "pond scum")


class _Fold(dict):
    """Translation table filled on demand: one entry a code point met. Digits and signs stay for the reading of words."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        low = c.lower()
        if low in HOMOGLYPHS:
            out = HOMOGLYPHS[low]
        elif low in DIGITS:
            out = low
        elif c.isalnum():
            out = low
            flat = unicodedata.normalize("NFKC", low)
            if flat != low and flat.isascii():  # full-width and mathematical letters and digits
                out = "".join(x for x in flat.lower() if x.isalnum())
        elif unicodedata.category(c) in ("Mn", "Cf"):  # combining marks, zero-width joiners
            out = ""
        else:
            out = " "
        self[code] = out
        return out


_FOLD = _Fold()
_SIGNS = "".join(c for c in DIGITS if not c.isdigit())
_LETTERS = {ord(k): v for k, v in DIGITS.items()}
_ONLY_DIGITS = {ord(k): v for k, v in DIGITS.items() if k.isdigit()}
_DISGUISED = re.compile(rf"[{re.escape(''.join(DIGITS))}]")
_NOT_A_LETTER = re.compile(rf"[{re.escape(_SIGNS)}]+(?![^\W\d_])")
_APART = re.compile(rf"[{re.escape(_SIGNS)}]+")


def _readings(word: str) -> str:
    """A word with digits or signs, read with them as letters and, where signs stand between letters, also cut there."""
    if not any(c.isalpha() for c in word):
        return _APART.sub(" ", word)
    word = _NOT_A_LETTER.sub(" ", word.translate(_ONLY_DIGITS))  # a sign counts only before a letter
    joined, cut = word.translate(_LETTERS), _APART.sub(" ", word)
    return joined if joined == cut or word[0] in _SIGNS and not _APART.search(word[1:]) else f"{joined} {cut}"


def fold(text: str | None) -> str:
    """Folded words between single blanks, with a blank at either end.

    Digits stand for letters only in a word that has a letter; a sign does so only before a letter. A sign
    between two letters may also part two words, so such a word is read both ways, one after the other.
    """
    flat = (text or "").translate(_FOLD)
    if _DISGUISED.search(flat):
        flat = " ".join([_readings(w) if _DISGUISED.search(w) else w for w in flat.split()])
    return " " + " ".join(flat.split()) + " "


@dataclass
class Lexicon:
    """Word beginnings with weights, exception phrases, and the link's coefficients (bias, density, amount)."""

    weights: dict[str, float]
    exceptions: frozenset[str]
    link: tuple[float, float, float] = (-4.0, 1.0, 1.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for w, weight in self.weights.items():
                a.add_word(" " + w, (len(w) + 1, weight))
            for e in self.exceptions:
                a.add_word(" " + e, (len(e) + 1, None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def amount(self, folded: str) -> float:
        """Summed weight of the longest entry at each word, without entries inside the span of an exception."""
        a = self.automaton()
        if not len(a):
            return 0.0
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, weight) in a.iter(folded):
            at = end - n
            if weight is None:
                spared.append((at, end))
            elif n > best.get(at, (0, 0.0))[0]:
                best[at] = (n, weight)
        if spared:  # the exceptions that start no later than an entry, swept in order, reach so far
            spared.sort()
            reach, k = -1, 0
            for at in sorted(best):
                while k < len(spared) and spared[k][0] <= at:
                    reach, k = max(reach, spared[k][1]), k + 1
                if at + best[at][0] <= reach:
                    del best[at]
        return sum(w for _, w in best.values())

    def features(self, text: str | None) -> tuple[float, float]:
        folded = fold(text)
        total = self.amount(folded)
        return 100 * total / (folded.count(" ") + 19), math.log1p(total)

    def score(self, text: str | None) -> float:
        density, amount = self.features(text)
        bias, a, b = self.link
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, bias + a * density + b * amount))))


#: Beginnings of so many characters are candidates besides whole words.
STEMS = (4, 12)


def _candidates(text: str) -> set[str]:
    """Words, those under four letters with the blank after them, and the beginnings of longer ones."""
    out: set[str] = set()
    for w in set(fold(text).split()):
        out.add(w if len(w) >= STEMS[0] else w + " ")
        out.update(w[:n] for n in range(STEMS[0], min(len(w), STEMS[1]) + 1))
    return out


def _shorter(b: str) -> list[str]:
    """The candidates that are proper beginnings of this one."""
    return [b[:n] for n in range(STEMS[0], min(len(b), STEMS[1] + 1))]


def learn(rows: list[tuple[str, int]], least: int = 4, odds: float = 20.0) -> Lexicon:
    """A lexicon from labelled texts: words and beginnings `odds` times likelier in toxic documents.

    Of beginnings of each other the most frequent is kept, and of equally frequent ones the longest. There are
    at most as many entries as the rows hold candidates.
    """
    toxic = [t for t, y in rows if y == 1]
    clean = [t for t, y in rows if y == 0]
    if not toxic or not clean:
        return Lexicon(dict.fromkeys(SEEDS, 3.0), frozenset(EXCEPTIONS))
    held: Counter[str] = Counter()
    for t in toxic:
        held.update(_candidates(t))
    held = Counter({b: n for b, n in held.items() if n >= 3})
    against: Counter[str] = Counter()
    for t in clean:
        against.update(_candidates(t) & held.keys())
    weight = {
        b: math.log((n + 0.1) / (len(toxic) + 1)) - math.log((against[b] + 0.5) / (len(clean) + 1)) for b, n in held.items()
    }
    chosen: dict[str, float] = {}
    openings: set[str] = set()  # proper beginnings of what is chosen
    for b in sorted((b for b in held if held[b] >= least and weight[b] >= math.log(odds)), key=lambda b: (-held[b], -len(b), b)):
        if b not in openings and not any(x in chosen for x in _shorter(b)):
            chosen[b] = weight[b]
            openings.update(_shorter(b))
    for s in SEEDS:
        if not any(x in chosen for x in (*_shorter(s), s)):
            chosen[s] = 3.0
    learnt = {b for b in held if against[b] > 2 * held[b] and any(x in chosen for x in _shorter(b))}
    lexicon = Lexicon(chosen, frozenset({*EXCEPTIONS, *learnt}))
    x = np.array([lexicon.features(t) for t, _ in rows])
    y = np.array([label for _, label in rows], float)
    lexicon.link = _logistic(x, y)
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Newton steps for a logistic fit with a small ridge; deterministic."""
    x = np.column_stack((np.ones(len(x)), x))
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds (or replaces) the score column."""
    fields = [f for f in docs.schema.fields if f.name != score_col]
    schema = T.StructType([*fields, T.StructField(score_col, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in sliced(batches, 4096, text_col):
            table = {f.name: batch.column(f.name) for f in fields}
            table[score_col] = pa.array([own.score(t) for t in batch.column(text_col).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_pydict(table)

    return docs.mapInArrow(tidy(run), schema)
