"""Toxicity: Levenshtein automata on a lexicon trie, and context windows around what they catch."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import FIT_ROWS, fold, training_sample

#: Insults that the lexicon has without any label (fixed values).
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "imbecile", "dumb", "retard", "bastard", "asshole", "bitch", "fuck", "shit", "cunt", "whore", "slut")
#: A term of the lexicon: rows it must be in, and how much likelier it is in toxic rows. The sample that it is learned from bounds the lexicon.
MIN_ROWS, RATIO = 3, 8.0
STEMS = (5, 6, 7)
#: Terms from this length on are caught with one edit.
FUZZY_FROM = 5
#: Words on each side of a caught term.
WINDOW = 12
REPORTING = frozenset("said says wrote quoted quote called claims claimed reported cited dit cite sagte zitiert dijo cita".split())
SECOND = frozenset("you your yourself u ur du dein deine dich tu te toi ton ta tes vous tú usted su".split())
QUOTES = frozenset("\"'“”‘’«»„")
EDGE = "\"'“”‘’«»„.,;:!?()[]{}<>|#*$%&-"
REMEMBERED = 300_000


def shortened(word: str) -> list[str]:
    """word without one of its characters, for each."""
    return [word[:k] + word[k + 1 :] for k in range(len(word))]


class Trie:
    """A lexicon of whole terms and stems with weights; search() walks it together with a word's Levenshtein automaton."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], fuzzy: frozenset[str] | None = None):
        """fuzzy: the terms that are caught with an edit too (default: all)."""
        self.next: list[dict[str, int]] = [{}]
        self.term: list[float | None] = [None]
        self.stem: list[float | None] = [None]
        for marks, values in ((self.term, terms), (self.stem, stems)):
            for word, weight in values.items():
                at = 0
                for c in word:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        self.term.append(None)
                        self.stem.append(None)
                    at = self.next[at][c]
                marks[at] = max(weight, marks[at] or 0.0)
        self.near = self if fuzzy is None else Trie({t: terms[t] for t in fuzzy}, {})
        if fuzzy is None:
            self.cut = frozenset(x for t in terms for x in (t, *shortened(t)))

    def possible(self, word: str) -> bool:
        """Whether a term can be one edit away: then the word or the term, or both without one character, are equal."""
        return word in self.cut or not self.cut.isdisjoint(shortened(word))

    def exact(self, word: str) -> float | None:
        """The weight of the term, or of the longest stem that the word begins with."""
        at, best = 0, None
        for c in word:
            at = self.next[at].get(c, -1)
            if at < 0:
                return best
            if self.stem[at] is not None:
                best = self.stem[at]
        return self.term[at] if self.term[at] is not None else best

    def search(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the best match with at most one edit (a swap of neighbours counts as one).

        A word is walked only where its deletions meet those of a term. A state of the automaton is (position in the word, edits
        so far); it moves along the trie's edges, so no term is visited that shares no prefix with what the word can become.
        """
        found = self.exact(word)
        if found is not None:
            return found, 0
        if len(word) < FUZZY_FROM or not self.near.possible(word):
            return None
        best = self.near._walk(word)
        return None if best is None else (best, 1)

    def _walk(self, word: str) -> float | None:
        best: float | None = None
        n = len(word)
        stack = [(0, 0, 0)]
        while stack:
            node, at, edits = stack.pop()
            if at == n and self.term[node] is not None and edits == 1:
                best = max(best or 0.0, self.term[node])
            if at == n and edits == 1:
                continue
            if edits == 1:
                child = self.next[node].get(word[at])
                if child is not None:
                    stack.append((child, at + 1, 1))
                continue
            if at < n:
                child = self.next[node].get(word[at])
                if child is not None:
                    stack.append((child, at + 1, 0))
                stack.append((node, at + 1, 1))
                if at + 1 < n and (swap := self.next[node].get(word[at + 1])) is not None and (child := self.next[swap].get(word[at])) is not None:
                    stack.append((child, at + 2, 1))
            for c, child in self.next[node].items():
                if at < n and c != word[at]:
                    stack.append((child, at + 1, 1))
                stack.append((child, at, 1))
        return best


def normalised(chunk: str) -> str:
    return chunk.strip(EDGE).lower()


def learn_lexicon(texts: list[str], labels: list[int]) -> tuple[dict[str, float], dict[str, float], frozenset[str]]:
    """Terms and stems that toxic rows have far more often, with their log ratios as weights, and the terms to catch with an edit:
    all those of at least FUZZY_FROM characters."""
    rows = [Counter(), Counter()]
    total = [1, 1]
    for text, y in zip(texts, labels, strict=True):
        total[y] += 1
        rows[y].update({normalised(x) for x in text.split()})
    base = total[0] / total[1]

    def weighed(toxic: Counter, clean: Counter, least: int) -> dict[str, float]:
        out = {}
        for term, b in toxic.items():
            ratio = (b + 0.5) / (clean.get(term, 0) + 1.0) * base
            if b >= least and ratio >= RATIO:
                out[term] = float(np.log(ratio))
        return out

    terms = {t: w for t, w in weighed(rows[1], rows[0], MIN_ROWS).items() if len(t) >= 3}
    stems = [Counter(), Counter()]
    for y in (0, 1):
        for term, n in rows[y].items():
            for k in STEMS:
                if len(term) > k:
                    stems[y][term[:k]] += n
    least = max(8, MIN_ROWS + total[1] // 50)
    found = weighed(stems[1], stems[0], least)
    # a stem counts only where many different words carry it, and its shortest form stands for the longer ones
    forms = Counter(t[:k] for t in rows[1] for k in STEMS if len(t) > k and t[:k] in found)
    found = {s: w for s, w in found.items() if forms[s] >= 6 and not any(s[:k] in found for k in range(1, len(s)))}
    for seed in SEEDS:
        terms.setdefault(seed, float(np.log(RATIO)))
    fuzzy = frozenset(t for t in terms if len(t) >= FUZZY_FROM)
    return terms, found, fuzzy


FEATURES = ("sum", "worst window", "distinct", "density", "fuzzy share", "quoted share", "addressed share", "strong")


class Detector:
    """Catches lexicon terms in texts and turns them into features."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], fuzzy: frozenset[str] | None = None):
        self.trie = Trie(terms, stems, fuzzy)
        self.known: dict[str, tuple[float, int] | None] = {}
        self.clean: set[str] = set()

    def look_up(self, chunk: str) -> tuple[float, int] | None:
        if chunk in self.known:
            return self.known[chunk]
        found = self.trie.search(normalised(chunk))
        if found is None and len(self.clean) < REMEMBERED:
            self.clean.add(chunk)
        elif found is not None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[chunk] = found
        return found

    def features(self, text: str | None) -> list[float]:
        chunks = (text or "").split()
        if len(self.clean) >= REMEMBERED:
            self.clean.clear()
        caught = {c: f for c in set(chunks) - self.clean if (f := self.look_up(c)) is not None}
        if not caught:
            return [0.0] * len(FEATURES)
        hits = [(k, *caught[c]) for k, c in enumerate(chunks) if c in caught]
        quoted = addressed = 0.0
        weights = []
        for k, weight, edits in hits:
            around = chunks[max(0, k - WINDOW) : k + WINDOW + 1]
            bare = {normalised(c) for c in around}
            inside = chunks[k][0] in QUOTES or chunks[k][-1] in QUOTES
            opened = any(c[0] in QUOTES for c in chunks[max(0, k - 6) : k]) and any(c[-1] in QUOTES for c in chunks[k : k + 7])
            about = (inside or opened) + 0.5 * bool(bare & REPORTING)
            you = bool(bare & SECOND)
            quoted += about > 0
            addressed += you
            weights.append(weight * (0.7 if edits else 1.0) * (0.5 if about >= 1 and not you else 1.0))
        at = np.array([h[0] for h in hits])
        sums = np.cumsum([0.0, *weights])
        worst = float(np.max(sums[np.searchsorted(at, at + 2 * WINDOW, "right")] - sums[np.arange(len(at))]))
        n = len(hits)
        return [
            float(np.log1p(sums[-1])),
            float(np.log1p(worst)),
            float(np.log1p(len({normalised(chunks[h[0]]) for h in hits}))),
            float(np.log1p(1000 * n / len(chunks))),
            sum(h[2] for h in hits) / n,
            quoted / n,
            addressed / n,
            float(np.log1p(sum(w >= 4 for w in weights))),
        ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Newton's method with a ridge; the last weight is the bias."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) / max(1, len(y)) + penalty * w / 10
        hessian = (a * (p * (1 - p))[:, None]).T @ a / max(1, len(y)) + np.diag(penalty / 10 + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(texts: list[str], labels: list[int]) -> tuple[dict[str, float], dict[str, float], frozenset[str], np.ndarray]:
    """Terms, stems, terms to catch with an edit, and the weights of the features. The lexicon is learned on two thirds of the rows at a time and
    the features of the other third train the weights, so these see terms as unlabelled texts have them."""
    terms, stems, fuzzy = learn_lexicon(texts, labels)
    x = np.zeros((len(texts), len(FEATURES)))
    for part in range(3):
        rest = [k for k in range(len(texts)) if k % 3 != part]
        detector = Detector(*learn_lexicon([texts[k] for k in rest], [labels[k] for k in rest]))
        for k in range(part, len(texts), 3):
            x[k] = detector.features(texts[k])
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        weights = np.array([2.0, 2.0, 1.0, 0.5, 0.0, -1.0, 0.5, 1.0, -4.0])
    else:
        weights = fit_logistic(x, y)
    return terms, stems, fuzzy, weights


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, modulus: int = 5, held_out: int = 0, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row a document: doc_id, held_out, score (0 to 1), predicted (1 from threshold on) and caught.

    The lexicon and weights come from up to fit_rows labelled rows outside the held-out fold (crc32 of the id as text, modulo `modulus`).
    A word is caught if it is a term, begins with a stem, or is one edit from a term of FUZZY_FROM characters or more. Null and empty texts catch nothing and get the base score; texts of any
    length are read whole. Repeated rows get equal scores, null ids stay; an empty table gives no rows, and without labels the seeds alone are caught. Further columns of either table are ignored.
    The broadcast model has the terms and stems of the sample's rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(*training_sample(docs, labels, "toxic", modulus, held_out, fit_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, stems, fuzzy, weights = model.value
        detector = Detector(terms, stems, fuzzy)
        for batch in batches:
            x = np.array([detector.features(t) for t in batch["text"].to_pylist()], float).reshape(-1, len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(x[:, 0] > 0)], names=["doc_id", "held_out", "score", "predicted", "caught"])

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold() % modulus == held_out).alias("held_out"))
    return ready.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, caught boolean")
