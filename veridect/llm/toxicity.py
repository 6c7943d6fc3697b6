"""Toxicity scores from a learned lexicon, matched through Levenshtein automata on its trie.

Learning reads a bounded sample of labelled rows (``max_labelled``, by hash of
the id): document counts of whole words and of word beginnings under either
label give a lexicon, and a small logistic model weighs what the lexicon finds.
Matching walks a word through the product of the lexicon's trie and a
Levenshtein automaton; the product is made deterministic on the fly, so a word
costs one table look-up per letter. A window of words around each hit tells
quotation and report from direct address.

Defined cases: a NULL or empty text has no hits and gets the score of a text
without hits. Equal texts get equal scores. Labels that are NULL, or for ids
without a row, are left out; of several labels of one id the largest counts. If
no labelled row has label 1 (or none has 0), the seed lexicon is used with a
fixed model. An empty table gives an empty result. Scores read the text only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridect.llm.frames import ByteBoundCache, make_room, remembers, small_batches, stored

WORD = re.compile(r"[^\W\d_]+")
# Common insults that belong to the lexicon before any label is read.
SEEDS = "bastard clown creep crap disgusting dumb dumbass fool idiot imbecile jerk loser moron pathetic pig retard scum stupid trash worthless".split()
# Words that report speech, and words of direct address.
REPORTING = frozenset(
    "said says say called calls wrote writes quoted quote quotes term word phrase reported reports alleged sagte schrieb nannte wort dit écrit mot dijo escribió palabra".split()
)
ADDRESS = frozenset("you your you're youre u ur du dein deine ihr euch tu toi vous votre tú eres usted".split())
QUOTES = frozenset("\"“”„«»‟″")
LETTERS = re.compile(r"[^\W\d_]+|[\"“”„«»‟″]")


class LexiconAutomaton:
    """Trie of terms and term beginnings, with up to one edit per term of five letters or more.

    A state is a set of (trie node, edits); ``match`` gives (term, edits) of the
    heaviest match, where an edit counts for less, or None.
    """

    def __init__(self, words: dict[str, float], prefixes: dict[str, float], fuzzy_length: int = 5):
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, str] = {}
        self.prefix_at: dict[int, str] = {}
        self.weights = {**{p + "*": w for p, w in prefixes.items()}, **words}
        self.fuzzy_below = [False]  # whether the subtree has a term that allows an edit
        for term in sorted(words):
            self._add(term, len(term) >= fuzzy_length, self.word_at, term)
        for term in sorted(prefixes):
            self._add(term, False, self.prefix_at, term + "*")
        self.fuzzy_length = fuzzy_length
        self.letters = {c for node in self.children for c in node}
        self._begin()

    def _begin(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accept: list[tuple[str, int] | None] = []
        self.begins: list[str | None] = []
        self.start = self._state({(0, 0)})

    def settle(self) -> None:
        """Forgets the states if words have led to too many of them."""
        if len(self.members) > KEPT_STATES:
            self._begin()

    def _add(self, term: str, fuzzy: bool, ends: dict[int, str], name: str) -> None:
        node = 0
        self.fuzzy_below[0] |= fuzzy
        for c in term:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.fuzzy_below.append(False)
            node = self.children[node][c]
            self.fuzzy_below[node] |= fuzzy
        ends[node] = name

    def _state(self, items: set[tuple[int, int]]) -> int:
        # a letter of the term that the word leaves out; never the first one
        for node, edits in list(items):
            if edits == 0 and node:
                items |= {(child, 1) for child in self.children[node].values() if self.fuzzy_below[child]}
        key = frozenset((n, e) for n, e in items if not (e and (n, 0) in items))
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.moves.append({})
            ends = [(self.word_at[n], e) for n, e in key if n in self.word_at and (not e or len(self.word_at[n]) >= self.fuzzy_length)]
            self.accept.append(max(ends, key=lambda x: (self.weights[x[0]] * STRENGTH[x[1]], x)) if ends else None)
            begins = [self.prefix_at[n] for n, e in key if not e and n in self.prefix_at]
            self.begins.append(max(begins, key=lambda p: (self.weights[p], p)) if begins else None)
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        items = set()
        for node, edits in self.members[state]:
            if c in self.children[node]:
                child = self.children[node][c]
                if not edits or self.fuzzy_below[child]:
                    items.add((child, edits))
            if not edits and node and self.fuzzy_below[node]:
                items.add((node, 1))  # a letter too many
                items |= {(child, 1) for child in self.children[node].values() if self.fuzzy_below[child]}
        return self._state(items)

    def match(self, word: str) -> tuple[str, int] | None:
        state, best = self.start, None
        for c in word:
            if not self.members[state]:
                break
            c = c if c in self.letters else "\0"
            moves = self.moves[state]
            if c not in moves:
                moves[c] = self._move(state, c)
            state = moves[c]
            begin = self.begins[state]
            if begin is not None and (best is None or self.weights[begin] > self.weights[best]):
                best = begin
        else:
            whole = self.accept[state]
            if whole is not None and (best is None or self.weights[whole[0]] * STRENGTH[whole[1]] >= self.weights[best]):
                return whole
        return (best, 0) if best is not None else None


#: What a worker remembers: bytes of words without a hit, words with one and their length, states of the automaton.
CLEAN_BYTES, KNOWN_HITS, LONGEST_KEPT, KEPT_STATES = 48 << 20, 20_000, 64, 50_000

#: What a hit with no or one edit counts.
STRENGTH = (1.0, 0.75)
FEATURES = 5


@dataclass(frozen=True)
class ToxicityModel:
    words: tuple[tuple[str, float], ...]
    prefixes: tuple[tuple[str, float], ...]
    coefficients: tuple[float, ...] = field(default=())
    window: int = 6
    quoted: float = 0.5


@lru_cache(maxsize=2)
def _matcher(words: tuple, prefixes: tuple) -> tuple[LexiconAutomaton, ByteBoundCache, dict[str, tuple[str, int]]]:
    """The automaton, the words without a hit seen lately, and hits."""
    return LexiconAutomaton(dict(words), dict(prefixes)), ByteBoundCache(CLEAN_BYTES), {}


remembers("toxicity", _matcher.cache_clear)


def settle(model: ToxicityModel) -> None:
    """Between batches, forgets what outgrows its bound."""
    automaton, clean, _ = _matcher(model.words, model.prefixes)
    clean.settle()
    automaton.settle()


def hits(model: ToxicityModel, text: str | None) -> list[tuple[str, str, int, float, float]]:
    """(word, term, word place, strength, context) of each hit."""
    automaton, clean, known = _matcher(model.words, model.prefixes)
    low = (text or "").lower()
    distinct = set(WORD.findall(low))
    found = {}
    for word in clean.unknown(distinct):
        hit = known.get(word) or automaton.match(word)
        if hit is None:
            clean[word] = b""
            continue
        found[word] = hit
        if len(known) >= KNOWN_HITS:
            known.clear()
        if len(word) <= LONGEST_KEPT:
            known[word] = hit
    if not found:
        return []
    parts = LETTERS.findall(low)
    out = []
    open_quote = False
    for i, part in enumerate(parts):
        if part in QUOTES:
            open_quote = not open_quote if part in "\"″‟" else part in "“„«"
            continue
        if part not in found:
            continue
        term, edits = found[part]
        near = parts[max(0, i - model.window) : i + model.window + 1]
        quoted = open_quote and any(p in QUOTES for p in parts[i + 1 : i + 1 + 5 * model.window])
        context = model.quoted if quoted or not REPORTING.isdisjoint(near) else 1.0
        if not ADDRESS.isdisjoint(near):
            context = min(1.0, context * 1.5)
        out.append((part, term, i, automaton.weights[term] * STRENGTH[edits], context))
    return out


def features(model: ToxicityModel, text: str | None) -> list[float]:
    found = hits(model, text)
    if not found:
        return [0.0] * FEATURES
    strengths = [s * c for _, _, _, s, c in found]
    words = len(WORD.findall(text))
    return [
        max(strengths),
        float(np.log1p(sum(strengths))),
        float(np.log1p(len({w for w, *_ in found}))),
        float(np.log1p(100 * sum(strengths) / words)),
        1.0,
    ]


def _probability(model: ToxicityModel, rows: np.ndarray) -> np.ndarray:
    c = np.array(model.coefficients)
    return 1 / (1 + np.exp(-np.clip(rows @ c[1:] + c[0], -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    c = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ c)
        c = c + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in c)


def _lexicon(sample: DataFrame, prefix_lengths: range, min_gain: float, size: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings that label 1 favours, with their log odds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in small_batches(batches, "t"):
            for text, y in zip(batch.column("t").to_pylist(), batch.column("y").to_pylist(), strict=True):
                words = set(WORD.findall((text or "").lower()))
                counts[y].update(words)
                counts[y].update({w[:k] + "*" for w in words for k in prefix_lengths if len(w) > k})
                counts[y][""] += 1  # the number of documents
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield table(counts)
                counts = (Counter(), Counter())
        yield table(counts)

    def table(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        # a term that no toxic document of this part has still needs its other count
        terms = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)]
        return pa.RecordBatch.from_arrays(columns, names=["term", "n0", "n1"])

    counts = stored(
        sample.select("t", "y").mapInArrow(count, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "terms"
    )
    total = counts.filter("term = ''").first()
    if total is None or not total["n0"] or not total["n1"]:
        return {}, {}
    d0, d1 = float(total["n0"]), float(total["n1"])
    n = F.col("n0") + F.col("n1")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)

    gain = sum(
        (part(seen, n * (d / (d0 + d1))) + part(d - seen, (d0 + d1 - n) * (d / (d0 + d1))) for seen, d in ((F.col("n0"), d0), (F.col("n1"), d1))),
        F.lit(0.0),
    )
    odds = F.log((F.col("n1") + 0.5) / (d1 + 1)) - F.log((F.col("n0") + 0.5) / (d0 + 1))
    best = (
        counts.filter("term <> ''")
        .select("term", "n1", gain.alias("gain"), odds.alias("odds"))
        .filter((F.col("gain") >= min_gain) & (F.col("odds") >= 2.0))
        .orderBy(F.desc("gain"), "term")
        .limit(size)
        .collect()
    )
    words = {r["term"]: min(r["odds"], 8.0) for r in best if not r["term"].endswith("*")}
    # a beginning is worth keeping if it stands for several words, not for one that is listed anyway
    largest = {p: 0 for p in (r["term"][:-1] for r in best if r["term"].endswith("*"))}
    for r in best:
        for k in prefix_lengths:
            if r["term"] in words and r["term"][:k] in largest:
                largest[r["term"][:k]] = max(largest[r["term"][:k]], r["n1"])
    prefixes = {r["term"][:-1]: min(r["odds"], 8.0) for r in best if r["term"].endswith("*") and r["n1"] >= 1.5 * largest[r["term"][:-1]]}
    return words, prefixes


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(t, y) of at most ``max_labelled`` labelled documents; their ids are few enough to be broadcast."""
    known = labels.filter("toxic is not null").groupBy(F.col("doc_id").alias("l")).agg(F.max("toxic").alias("y")).filter(_slot("l") != 2)
    # a margin above the bound is not needed: the limit is the bound
    chosen = known.orderBy(F.xxhash64("l"), "l").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("l"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "l")
    return stored(rows.select("t", F.when(F.col("y") > 0, 1).otherwise(0).alias("y")), "labelled")


def _slot(column: str) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 4


def held_out(column: str) -> Column:
    return _slot(column) == 2


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = 20_000,
    lexicon_size: int = 1000,
    prefix_lengths: range = range(3, 8),
    min_gain: float = 20.0,
) -> ToxicityModel:
    """Learns from labelled rows outside the held-out quarter, ``max_labelled`` of them at most."""
    sample = training_rows(docs, labels, max_labelled)
    words, prefixes = _lexicon(sample, prefix_lengths, min_gain, lexicon_size)
    strongest = max([*words.values(), *prefixes.values(), 4.0])
    words = {**dict.fromkeys(SEEDS, strongest), **words}
    model = ToxicityModel(tuple(sorted(words.items())), tuple(sorted(prefixes.items())))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "t"):
            settle(model)
            rows = [features(model, t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("y")], names=["x", "y"])

    # bounded by max_labelled rows of a few numbers
    rows = sample.mapInArrow(measure, "x array<double>, y int").collect()
    y = np.array([r["y"] for r in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        return ToxicityModel(model.words, model.prefixes, (-3.0, 5.0 / strongest, 0.5, 0.0, 0.0, 0.0))
    return ToxicityModel(model.words, model.prefixes, _fit(np.array([r["x"] for r in rows]), y))


def toxicity(model: ToxicityModel, text: str | Column) -> Column:
    """Struct of score and the terms that were hit, for a text column."""

    @F.pandas_udf("score double, terms array<string>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        make_room("toxicity")
        for texts in batches:
            settle(model)
            texts = texts.where(texts.notna(), None)
            rows = np.array([features(model, t) for t in texts], dtype=float).reshape(len(texts), FEATURES)
            terms = [sorted({h[1] for h in hits(model, t)}) if row[-1] else [] for t, row in zip(texts, rows, strict=True)]
            yield pd.DataFrame({"score": _probability(model, rows), "terms": terms})

    return scored(F.col(text) if isinstance(text, str) else text)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, terms of each document."""
    scored = docs.select(F.col(id_col).alias("doc_id"), toxicity(model, text_col).alias("found"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "found.score", "found.terms")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, all columns unchanged."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), toxicity(model, text_col).alias("found"))
    return rows.filter(F.col("found.score") < threshold).select("row.*")
