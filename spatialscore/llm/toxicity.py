"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, reporting, self, modal, link, break, other). One transducer reads
the symbols of a sentence from its end and marks what a later report quotes. Then a cascade reads them from the start:
what is reported, what is negated, insults said of a target over several words, threats over several words, and what
comes after a target in the sentence. The last turns marked symbols into weights. The cascade is composed as it is
needed, so each pair of state and symbol is worked out once. A word outside any pattern keeps a small weight, which the
learned curve sets against the texts; stems of insults and that curve are learned.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Fixed word lists of the English grammar; insults of any language are learned as stems.
INSULTS = "idiot idiots moron morons scum loser losers trash stupid dumb pathetic worthless disgusting clown fool vermin filth".split()
THREATS = "kill hurt destroy beat shoot stab murder crush burn hang attack die suffer".split()
TARGETS = "you your yours yourself he him his she her hers they them their theirs people everyone".split()
NEGATIONS = "not no never neither nor isn aren wasn don doesn didn won without".split()
REPORTS = "said says say called calls claimed claims wrote writes told reported quoted according alleged".split()
SELVES = "i we".split()
MODALS = "will ll going gonna should must hope wish want deserve deserves let shall would".split()
LINKS = "a an the such so very really total complete utter absolute are re is am was were be been like as of to and all just".split()
#: A learned stem has this many letters at least and at most; a learned whole word has as many as LEAST_WORD.
STEM_LETTERS = range(4, 8)
LEAST_WORD = 3
#: Ends a stem that is a whole word.
WORD_END = "$"
WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[^\W\d_]+|[,;:\"“”«»„—]")
SENTENCE = re.compile(r"[^.!?\n|]+")
BREAK = ","

Symbol = str


@dataclass(frozen=True)
class Transducer:
    """States are numbers; an arc is (state, symbol) -> (state, symbol out). Without an arc ``otherwise`` decides."""

    arcs: dict[tuple[int, Symbol], tuple[int, Symbol]]
    otherwise: dict[int, int]

    def step(self, state: int, symbol: Symbol) -> tuple[int, Symbol]:
        return self.arcs.get((state, symbol)) or (self.otherwise.get(state, state), symbol)


def marked(*marks: str) -> list[Symbol]:
    """Insult and threat symbols with any subset of marks, in this order."""
    ends = [""]
    for m in marks:
        ends += [e + m for e in ends]
    return [k + e for k in "IT" for e in ends]


def quoted_before() -> Transducer:
    """Read from the end: before a reporting word and a break, insults and threats are quoted ("You idiot", he said)."""
    return Transducer({(0, "R"): (1, "R"), (1, BREAK): (2, BREAK), (2, "I"): (2, "Ir"), (2, "T"): (2, "Tr")}, {})


def reported_speech() -> Transducer:
    """From a reporting word that is not one's own to the end of the sentence, insults and threats are somebody else's."""
    return Transducer({(0, "R"): (1, "R"), (1, "I"): (1, "Ir"), (1, "T"): (1, "Tr"), (0, "S"): (2, "S"), (2, "S"): (2, "S")}, {2: 0})


def negation(reach: int = 3) -> Transducer:
    """A negation covers the next ``reach`` words."""
    arcs: dict[tuple[int, Symbol], tuple[int, Symbol]] = {(0, "N"): (reach, "N")}
    for s in range(1, reach + 1):
        arcs[s, "N"] = (reach, "N")
        for x in marked("r"):
            arcs[s, x] = (s - 1, x + "n")
    return Transducer(arcs, {s: s - 1 for s in range(1, reach + 1)})


def insult(words: int = 2) -> Transducer:
    """An insult said of a target: "you are such an idiot", "he is a total moron", "idiots like you".

    Between a target and an insult there may be links and ``words`` other words; between an insult and a target after
    it links only. The later of the two carries the mark.
    """
    arcs: dict[tuple[int, Symbol], tuple[int, Symbol]] = {}
    kinds = [x for x in marked("r", "n") if x[0] == "I"]
    after = {x: words + 2 + k for k, x in enumerate(kinds)}
    for s in range(words + 2 + len(kinds)):
        arcs[s, "G"] = (words + 1, "G")
        for x in kinds:
            arcs[s, x] = (after[x], x)
    for s in range(1, words + 2):
        arcs[s, "C"], arcs[s, "N"] = (s, "C"), (s, "N")
        for x in kinds:
            arcs[s, x] = (s, x + "p")
    for x, s in after.items():
        arcs[s, "C"] = (s, "C")
        arcs[s, "G"] = (words + 1, "G" + x)
    return Transducer(arcs, {s: s - 1 if s < words + 2 else 0 for s in range(1, words + 2 + len(kinds))})


def threat(words: int = 3) -> Transducer:
    """A threat announced or wished: a modal, up to ``words`` words, a threat word and, over links, whom it is for.

    "going to hurt you", "they should be shot", "hope you die". A target right after the threat word takes its marks.
    """
    arcs: dict[tuple[int, Symbol], tuple[int, Symbol]] = {}
    kinds = [x for x in marked("r", "n") if x[0] == "T"]
    after = {x: words + 2 + k for k, x in enumerate(kinds)}
    for s in range(words + 2 + len(kinds)):
        arcs[s, "M"] = (words + 1, "M")
        for x in kinds:
            arcs[s, x] = (after[x], x + "m" if 0 < s < words + 2 else x)
    for x, s in after.items():
        arcs[s, "C"] = (s, "C")
        arcs[s, "G"] = (0, "G" + x)
    return Transducer(arcs, {s: s - 1 if s < words + 2 else 0 for s in range(1, words + 2 + len(kinds))})


def aim() -> Transducer:
    """After a target, to the end of the sentence, insults and threats are aimed."""
    arcs: dict[tuple[int, Symbol], tuple[int, Symbol]] = {}
    targets = ["G", *("G" + x for x in marked("r", "n"))]
    for g in targets:
        arcs[0, g] = (1, g)
    for x in marked("r", "n", "p", "m"):
        arcs[1, x] = (1, x + "g")
    return Transducer(arcs, {})


# Weights of the grammar. A bare word is weak; a pattern of several words, or a target before, makes it count.
BARE, AIMED, PATTERN = {"I": 0.25, "T": 0.02}, {"I": 1.0, "T": 0.4}, {"I": 1.25, "T": 0.8}
REPORTED, NEGATED = 0.4, 0.3


def weight(symbol: Symbol) -> float:
    """Output of the last transducer, which has one state: the highest pattern, lowered by what reports or negates it."""
    kind, marks = symbol[0], symbol[1:]
    if kind == "G" and marks:
        kind, marks = marks[0], marks[1:] + "p"
    if kind not in BARE:
        return 0.0
    w = PATTERN[kind] if "p" in marks or "m" in marks else AIMED[kind] if "g" in marks else BARE[kind]
    return w * (REPORTED if "r" in marks else 1.0) * (NEGATED if "n" in marks else 1.0)


@dataclass
class Grammar:
    """The composed cascade over learned insult ``stems`` (stem -> weight)."""

    stems: dict[str, float]
    backward: Transducer = field(default_factory=quoted_before)
    cascade: tuple[Transducer, ...] = field(default_factory=lambda: (reported_speech(), negation(), insult(), threat(), aim()))
    known: dict = field(default_factory=dict)

    def __post_init__(self):
        lists = {"C": LINKS, "M": MODALS, "S": SELVES, "R": REPORTS, "N": NEGATIONS, "G": TARGETS, "T": THREATS, "I": INSULTS}
        self.fixed = {w: (kind, 1.0) for kind, words in lists.items() for w in words}
        self.sizes = sorted({len(s) for s in self.stems})

    def symbol(self, word: str) -> tuple[Symbol, float]:
        if not word[0].isalpha():
            return BREAK, 0.0
        w = self.stems.get(word + WORD_END)
        if w is not None:
            return "I", w
        for n in self.sizes:
            w = self.stems.get(word[:n]) if len(word) >= n else None
            if w is not None:
                return "I", w
        return self.fixed.get(word, ("O", 0.0))

    def step(self, states: tuple[int, ...], symbol: Symbol) -> tuple[tuple[int, ...], float]:
        """One arc of the composition, made when first met."""
        held = self.known.get((states, symbol))
        if held is None:
            out, x = [], symbol
            for t, s in zip(self.cascade, states):
                s, x = t.step(s, x)
                out.append(s)
            self.known[states, symbol] = held = (tuple(out), weight(x))
        return held

    def weights(self, words: list[str]) -> list[float]:
        """Weight of every word of one sentence; a target that ends a pattern has the learned weight of its insult."""
        symbols = [self.symbol(w) for w in words]
        state, read = 0, []
        for kind, _ in reversed(symbols):
            state, kind = self.backward.step(state, kind)
            read.append(kind)
        states, last, out = (0,) * len(self.cascade), 1.0, []
        for kind, (plain, w) in zip(reversed(read), symbols):
            states, factor = self.step(states, kind)
            last = w if plain in ("I", "T") else last
            out.append(factor * (last if plain == "G" else w))
        return out

    def clauses(self, text: str | None) -> list[tuple[str, float]]:
        """Matched clauses of a whole text with their weights; marks carry from clause to clause of a sentence."""
        text = (text or "").lower()
        hits = {w for w in set(WORD.findall(text)) if self.symbol(w)[0] in ("I", "T")}
        if not hits:
            return []
        out = []
        for m in SENTENCE.finditer(text):
            tokens = list(TOKEN.finditer(m[0]))
            words = [t[0] for t in tokens]
            if hits.isdisjoint(words):
                continue
            begin, total = 0, 0.0
            for t, w in zip(tokens, self.weights(words)):
                total += w
                if not t[0][0].isalpha():
                    if total > 0:
                        out.append((m[0][begin:t.start()].strip(), total))
                    begin, total = t.end(), 0.0
            if total > 0:
                out.append((m[0][begin:].strip(), total))
        return out

    def total(self, text: str | None) -> float:
        return sum(w for _, w in self.clauses(text))


def labelled_sample(labels: DataFrame, most: int = 20_000, id_col: str = "doc_id", label_col: str = "label") -> DataFrame:
    """(id_col, label): at most ``most`` labelled ids of each label, those with the least hash; all, if there are fewer.

    The rows that a grammar is fitted on: few enough to broadcast, so that texts need no shuffle to meet their labels.
    """
    rows = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).where("id IS NOT NULL").distinct()
    least = [rows.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y in (0, 1)]
    return stored(least[0].unionByName(least[1])).withColumnRenamed("id", id_col)


def _stems_of(text: str | None) -> set[str]:
    words = set(WORD.findall((text or "").lower()))
    return {w[:n] for w in words for n in STEM_LETTERS if len(w) >= n} | {w + WORD_END for w in words if len(w) >= LEAST_WORD}


def learn_stems(labelled: DataFrame, text_col: str = "text", label_col: str = "label", least_rows: int = 5,
                least_odds: float = 60.0) -> dict[str, float]:
    """Word stems and whole words that mark label 1: (stem -> weight in (0, 1]).

    A stem counts once per row, over all rows with label 0 or 1. Kept are all stems in at least ``least_rows`` toxic
    rows and ``least_odds`` times likelier there, but for those that another one begins. Repeated rows count each; null
    and empty texts have no stems; without rows of both labels there are none. Words of one or two letters are topic
    marks or list items more often than insults and are not learned.
    """
    rows = labelled.select(labelled[text_col].cast("string").alias("text"), labelled[label_col].cast("int").alias("y")).where("y IN (0, 1)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        sizes = [0, 0]

        def out() -> pa.RecordBatch:
            keys = list(held)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([held[k][0] for k in keys], pa.int64()),
                                               pa.array([held[k][1] for k in keys], pa.int64())], names=["stem", "neg", "pos"])
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                sizes[y] += 1
                for s in _stems_of(text.as_py()):
                    held.setdefault(s, [0, 0])[y] += 1
            if len(held) > 500_000:
                yield out()
                held = {}
        # The empty stem, which no word has, counts the rows.
        held[""] = sizes
        yield out()

    counts = stored(rows.mapInArrow(run, "stem string, neg long, pos long").groupBy("stem").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
                    .where((F.col("pos") >= least_rows) | (F.col("stem") == "")))
    every = counts.where("stem = ''").first()
    pos, neg = (every["pos"], every["neg"]) if every else (0, 0)
    if not pos or not neg:
        return {}
    odds = ((F.col("pos") + 0.5) / (pos + 1)) / ((F.col("neg") + 0.5) / (neg + 1))
    good = counts.where((F.col("stem") != "") & (F.col("pos") >= least_rows) & (odds >= least_odds))
    # The longest beginning that another stem may be: all letters of a whole word, all but one of a stem.
    longest = F.length("stem") - 1
    begun = good.where(longest >= STEM_LETTERS[0]).select(F.col("stem").alias("long"), F.explode(
        F.transform(F.sequence(F.lit(STEM_LETTERS[0]), longest), lambda n: F.col("stem").substr(F.lit(1), n))).alias("stem"))
    nested = begun.join(good.select("stem"), "stem").select(F.col("long").alias("stem")).distinct()
    best = good.join(nested, "stem", "left_anti").collect()
    return {r["stem"]: r["pos"] / (r["pos"] + r["neg"]) for r in best}


def totals(text: Column, grammar: Grammar) -> Column:
    """Sum of the weights of a text's matched clauses; 0 for null and empty texts.

    Row by row: repeated rows have equal sums, an empty table none; a very long text is read sentence by sentence.
    """
    stems = grammar.stems
    made: list[Grammar] = []

    def run(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Grammar(stems))
        return pa.array([made[0].total(t.as_py()) for t in texts], pa.float64())
    return F.arrow_udf(run, "double")(text.cast("string"))


@dataclass(frozen=True)
class Calibration:
    """Logistic curve of log(1 + total)."""

    slope: float
    offset: float

    def probability(self, total: Column) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.slope) * F.log1p(total) + F.lit(self.offset))))


def calibrate(rows: DataFrame, total_col: str = "total", label_col: str = "label", penalty: float = 0.01) -> Calibration:
    """Penalised logistic fit on all rows with label 0 or 1, from counts per 0.05 of log(1 + total).

    The counts reach the driver: one for each occupied step of a logarithm. Without rows of both labels the score of
    a text without matches is 0.05, and one whole insult gives 0.5.
    """
    x = F.round(F.log1p(F.col(total_col)) * 20) / 20
    bins = (rows.where(F.col(label_col).isin(0, 1)).groupBy(x.alias("x"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label_col)).alias("k")).collect())
    n, k = np.array([r["n"] for r in bins], float), np.array([r["k"] for r in bins], float)
    if not len(n) or k.sum() in (0, n.sum()):
        offset = math.log(0.05 / 0.95)
        return Calibration(-offset / math.log(2), offset)
    a = np.column_stack([[r["x"] for r in bins], np.ones(len(bins))])
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ beta))
        hess = a.T @ (a * (n * p * (1 - p))[:, None]) + penalty * np.eye(2)
        step = np.linalg.solve(hess, a.T @ (k - n * p) - penalty * beta)
        beta = beta + step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return Calibration(float(beta[0]), float(beta[1]))
