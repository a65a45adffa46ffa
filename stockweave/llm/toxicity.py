"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as a few classes: insult, likely insult, threat, target, negation, report and
other. Small transducers rewrite and weigh the classes: negation and reported
speech turn an insult or a threat into a harmless one, the threat transducer asks
for a target behind the verb, the target transducer adds weight to an insult that
is aimed at somebody. Their composition is one deterministic machine, which reads
each clause that holds a word of the lexicon. Documents are scored by their
matched clauses, with weights fitted to labels.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm.labelled import labelled_sample
from stockweave.llm.quality import scored
from stockweave.session import written

# Labelled rows of each kind that the fit may draw, at most, and word stems that
# may join the lexicon: their lengths, the toxic texts each must explain, and how
# much more often toxic texts must have them.
SAMPLE = 3000
LEARNT_STEMS = 100
STEM_CHARS = (3, 9)
LEAST = 4
LIKELY, SURE = 20, 100

# The grammar's words (fixed values), English, German, French and Spanish.
INSULTS = (
    "idiot idiots moron morons imbecile imbeciles loser losers scum trash garbage filth vermin"
    " clown clowns stupid dumb pathetic worthless disgusting degenerate scumbag bastard bastards"
    " asshole bitch coward cretin halfwit"
    " dummkopf trottel abschaum arschloch versager idioten"
    " connard salaud abruti crétin ordure imbécile minable"
    " imbécil estúpido estúpida escoria cabrón pendejo basura"
)
THREATS = (
    "kill hurt destroy murder beat strangle stab shoot burn crush"
    " töten umbringen vernichten tuer détruire frapper matar destruir golpear"
)
TARGETS = (
    "you your yours u he she they him her them everyone people"
    " du dich dir ihr euch sie toi tu vous ils elles tú vosotros ustedes ellos"
)
NEGATIONS = (
    "not never no isn't aren't wasn't don't doesn't didn't nobody without"
    " nicht kein keine nie pas jamais aucun nunca jamás ningún sin"
)
REPORTS = (
    "said says called calls wrote quoted reported claimed allegedly"
    " sagte nannte schrieb laut dit appelé écrit selon dijo llamó escribió según"
)
CLASSES = dict(I=INSULTS, T=THREATS, Y=TARGETS, N=NEGATIONS, R=REPORTS)

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE = re.compile(r"[.!?;:\n]+")

# Words over which a negation reaches, and over which a threat finds its target.
REACH = 3


@dataclass
class Transducer:
    """States are numbers from 0; arcs give the next state, the output and weights.

    Weights are counts by name; a symbol without an arc passes and resets nothing.
    """

    arcs: dict[tuple[int, str], tuple[int, str, tuple[str, ...]]] = field(default_factory=dict)

    def arc(self, state, symbol, target, out=None, *weights):
        self.arcs[state, symbol] = (target, symbol if out is None else out, weights)

    def step(self, state: int, symbol: str):
        return self.arcs.get((state, symbol), (state, symbol, ()))

    def symbols(self) -> set[str]:
        return {s for _, s in self.arcs}


@dataclass
class Composed:
    """Cascade of transducers: the output of each is the input of the next."""

    table: dict[tuple[int, str], tuple[int, tuple[str, ...]]]

    @classmethod
    def of(cls, *machines: Transducer, alphabet: str) -> Composed:
        numbers, todo, table = {(0,) * len(machines): 0}, [(0,) * len(machines)], {}
        while todo:
            states = todo.pop()
            for symbol in alphabet:
                out, weights, after = symbol, [], []
                for machine, state in zip(machines, states, strict=True):
                    state, out, more = machine.step(state, out)
                    after.append(state)
                    weights += more
                key = tuple(after)
                if key not in numbers:
                    numbers[key] = len(numbers)
                    todo.append(key)
                table[numbers[states], symbol] = (numbers[key], tuple(weights))
        return cls(table)

    def read(self, symbols: str) -> list[str]:
        state, found = 0, []
        for s in symbols:
            state, more = self.table[state, s]
            found += more
        return found


def negation() -> Transducer:
    """An insult or threat up to REACH words behind a negation becomes harmless."""
    t = Transducer()
    for state in range(REACH + 1):
        t.arc(state, "N", REACH)
        for s in "IJTYRO":
            harmless = state and s in "IJT"
            t.arc(state, s, max(0, state - 1), "n" if harmless else s,
                  *(["negated"] if harmless else []))
    return t


def report() -> Transducer:
    """What stands behind a verb of speech in a clause is somebody else's."""
    t = Transducer()
    t.arc(0, "R", 1)
    for s in "IJT":
        t.arc(1, s, 1, "r", "reported")
    return t


def threat() -> Transducer:
    """A threat counts when a target follows within REACH words."""
    t = Transducer()
    for state in range(REACH + 1):
        t.arc(state, "T", REACH)
        t.arc(state, "Y", 0, "Y", *(["threat"] if state else []))
        for s in "IJONRnr":
            t.arc(state, s, max(0, state - 1))
    return t


def insult() -> Transducer:
    """The first insult of a clause makes the clause an insulting one, others add to it."""
    t = Transducer()
    t.arc(0, "I", 1, "I", "clause")
    t.arc(1, "I", 1, "I", "more")
    for state in (0, 1):
        t.arc(state, "J", state, "J", "likely")
    return t


def target() -> Transducer:
    """A target and an insult in one clause, in either order: aimed, once."""
    t = Transducer()
    t.arc(0, "Y", 1)
    for s in "IJ":
        t.arc(0, s, 2)
        t.arc(1, s, 3, s, "aimed")
    t.arc(2, "Y", 3, "Y", "aimed")
    return t


WEIGHTS = ("clause", "likely", "more", "aimed", "threat", "negated", "reported")

# Log odds before any label is seen: the fit is drawn towards them.
PRIOR = np.array([-3.0, 5.0, 3.0, 0.5, 0.5, 5.0, -0.5, -0.5])


class Grammar:
    """The composed machine over a lexicon; words that begin with a stem have its class."""

    def __init__(self, stems: dict[str, str] | None = None):
        stems = stems or {}
        self.classes = {w: c for c, words in CLASSES.items() for w in words.split()}
        self.stems = {c: tuple(s for s, k in stems.items() if k == c) for c in "IJ"}
        marked = "|".join(re.escape(w) for w, c in self.classes.items() if c in "IT")
        begun = "|".join(map(re.escape, stems))
        # Clauses without any of these cannot match.
        self.marked = re.compile(rf"\b(?:(?:{marked})\b" + (f"|{begun})" if stems else ")"))
        self.machine = Composed.of(
            negation(), report(), threat(), insult(), target(), alphabet="IJTYNRO"
        )

    def clauses(self, text: str):
        """Weights matched in each clause that holds a word of the lexicon."""
        low, done = text.lower(), -1
        for hit in self.marked.finditer(low):
            if hit.start() < done:
                continue
            begin = max((low.rfind(c, 0, hit.start()) for c in ".!?;:\n"), default=-1) + 1
            end = CLAUSE.search(low, hit.end())
            done = end.start() if end else len(low)
            words = WORD.findall(low[begin:done].replace("’", "'"))
            yield self.machine.read("".join([self.class_of(w) for w in words]))

    def class_of(self, word: str) -> str:
        if word in self.classes:
            return self.classes[word]
        return next((c for c in "IJ" if word.startswith(self.stems[c])), "O")

    def features(self, text: str) -> list[float]:
        """1, then log(1 + number) of each weight over the document's clauses."""
        counts = dict.fromkeys(WEIGHTS, 0)
        for found in self.clauses(text):
            for w in found:
                counts[w] += 1
        return [1.0, *[float(np.log1p(counts[w]) / np.log(2)) for w in WEIGHTS]]


def fit_weights(x: np.ndarray, y: np.ndarray, pull: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards PRIOR."""
    w = PRIOR.copy()
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pull * (w - PRIOR)
        h = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn_stems(rows: DataFrame, n_stems: int = LEARNT_STEMS) -> dict[str, str]:
    """Beginnings of words that toxic training texts have and clean ones (almost) lack.

    Returns each stem with its class: I where toxic texts have it SURE times as
    often as clean ones, J (a likely insult) where LIKELY times.

    ``rows`` is the bounded sample (kind, text). Insults may be inflected, so all
    beginnings of STEM_CHARS are counted by document. Then the stem that explains
    most of the toxic texts still unexplained is taken, again and again, so that
    words which only come along (in copies of one text) are not; of stems that
    explain as much, the longest is taken.
    """
    low, high = STEM_CHARS
    words = rows.select(
        "kind",
        F.xxhash64("text").alias("doc"),
        F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word"),
    ).where(F.length("word") >= low)
    stems = words.select(
        "kind",
        "doc",
        F.explode(
            F.transform(
                F.sequence(F.lit(low), F.least(F.length("word"), F.lit(high))),
                lambda n: F.substring("word", F.lit(1), n),
            )
        ).alias("stem"),
    ).distinct()
    sizes = {r.kind: r.n for r in rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    counts = stems.groupBy("stem").agg(
        F.count_if(F.col("kind") == 1).alias("toxic"), F.count_if(F.col("kind") == 0).alias("clean")
    )
    likely = (
        counts.withColumn(
            "odds", F.col("toxic") * n_clean / ((F.col("clean") + 0.5) * max(n_toxic, 1))
        )
        .where((F.col("toxic") >= LEAST) & (F.col("odds") >= LIKELY))
        .orderBy(F.desc("toxic"), "stem")
        .limit(10 * n_stems)
    )
    held = (
        stems.where(F.col("kind") == 1)
        .join(F.broadcast(likely.select("stem", "odds")), "stem")
        .groupBy("stem", "odds")
        .agg(F.collect_set("doc").alias("docs"))
        .collect()
    )
    left, out = {r.stem: set(r.docs) for r in held}, {}
    odds = {r.stem: r.odds for r in held}
    while left and len(out) < n_stems:
        stem = min(left, key=lambda w: (-len(left[w]), -len(w), w))
        explained = left.pop(stem)
        if len(explained) < LEAST:
            break
        out[stem] = "I" if odds[stem] >= SURE else "J"
        left = {w: d - explained for w, d in left.items()}
    return out


def fit_on(df: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, **cols):
    """Lexicon and weights from at most ``sample`` training rows of each label."""
    rows = written(
        labelled_sample(df, labels, label, {0: sample, 1: sample}, **cols), "toxic-sample"
    )
    grammar = Grammar(learn_stems(rows))

    def run(batches):
        for b in batches:
            x = [grammar.features(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["kind", "x"]
            )

    got = rows.mapInArrow(run, "kind int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(PRIOR))
    return grammar, fit_weights(x, got["kind"].to_numpy(float))


def score_toxicity(
    df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **how
) -> DataFrame:
    """``df`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (score >= 0.7).

    Whole texts are read; a null or empty one scores as a text without a match.
    Without labels the weights are those set beforehand. Repeated rows get equal
    scores; a null id counts as an empty text for ``held_out``. Columns of the new
    names are replaced, others stay. An empty table gives an empty table.
    """
    grammar, weights = fit_on(df, labels, text=text, doc_id=doc_id, **how)
    base = 1 / (1 + np.exp(-weights[0]))

    def score_of(texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), base)
        for k, t in enumerate(texts):
            x = grammar.features(t.decode(errors="replace"))
            if any(x[1:]):
                out[k] = 1 / (1 + np.exp(-np.clip(weights @ x, -35, 35)))
        return out

    return scored(df, score_of, 0.7, text, doc_id)
