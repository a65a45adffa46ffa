"""Quality rules: a decision list learnt by sequential covering (built-in functions only).

Each text gets a few counts, and ratios of them. From the counts of labelled rows, rules
are learnt one by one: a rule grows as a conjunction of thresholds, each the one with the
best gain on the growing rows that no earlier rule covers, and is pruned back to the
prefix that does best on other rows, the pruning rows. The result is an ordered list of
conditions, which becomes one Spark expression; the first rule that holds decides.

All labelled training rows take part. A step is one aggregate over their binned ratios,
a row per ratio and bin, so what reaches the driver is bounded by the bins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import log2
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.llm.common import BLANKS
from stockweave.llm.labelled import fold, held_out
from stockweave.session import written

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of the words

RULES = 10
CONDITIONS = 3
LEAST_HITS = 5  # rows of the class to find that a growing rule must hold
PRECISION = 0.9  # of a rule, on the pruning rows

STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
    "n_distinct", "n_one_char", "n_same_next", "n_upper", "n_digits", "n_marks",
)
BASE = STATISTICS[:5]


def _per(count: str, of: str) -> Column:
    return F.col(count) / F.greatest(F.col(of), F.lit(1))


# What conditions are about, from the counts.
RATIOS: dict[str, Callable[[], Column]] = {
    "symbols per word": lambda: _per("n_symbols", "n_words"),
    "marks per word": lambda: _per("n_marks", "n_words"),
    "upper case of characters": lambda: _per("n_upper", "word_chars"),
    "digits of characters": lambda: _per("n_digits", "word_chars"),
    "characters per word": lambda: _per("word_chars", "n_words"),
    "distinct of words": lambda: _per("n_distinct", "n_words"),
    "one-character of words": lambda: _per("n_one_char", "n_words"),
    "equal to the next of words": lambda: _per("n_same_next", "n_words"),
    "repeated of words": lambda: _per("n_repeat_words", "n_words"),
    "duplicate of lines": lambda: _per("n_dup_lines", "n_lines"),
    "words per line": lambda: _per("n_words", "n_lines"),
    "words": lambda: F.col("n_words").cast("double"),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also when it is used inside lambdas.

    A column of a select below would be put back into the lambda by the optimiser
    and computed for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def characters(text: Column, kind: str) -> Column:
    """How many characters of a regular expression's class a text holds."""
    return F.char_length(F.regexp_replace(text, f"[^{kind}]+", ""))


def repeated_words(words: Column, hashes: Column) -> Column:
    """Words in windows of ``WINDOW`` words that occur twice or more in the text.

    Windows are compared by hash first. Only texts in which two hashes are equal
    sort them, and neighbours with equal hashes are then compared by their words.
    """
    windows = F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, WINDOW)]),
    )

    def same(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (
            F.slice(words, a["i"] + 1, WINDOW) == F.slice(words, b["i"] + 1, WINDOW)
        )

    def places(by_hash: Column) -> Column:
        again = F.filter(
            by_hash,
            lambda x, j: F.coalesce(same(x, F.get(by_hash, j - 1)), F.lit(False))
            | F.coalesce(same(x, F.get(by_hash, j + 1)), F.lit(False)),
        )
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        new = F.transform(
            at, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW)))
        )
        return F.aggregate(new, F.lit(0), lambda a, x: a + x)

    def counted(g: Column) -> Column:
        by_hash = F.sort_array(
            F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        )
        return F.when(
            F.size(F.array_distinct(g)) < F.size(g), let(let(by_hash, places), covered)
        ).otherwise(0)

    return let(windows, counted)


def text_statistics(text: Column) -> Column:
    """A struct of ``STATISTICS``; a null text counts as an empty one."""
    text = F.coalesce(text, F.lit(""))
    blank = F.lit(BLANKS)

    def of(t: Column, words: Column, hashes: Column, lines: Column) -> Column:
        counts = (
            F.size(words),
            F.char_length(F.array_join(words, "")),
            characters(t, "#*$%&|<>"),
            F.size(lines) - F.size(F.array_distinct(lines)),
            repeated_words(words, hashes),
            F.size(lines),
            F.size(F.array_distinct(hashes)),
            F.size(F.filter(words, lambda x: F.char_length(x) == 1)),
            F.size(F.filter(hashes, lambda x, i: x == F.get(hashes, i + 1))),
            characters(t, r"\p{Lu}"),
            characters(t, "0-9"),
            characters(t, "!?"),
        )
        return F.struct(
            *[c.cast("long").alias(n) for n, c in zip(STATISTICS, counts, strict=True)]
        )

    def split(trimmed: Column) -> Column:
        # The trimmed text has no blanks at its ends, so no part of it is empty.
        return F.when(trimmed == "", F.lit(None)).otherwise(
            F.split(trimmed, r"[\x20\x09-\x0D]+")
        )

    words = F.coalesce(let(F.trim(text, blank), split), F.array().cast("array<string>"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, blank) != "")
    return let(
        words,
        lambda w: let(
            F.transform(w, lambda x: F.xxhash64(x)),
            lambda h: let(lines, lambda ls: of(text, w, h, ls)),
        ),
    )


def base_failed() -> Column:
    """Too few words, or too many in windows that occur again."""
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )


@dataclass(frozen=True)
class Condition:
    ratio: str
    above: bool
    cut: float

    def holds(self) -> Column:
        value = RATIOS[self.ratio]()
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.ratio} {'>' if self.above else '<='} {self.cut:.4g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction, and how many pruning rows of either class it holds."""

    conditions: tuple[Condition, ...]
    hits: int
    misses: int

    def holds(self) -> Column:
        return reduce(and_, [c.holds() for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]

    def first(self) -> Column:
        """Number of the first rule that holds, from 1; 0 if none does.

        An expression over ``STATISTICS``.
        """
        out = F.lit(0)
        for n, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(rule.holds(), n).otherwise(out)
        return out

    def kept(self) -> Column:
        return ~base_failed() & (self.first() == 0)


@dataclass(frozen=True)
class _Cut:
    """A condition over bins: the bin of ratio ``f`` is above ``bin``, or not."""

    f: int
    above: bool
    bin: int

    def holds(self) -> Column:
        at = F.get(F.col("bins"), F.lit(self.f))
        return at > self.bin if self.above else at <= self.bin


def _cuts(rows: DataFrame) -> list[list[float]]:
    """Thresholds of each ratio: percentiles of either class, with both ends."""
    at = [0.0, 0.005, 0.01, 0.02, 0.05, *[k / 10 for k in range(1, 10)],
          0.95, 0.98, 0.99, 0.995, 1.0]
    found = rows.groupBy("hit").agg(
        *[F.percentile_approx(F.get("ratios", F.lit(i)), at, 10_000).alias(f"r{i}")
          for i in range(len(RATIOS))]
    ).collect()  # a row per class
    return [sorted({v for r in found for v in r[f"r{i}"] or ()}) for i in range(len(RATIOS))]


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many thresholds lie below the value."""
    below = F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c < value)
    return F.size(below)


def _all(cuts: list[_Cut]) -> Column:
    return reduce(and_, [c.holds() for c in cuts], F.lit(True))


def _grown(rows: DataFrame, n_cuts: list[int], conditions: int, least: int) -> list[_Cut]:
    """The conjunction with the best gain, one condition after the other."""
    rule: list[_Cut] = []
    while len(rule) < conditions:
        bins = rows.where(_all(rule)).select("hit", F.posexplode("bins").alias("f", "bin"))
        counts = bins.groupBy("f", "bin").agg(
            F.count_if("hit").alias("p"), F.count_if(~F.col("hit")).alias("n")
        )
        table = {(r.f, r.bin): (r.p, r.n) for r in counts.collect()}
        step = _best(table, n_cuts, least)
        if step is None:
            break
        rule.append(step[0])
        if not step[1]:  # nothing of the other class is left
            break
    return rule


def _best(
    table: dict[tuple[int, int], tuple[int, int]], n_cuts: list[int], least: int
) -> tuple[_Cut, int] | None:
    """The condition with the most gain, and how many rows of the other class it holds.

    Where neighbouring cuts part the rows in the same way, the middle one is taken.
    """
    total_p = sum(p for (f, _), (p, _) in table.items() if f == 0)
    total_n = sum(n for (f, _), (_, n) in table.items() if f == 0)
    if total_p < least or not total_n:
        return None
    before = log2(total_p / (total_p + total_n))
    best: tuple[float, list[tuple[_Cut, int]]] = (0.0, [])
    for f, cuts in enumerate(n_cuts):
        p = n = 0
        sides: dict[bool, list[tuple[int, int]]] = {True: [], False: []}
        for b in range(cuts):
            more = table.get((f, b), (0, 0))
            p, n = p + more[0], n + more[1]
            sides[False].append((p, n))
            sides[True].append((total_p - p, total_n - n))
        for above, found in sides.items():
            for b, (hits, misses) in enumerate(found):
                if hits < least:
                    continue
                gain = hits * (log2(hits / (hits + misses)) - before)
                cut = (_Cut(f, above, b), misses)
                last = best[1][-1][0] if best[1] else None
                if gain > best[0] + 1e-9:
                    best = (gain, [cut])
                elif last and gain > best[0] - 1e-9 and last == _Cut(f, above, b - 1):
                    best[1].append(cut)
    return best[1][len(best[1]) // 2] if best[1] else None


def _pruned(rows: DataFrame, rule: list[_Cut]) -> tuple[list[_Cut], int, int]:
    """The prefix with the best (p - n) / (p + n) on the pruning rows, and p and n."""
    seen = rows.agg(
        *[F.count_if(_all(rule[: k + 1]) & F.col("hit")).alias(f"p{k}")
          for k in range(len(rule))],
        *[F.count_if(_all(rule[: k + 1]) & ~F.col("hit")).alias(f"n{k}")
          for k in range(len(rule))],
    ).first()
    worth = [
        (seen[f"p{k}"] - seen[f"n{k}"]) / max(1, seen[f"p{k}"] + seen[f"n{k}"])
        for k in range(len(rule))
    ]
    k = worth.index(max(worth))
    return rule[: k + 1], seen[f"p{k}"], seen[f"n{k}"]


def learn_rules(
    statistics: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    doc_id: str = "doc_id",
    rules: int = RULES,
    conditions: int = CONDITIONS,
    least_hits: int = LEAST_HITS,
    precision: float = PRECISION,
) -> DecisionList:
    """Rules that find texts labelled 0, from a table with ``doc_id`` and ``STATISTICS``.

    Held-out rows and rows that fail the base rule are left out. A third of the
    training ids prunes what the others grow. Learning ends when no condition gains
    anything or a pruned rule is below ``precision`` on the pruning rows.
    """
    known = (
        labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").alias("_v"))
        .where(F.col("_id").isNotNull() & F.col("_v").isNotNull() & ~held_out(F.col("_id")))
        .groupBy("_id")
        .agg((F.max("_v") == 0).alias("hit"))
    )
    rows = written(
        statistics.where(~base_failed())
        .join(known, F.col(f"`{doc_id}`") == F.col("_id"))
        .select(
            "hit",
            (fold(F.concat(F.lit("prune "), F.col("_id").cast("string"))) != 0).alias("grow"),
            F.array(*[r() for r in RATIOS.values()]).alias("ratios"),
        ),
        "labelled-ratios",
    )
    cuts = _cuts(rows)
    bins = F.array(*[_bin(F.get("ratios", F.lit(i)), cs) for i, cs in enumerate(cuts)])
    binned = written(rows.select("hit", "grow", bins.alias("bins")), "labelled-bins")
    n_cuts = [len(c) for c in cuts]
    names = list(RATIOS)
    taken: list[list[_Cut]] = []
    out: list[Rule] = []
    while len(out) < rules:
        left = binned.where(~reduce(or_, [_all(r) for r in taken], F.lit(False)))
        rule = _grown(left.where("grow"), n_cuts, conditions, least_hits)
        if not rule:
            break
        rule, hits, misses = _pruned(left.where("not grow"), rule)
        if not hits or hits < precision * (hits + misses):
            break
        taken.append(rule)
        named = tuple(Condition(names[c.f], c.above, cuts[c.f][c.bin]) for c in rule)
        out.append(Rule(named, hits, misses))
    return DecisionList(tuple(out))


def with_statistics(df: DataFrame, columns: list[Column], text: str = "text") -> DataFrame:
    """``columns`` of ``df`` and the ``STATISTICS`` of its texts, one pass, no shuffle."""
    counted = F.inline(F.array(text_statistics(F.col(f"`{text}`"))))
    return df.select(*columns, counted)


def quality_rules(
    df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **how
) -> DataFrame:
    """The statistics and the verdict of each document, a row per row of ``df``.

    Returns ``doc_id``, the ``STATISTICS``, ``base_failed``, ``kept``, ``rule`` (number
    of the learnt rule that drops the document, else 0) and ``held_out`` (the rules saw
    no label of it). Words are runs without blanks, lines are cut at ``\\n`` and count
    if they hold a word.

    A null or empty text has no words and fails the base rule. Repeated rows get equal
    rows; a null id has no label and counts as an empty text for ``held_out``. Several
    labels of an id count as the largest. Without labels there are no rules and the
    base rule decides alone. An empty table gives an empty table. Other columns of
    ``df`` are not read, whatever their names. See :func:`learn_rules` for ``how``.
    """
    counts = written(with_statistics(df, [F.col(f"`{doc_id}`")], text), "statistics")
    learnt = learn_rules(counts, labels, doc_id=doc_id, **how)
    return counts.select(
        F.col(f"`{doc_id}`"),
        *STATISTICS,
        base_failed().alias("base_failed"),
        learnt.kept().alias("kept"),
        learnt.first().alias("rule"),
        held_out(F.col(f"`{doc_id}`")).alias("held_out"),
    )


def keep_by_rules(
    df: DataFrame, learnt: DecisionList, text: str = "text"
) -> DataFrame:
    """The rows of ``df`` that a decision list keeps, with all their columns unchanged."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    kept = with_statistics(df, [row], text).where(learnt.kept())
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in df.columns])
