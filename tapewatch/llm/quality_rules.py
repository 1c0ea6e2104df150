"""Quality rules: text statistics and a learned decision list, in DataFrame functions only.

A rule is a conjunction of thresholds on ratios of the statistics, and what it says of a row that meets
it: drop or keep. A list of rules is one ordered ``CASE WHEN``, in which the first rule met decides. Rules
come from labelled rows by sequential covering: a rule is grown by the threshold with the best gain on two
thirds of the rows that no rule covers yet, then pruned on the other third. Rules that drop come first;
where none is sure enough, one that keeps takes its rows out of the way, and those that drop are tried again.
Each step is one aggregation over the labelled rows, whose result is a fixed number of counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import staged

SYMBOLS = "#*$%&|<>"
WINDOW = 5
TAILS = (0.0001, 0.001, 0.01)
#: What rules may test, as SQL over the statistics.
MEASURES = {
    "n_words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_per_word": "n_dup_lines / greatest(n_words, 1)",
    "dup_lines": "cast(n_dup_lines as double)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of five words found twice or more in the text.

    Windows are sorted by their hash; a window is repeated if a neighbour in that order is equal. The
    starts of repeated windows, in text order, cover five words each, less where they overlap.
    """
    starts = F.sequence(F.lit(1), F.size(words) - WINDOW + 1)
    windows = F.transform(starts, lambda i: F.xxhash64(*(F.element_at(words, i + F.lit(k)) for k in range(WINDOW))))

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(_bound(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h))))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once in the row, not once for each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _covered(hashes: Column) -> Column:
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(found: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            before = (i > 0) & (F.get(found, i - 1)["h"] == x["h"])
            return before | F.coalesce(F.get(found, i + 1)["h"] == x["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(found, again), lambda x: x["i"]))

    def total(hits: Column) -> Column:
        step = F.transform(hits, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(hits, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda t, x: t + x)

    return _bound(_bound(pairs, starts), total)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of each whole text.

    Words are runs without ASCII white space. A null or empty text has zeros. Every row stays, with
    null and repeated ids too; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    one = docs.select(F.col(id_col).alias("id"), _bound(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda t, x: t + F.length(x)).alias("word_chars"),
        _repeat_words(w).alias("n_repeat_words"),
    )).alias("w"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _bound(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    return one.select("id", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    measure: str
    above: bool
    value: float

    def column(self) -> Column:
        x = F.expr(MEASURES[self.measure])
        return x > self.value if self.above else x <= self.value

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.value:g}"


@dataclass(frozen=True)
class Rule:
    """What meets all ``tests`` is kept or dropped."""

    tests: tuple[Test, ...]
    keep: bool

    def __str__(self) -> str:
        return f"{' and '.join(map(str, self.tests))}: {'keep' if self.keep else 'drop'}"


def _all(tests: tuple[Test, ...]) -> Column:
    met = F.lit(True)
    for test in tests:
        met = met & test.column()
    return met


def verdict(rules: list[Rule]) -> Column:
    """What the first rule of the list that a row meets says of it; True where it meets none."""
    said = F.when(F.lit(False), F.lit(True))
    for rule in rules:
        said = said.when(_all(rule.tests), F.lit(rule.keep))
    return said.otherwise(F.lit(True))


def _covered_by(rules: list[Rule]) -> Column:
    met = F.lit(False)
    for rule in rules:
        met = met | _all(rule.tests)
    return met


def _thresholds(labelled: DataFrame, steps: int) -> dict[str, list[float]]:
    """Quantiles of each measure over all rows and over label 0, those of both tails too, and the middles between them."""
    at = sorted({*(k / steps for k in range(1, steps)), *TAILS, *(1 - t for t in TAILS)})
    asked = []
    for m, sql in MEASURES.items():
        asked += [F.percentile_approx(F.expr(sql), at, 10_000).alias(m), F.percentile_approx(F.when(~F.col("good"), F.expr(sql)), at, 10_000).alias(f"{m}_0")]
    row = labelled.agg(*asked).first()
    found = {}
    for m in MEASURES:
        raw = sorted({*(row[m] or ()), *(row[f"{m}_0"] or ())})
        found[m] = sorted({*raw, *((a + b) / 2 for a, b in zip(raw, raw[1:], strict=False))})
    return found


def _histogram(rows: DataFrame, values: dict[str, list[float]]) -> dict[Test | None, tuple[int, int]]:
    """(bad, good) rows that meet each test, and under None of all rows: one small aggregation."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.expr(MEASURES[m]).alias("x"), F.array(*map(F.lit, vs)).alias("vs")) for m, vs in values.items())))
    place = F.size(F.filter(F.col("t.vs"), lambda v: F.col("t.x") > v))
    cells = rows.select("good", each.alias("t")).groupBy(F.col("t.m").alias("m"), place.alias("place"))
    seen = {(r["m"], r["place"]): (r["bad"], r["good"]) for r in cells.agg(F.count_if(~F.col("good")).alias("bad"), F.count_if("good").alias("good")).collect()}
    out: dict[Test | None, tuple[int, int]] = {None: (0, 0)}
    for m, vs in values.items():
        cell = [seen.get((m, k), (0, 0)) for k in range(len(vs) + 1)]
        total = tuple(map(sum, zip(*cell, strict=True)))
        out[None], under = total, (0, 0)
        for k, v in enumerate(vs):
            under = (under[0] + cell[k][0], under[1] + cell[k][1])
            out[Test(m, True, v)] = (total[0] - under[0], total[1] - under[1])
            out[Test(m, False, v)] = under
    return out


def _counts(rows: DataFrame, tests: list[Column]) -> list[tuple[int, int]]:
    """(bad, good) rows that meet each test: one aggregation."""
    asked = []
    for k, test in enumerate(tests):
        asked += [F.count_if(test & ~F.col("good")).alias(f"b{k}"), F.count_if(test & F.col("good")).alias(f"g{k}")]
    row = rows.agg(*asked).first()
    return [(row[f"b{k}"], row[f"g{k}"]) for k in range(len(tests))]


def _precision(bad: int, good: int) -> float:
    return (bad + 1) / (bad + good + 2)


def _grown(left: DataFrame, values: dict, keep: bool, most_tests: int, least_cover: int, aside: set[Test]) -> tuple[Test, ...]:
    """The tests of a rule for one label, best gain first; ``aside`` holds first tests that failed before."""
    tests: tuple[Test, ...] = ()
    while len(tests) < most_tests:
        seen = {t: (c[::-1] if keep else c) for t, c in _histogram(left.where(_all(tests)), values).items()}
        now = seen.pop(None)
        if not now[0] or not now[1]:
            break

        def gain(test, now=now, seen=seen):
            c = seen[test]
            return c[0] * (math.log2(_precision(*c)) - math.log2(_precision(*now))) if c[0] >= least_cover else 0.0

        gains = {t: gain(t) for t in seen if tests or t not in aside}
        best = max(gains.values(), default=0)
        if best <= 0:
            break
        # of thresholds that part the rows alike, the one in the middle of them
        alike = [t for t in gains if gains[t] == best]
        alike = [t for t in alike if (t.measure, t.above) == (alike[0].measure, alike[0].above)]
        tests = (*tests, alike[len(alike) // 2])
    return tests


def learn_rules(statistics_: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", steps: int = 16,
                most_tests: int = 3, least_precision: float = 0.95, least_cover: int = 5, tries: int = 3) -> list[Rule]:
    """An ordered list of rules from all rows that have a label and pass the base rules.

    ``steps`` quantiles of each measure and those of both tails are tried as thresholds. A rule stays if, on rows it was
    not grown on, it meets ``least_cover`` rows of its label at least and ``least_precision`` of what it meets has that label;
    a rule that keeps may meet a tenth of the share of bad rows at most. ``tries`` first tests are tried for a label before
    it is given up. The list ends when no rule stays. Without labels of both kinds it is empty. Rows with null ids or
    labels are left out.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) == 1).alias("good"))
    labelled = staged(statistics_.where(~base_failed()).join(known, "id").withColumn("grow", F.pmod(F.xxhash64("id"), F.lit(3)) < 2), "labelled")
    grow, prune = labelled.where("grow"), labelled.where("not grow")
    values = _thresholds(labelled, steps)
    bad, good = _counts(labelled, [F.lit(True)])[0]
    if not bad or not good or not any(values.values()):
        return []
    sure = {False: least_precision, True: max(least_precision, 1 - 0.1 * bad / (bad + good))}
    rules: list[Rule] = []

    def next_rule(keep: bool) -> Rule | None:
        aside: set[Test] = set()
        open_ = ~_covered_by(rules)
        for _ in range(tries):
            tests = _grown(grow.where(open_), values, keep, most_tests, least_cover, aside)
            if not tests:
                return None
            shorter = [tests[:k] for k in range(1, len(tests) + 1)]
            held = [c[::-1] if keep else c for c in _counts(prune.where(open_), [_all(t) for t in shorter])]
            worth = [(own - other) / max(1, own + other) for own, other in held]
            at = max(range(len(shorter)), key=lambda k: (worth[k], -k))
            own, other = held[at]
            if own >= least_cover and own >= sure[keep] * (own + other):
                return Rule(shorter[at], keep)
            aside.add(tests[0])
        return None

    while (found := next_rule(False) or next_rule(True)) is not None:
        rules.append(found)
    while rules and rules[-1].keep:  # rows that meet no rule are kept anyway
        rules.pop()
    return rules


def apply_rules(statistics_: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``base_failed`` and ``kept``: false where a base rule or the learned list says so."""
    return statistics_.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
