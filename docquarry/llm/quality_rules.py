"""Quality rules: decision lists learned by sequential covering, in DataFrame operations only.

Statistics of whole texts are array and string expressions of one row. Learning takes a
bounded sample of labelled rows, cuts each statistic at quantiles, and counts the rows in
every cell of cuts; only these counts, no more than the bound, reach the driver. There rules
are found one after another, for either label: a rule grows by the condition
`statistic <= cut` or `statistic > cut` with the best information gain on two thirds of the
sample, and is pruned from its end on the other third. Of the best rule to reject and the
best rule to keep the one that tells more there joins the list, if it is precise and wide
enough; rows it covers are taken out, and the next rule is sought among the rest. The list
becomes one ordered CASE expression: the first rule that covers a text gives its verdict. Texts
that none covers are kept, unless the sample's are bad as precisely as a rule must be.

Edge cases: a null or empty text has no words and fails the base rule; a very long text is
measured whole, in its own row; a row without label is not learned from; without labelled
rows of both kinds, or with fewer than some dozen, the list is empty and keeps what the base
rule keeps; repeated rows get equal verdicts; an empty table gives an empty result; columns of
the input that have a statistic's name are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import SEPARATORS, WORD, labelled_sample, materialize, table
from docquarry.llm.fingerprint import let

WINDOW = 5
#: Ratios that rules may use; each is made of the statistics of statistics().
RATIOS = {
    "mean_word": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "n_words"),
    "words_a_line": ("n_words", "n_lines"),
}
FEATURES = ("n_words", *RATIOS)


@dataclass(frozen=True)
class Params:
    bound: int = 20_000  # labelled rows to learn from, at most
    cuts: int = 31  # of each statistic
    rules: int = 16
    conditions: int = 4
    precision: float = 0.9  # part of the other label's share that a rule must leave out, on the rows that prune
    support: float = 0.002  # part of the rows that a rule must rightly cover, both to grow and to stay
    fewest: int = 3  # and the least number of them


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    keep: bool

    def __str__(self) -> str:
        return f"{'keep' if self.keep else 'reject'} if {' and '.join(map(str, self.conditions)) or 'any'}"


def repeated_words(words: Column) -> Column:
    """Words in runs of WINDOW words that the text has twice or more, the first included."""

    def runs(hashes: Column) -> Column:
        n = F.size(hashes) - (WINDOW - 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))).otherwise(F.array().cast("array<long>"))

    def covered(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda p: F.filter(p, lambda x, k: (x["h"] == F.get(p, k - 1)["h"]).eqNullSafe(F.lit(True)) | (x["h"] == F.get(p, k + 1)["h"]).eqNullSafe(F.lit(True))))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        steps = let(places, lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    count = lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0)).otherwise(covered(r))
    return let(let(F.transform(words, lambda w: F.xxhash64(w)), runs), count)


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the kept columns and the statistics of text, all long."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", *keep, text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SEPARATORS), ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    words, lines = F.col("words"), F.col("lines")
    found = {
        "n_words": F.size(words),
        "word_chars": F.char_length(F.array_join(words, "")),
        "n_symbols": F.regexp_count("text", F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(words),
        "n_lines": F.size(lines),
        "n_distinct": F.size(F.array_distinct(words)),
        "n_upper": F.regexp_count("text", F.lit(r"\p{Lu}")),
        "n_digits": F.regexp_count("text", F.lit("[0-9]")),
        "n_marks": F.regexp_count("text", F.lit("[!?]")),
    }
    return rows.select("doc_id", *keep, *[c.cast("long").alias(n) for n, c in found.items()])


def feature(name: str) -> Column:
    """A rule's statistic; a share of nothing is 0."""
    if name not in RATIOS:
        return F.col(name).cast("double")
    a, b = RATIOS[name]
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self, features: Column) -> Column:
        return features[self.feature] > self.cut if self.above else features[self.feature] <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


def learn(stats: DataFrame, p: Params = Params()) -> list[Rule]:
    """Rules from a written table of statistics with `label`, of at most p.bound rows."""
    levels = [k / (p.cuts + 1) for k in range(1, p.cuts + 1)]
    row = stats.select(*[F.percentile_approx(feature(n), levels, 10_000).alias(n) for n in FEATURES]).first()
    cuts = {n: sorted(set(row[n] or [])) for n in FEATURES}
    names = [f"bin_{n}" for n in FEATURES]  # not the statistics' own names, which later expressions of the same select would then mean
    bins = [_bin(feature(n), cuts[n]).alias(b) for n, b in zip(FEATURES, names, strict=True)]
    cells = stats.select(*bins, F.col("label"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prunes")).groupBy(*names, "label", "prunes").count()
    grow, prune = [], []
    for r in cells.collect():  # no more cells than sampled rows
        (prune if r["prunes"] else grow).append((tuple(r[n] for n in names), r["label"] == 0, r["count"]))
    found = cover(grow, prune, [len(cuts[n]) for n in FEATURES], p)
    return [Rule(tuple(Condition(FEATURES[f], above, cuts[FEATURES[f]][k]) for f, above, k in tests), keep) for tests, keep in found]


def _bin(x: Column, cuts: list[float]) -> Column:
    """How many cuts are less than x, so that `x <= cuts[k]` is `bin <= k`."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>"), lambda c: c < x))


Cell = tuple[tuple[int, ...], bool, int]
Test = tuple[int, bool, int]


def _holds(cell: Cell, tests: list[Test] | tuple[Test, ...]) -> bool:
    return all((cell[0][f] > k) == above for f, above, k in tests)


def _weigh(cells: list[Cell], bad: bool) -> tuple[int, int]:
    """Rows with that label, and the others."""
    hit = sum(n for _, b, n in cells if b == bad)
    return hit, sum(n for _, _, n in cells) - hit


def cover(grow: list[Cell], prune: list[Cell], sizes: list[int], p: Params) -> list[tuple[tuple[Test, ...], bool]]:
    """Sequential covering: rules as tests (feature, above, number of the cut), and whether they keep, in order."""
    rules: list[tuple[tuple[Test, ...], bool]] = []
    least = [max(p.fewest, math.ceil(p.support * sum(n for _, _, n in cells))) for cells in (grow, prune)]
    while len(rules) < p.rules:
        best = [(*_prune(prune, _grow(grow, sizes, not keep, least[0], p), not keep, least[1], p), keep) for keep in (False, True)]
        gain, tests, keep = max(best)
        if not gain > 0:
            break
        rules.append((tests, keep))
        grow, prune = [c for c in grow if not _holds(c, tests)], [c for c in prune if not _holds(c, tests)]
    rest = [_weigh(cells, True) for cells in (grow, prune)]
    if rules and all(bad >= n and bad >= p.precision * (bad + good) for (bad, good), n in zip(rest, least, strict=True)):
        return [*rules, ((), False)]  # what no rule covers is bad as well
    while rules and rules[-1][1]:
        rules.pop()  # the rest is kept anyway
    return rules


def _grow(cells: list[Cell], sizes: list[int], bad: bool, least: int, p: Params) -> tuple[Test, ...]:
    tests: list[Test] = []
    while len(tests) < p.conditions and (best := _best_test(cells, sizes, bad, least)):
        tests.append(best)
        cells = [c for c in cells if _holds(c, [best])]
    return tuple(tests)


def _prune(cells: list[Cell], tests: tuple[Test, ...], bad: bool, least: int, p: Params) -> tuple[float, tuple[Test, ...]]:
    """The most precise beginning of the tests, and how many bits it tells about the rows; 0 bits if none is precise and wide enough."""
    right, wrong = _weigh(cells, bad)
    best: tuple[float, float, tuple[Test, ...]] = (0.0, 0.0, ())
    for n in range(1, len(tests) + 1):
        hit, miss = _weigh([c for c in cells if _holds(c, tests[:n])], bad)
        if hit >= least and wrong and miss / (hit + miss) <= (1 - p.precision) * wrong / (right + wrong):
            gain = hit * (math.log2((hit + 1) / (hit + miss + 2)) - math.log2((right + 1) / (right + wrong + 2)))
            best = max(best, (hit / (hit + miss), gain, tests[:n]), key=lambda x: x[:2])
    return best[1:]


def _best_test(cells: list[Cell], sizes: list[int], bad: bool, least: int) -> Test | None:
    """The test with the largest information gain over the cells, or none that gains."""
    right, wrong = _weigh(cells, bad)
    if not right or not wrong:
        return None
    base, best, found = math.log2(right / (right + wrong)), 0.0, None
    for f, size in enumerate(sizes):
        sums: dict[int, list[int]] = defaultdict(lambda: [0, 0])
        for at, b, n in cells:
            sums[at[f]][b != bad] += n
        g = w = 0
        for k in range(size):
            g, w = g + sums[k][0], w + sums[k][1]
            for above, (x, y) in ((False, (g, w)), (True, (right - g, wrong - w))):
                if x >= least and (gain := x * (math.log2(x / (x + y)) - base)) > best + 1e-9:
                    best, found = gain, (f, above, k)
    return found


def verdict(rules: list[Rule]) -> Column:
    """What the first rule that covers the row says; true where none does.

    The ordered CASE reads a struct of the features it needs, made once for each row.
    """
    names = sorted({c.feature for rule in rules for c in rule.conditions})

    def decide(features: Column) -> Column:
        out = F
        for rule in rules:
            held = reduce(Column.__and__, [c.column(features) for c in rule.conditions], F.lit(True))
            out = out.when(held, F.lit(rule.keep))
        return out.otherwise(F.lit(True))

    return let(F.struct(*[feature(n).alias(n) for n in names]), decide) if rules else F.lit(True)


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> list[Rule]:
    return learn(materialize(statistics(labelled_sample(docs, labels, "quality", p.bound), "label")), p)


def apply(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the base statistics, whether the base rule fails, and the verdict."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return statistics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


def query(spark: SparkSession, sf_dir: str, p: Params = Params()) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply(docs, fit(docs, table(spark, sf_dir, "labels"), p))
