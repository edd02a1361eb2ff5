"""Quality rules: a decision list learned by sequential covering, by DataFrame functions alone.

Statistics of each whole text are computed natively and written once. On the labelled rows each statistic is cut into bins
at quantiles; every step of the learner is one small aggregate over the bins. A rule is a conjunction of thresholds that
tells low quality: it grows by the threshold that gains most (as FOIL measures it) on the growing part of the labelled
rows, is pruned to the prefix that does best on the other part, and stays if it is precise enough; the rows it covers are
then taken away and the next rule is sought. The rules become one ordered conditional expression, whose last branch keeps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import materialise

#: Labelled rows that rules are learned from at most, chosen by a hash of the id.
SAMPLE = 200_000
#: Files and tasks that the labelled rows are dealt to, 25,000 rows each at most: every pass of the learner reads them again, and as
#: many files as the join has partitions would each start processes of their own on the executors (Hadoop sets modes of files by one).
SAMPLE_PARTS = 8
RULES, LITERALS = 10, 3
QUANTILES = (0.002, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.94, 0.97, 0.99, 0.998)
PRECISION = 0.9
SUPPORT = 4

_SPACE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
#: Characters that are counted by taking all others away, which leaves one string a text and not one a character.
_COUNTED = {
    "n_space": r"\x20\x09-\x0D", "n_symbols": "#*$%&|<>", "capitals": "A-Z", "exclaims": "!", "bars": "|", "digits": "0-9", "stops": ".,;:?",
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = (
    "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "word_length", "capital_rate", "exclaim_rate", "bar_rate",
    "digit_rate", "stop_rate", "line_words", "word_count",
)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, BASE and RATES of each document.

    Words are runs of characters other than space, tab and line ends; a null text has none, and all its numbers are 0.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(
        "doc_id",
        F.filter(F.split(text, _SPACE + "+"), lambda w: w != "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(_WORD))).alias("lines"),
        F.length(text).alias("size"),
        *[F.length(F.regexp_replace(text, f"[^{c}]+", "")).cast("long").alias(n) for n, c in _COUNTED.items()],
    )
    n = F.size("w").cast("long")
    grams = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    out = out.select(
        "doc_id", n.alias("n_words"), (F.col("size") - F.col("n_space")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("w")).alias("n_distinct"), "size", "capitals", "exclaims", "bars", "digits", "stops", grams.alias("grams"),
    )
    # only texts in which some window repeats have their windows sorted
    again = F.size(F.array_distinct("grams")) < F.size("grams")
    sorted_grams = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    out = out.withColumn("s", F.when(again, sorted_grams)).drop("grams")
    twice = F.filter("s", lambda x, j: (F.get("s", j - 1)["g"] == x["g"]) | (F.get("s", j + 1)["g"] == x["g"]))
    out = out.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("s")
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + (i + 3 - F.greatest(a["end"], i))).cast("long").alias("n"), (i + 3).alias("end")),
        lambda a: a["n"],
    )
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")
    per = lambda c, of: F.col(c) / F.greatest(F.col(of), F.lit(1))
    return out.select(
        "doc_id", *BASE,
        per("n_symbols", "n_words").alias("symbol_rate"), per("n_dup_lines", "n_lines").alias("dup_line_rate"), per("n_repeat_words", "n_words").alias("repeat_rate"),
        per("n_distinct", "n_words").alias("distinct_rate"), per("word_chars", "n_words").alias("word_length"), per("capitals", "size").alias("capital_rate"),
        per("exclaims", "n_words").alias("exclaim_rate"), per("bars", "n_words").alias("bar_rate"), per("digits", "size").alias("digit_rate"),
        per("stops", "n_words").alias("stop_rate"), per("n_words", "n_lines").alias("line_words"), F.col("n_words").cast("double").alias("word_count"),
    )


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Literal, ...]


def _all(rule: Rule) -> Column:
    out = F.lit(True)
    for x in rule:
        out = out & x.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The decision list as a conditional expression: false where a rule covers the row, else true."""
    if not rules:
        return F.lit(True)
    out = F.when(_all(rules[0]), False)
    for r in rules[1:]:
        out = out.when(_all(r), False)
    return out.otherwise(True)


def _best(rows: DataFrame, thresholds: dict[str, list[float]], rule: Rule) -> tuple[Literal | None, int, int]:
    """The literal with the most gain over the growing rows that ``rule`` covers, and how many of either class it leaves."""
    names = list(thresholds)
    grouped = rows.filter(F.col("grow") & _all(rule)).select("low", F.posexplode(F.array(*[F.col(f"{f}_bin") for f in names])).alias("f", "bin"))
    counts = grouped.groupBy("f", "bin").agg(F.sum("low").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    best: tuple[float, Literal | None, int, int] = (1e-9, None, 0, 0)
    for f, name in enumerate(names):
        own = {r.bin: (int(r.p), int(r.n) - int(r.p)) for r in counts if r.f == f}
        p0, n0 = sum(x[0] for x in own.values()), sum(x[1] for x in own.values())
        if not p0 or not n0:
            continue
        before = math.log2(p0 / (p0 + n0))
        p = n = 0
        for k, t in enumerate(thresholds[name]):
            p, n = p + own.get(k, (0, 0))[0], n + own.get(k, (0, 0))[1]
            for above, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                if a and (a, b) != (p0, n0) and (gain := a * (math.log2(a / (a + b)) - before)) > best[0]:
                    best = (gain, Literal(name, above, t), a, b)
    return best[1:]


def learn(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from the rows of ``stats`` that ``labels`` (doc_id, quality) has; null ids and labels are left out, an id
    labelled twice counts once with its largest label. No rows, or one class only, give no rules."""
    ids = labels.select("doc_id", F.col("quality").cast("int").alias("q")).dropna().groupBy("doc_id").agg(F.max("q").alias("q"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = stats.filter(~base_failed()).join(ids, "doc_id").select(*RATES, (F.col("q") <= 0).cast("long").alias("low"), (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) > 0).alias("grow"))
    rows = materialise(rows.repartition(SAMPLE_PARTS), "labelled")
    cuts = [F.percentile_approx(F.when(F.col("low") == c, F.col(f)), list(QUANTILES), 2000).alias(f"{f}_{c}") for f in RATES for c in (0, 1)]
    found = rows.agg(*cuts).first()
    thresholds = {f: sorted({float(x) for c in (0, 1) for x in found[f"{f}_{c}"] or []}) for f in RATES}
    if not any(thresholds.values()):
        return []
    def bin_of(f: str) -> Column:
        cuts = F.array(*map(F.lit, thresholds[f])) if thresholds[f] else F.array().cast("array<double>")
        return F.size(F.filter(cuts, lambda x: x < F.col(f))).alias(f"{f}_bin")

    bins = [bin_of(f) for f in thresholds]
    rows = materialise(rows.select("*", *bins), "binned")
    rules: list[Rule] = []
    while len(rules) < RULES:
        left = rows.filter(verdict(rules))
        rule: Rule = ()
        while len(rule) < LITERALS:
            literal, p, n = _best(left, thresholds, rule)
            if literal is None:
                break
            rule += (literal,)
            if not n:
                break
        if not rule:
            break
        # pruned on the rows held back; a prefix is judged with the growing rows where those are few
        prefixes = [rule[: k + 1] for k in range(len(rule))]
        sums = [F.sum(F.when(_all(r) & (F.col("grow") == g), c)).alias(f"{k}_{g}_{n}") for k, r in enumerate(prefixes) for g in (True, False) for n, c in (("p", F.col("low")), ("n", 1 - F.col("low")))]
        got = left.agg(*sums).first()
        at = lambda k, g, n: int(got[f"{k}_{g}_{n}"] or 0)
        worth = [(at(k, False, "p") - at(k, False, "n")) / max(1, at(k, False, "p") + at(k, False, "n")) for k in range(len(prefixes))]
        k = max(range(len(prefixes)), key=lambda k: (round(worth[k], 9), -k))
        p, n = (at(k, True, c) + at(k, False, c) for c in "pn")
        if p < SUPPORT or p < PRECISION * (p + n):
            break
        rules.append(prefixes[k])
    return rules


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, BASE, base_failed, kept of each document."""
    stats = materialise(statistics(docs), "statistics")
    rules = learn(stats, labels)
    return stats.select("doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
