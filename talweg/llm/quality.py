"""Quality rules: a decision list learnt by sequential covering; DataFrame and SQL functions only.

Rules are grown and pruned from counts of labelled rows by Spark aggregates, and become one ordered
conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialise

WINDOW = 5


def base_stats(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` and the base counts of every row's whole text (null: as empty).

    Each array that several expressions read is a column of its own, so that it is made once per row. A word
    is in a repeated window if it lies in one of 5 words that is found twice or more in the text; windows are
    compared by 64-bit hash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*[F.col(c) for c in carry], text.alias("_t"))
    rows = rows.withColumn("_w", F.filter(F.split("_t", rf"[{SPACE}]+", -1), lambda w: w != ""))
    rows = rows.withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(rf"[^{SPACE}]")))
    rows = rows.select(
        *carry,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("_t", F.lit(r"[!?]")).cast("long").alias("n_marks"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    at = F.sequence(F.lit(0), F.size("_h") - WINDOW)
    window = F.transform(at, lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)]))
    rows = rows.withColumn("_win", F.when(F.size("_h") >= WINDOW, window)).drop("_h")
    twice = F.size("_win") > F.size(F.array_distinct("_win"))
    pairs = F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.withColumn("_s", F.when(twice, F.array_sort(pairs))).drop("_win")
    again = F.filter(
        "_s",
        lambda s, k: (F.get("_s", k - 1)["h"].eqNullSafe(s["h"]) & (k > 0)) | F.get("_s", k + 1)["h"].eqNullSafe(s["h"]),
    )
    rows = rows.withColumn("_r", F.array_sort(F.transform(again, lambda s: s["i"]))).drop("_s")
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("_r", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")))
    return rows.withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0)).cast("long")).drop("_r")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))




def features() -> dict[str, Column]:
    """What conditions are made of: names and expressions over the base counts."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": _share("word_chars", "n_words"),
        "symbols_per_word": _share("n_symbols", "n_words"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "upper_share": _share("n_upper", "word_chars"),
        "marks_per_word": _share("n_marks", "n_words"),
        "words_per_line": _share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Rules in order; the first whose conditions all hold rejects, and a row that none holds for is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def verdict(self) -> Column:
        out = F.lit(True)
        for rule in reversed(self.rules):
            out = F.when(_all(rule), F.lit(False)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) + "\nelse keep"


def _all(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


@dataclass(frozen=True)
class QualityConfig:
    """``least_precision`` and ``least_cover`` are what a pruned rule must reach on the rows it was not grown from."""

    thresholds: int = 24
    max_rules: int = 8
    max_conditions: int = 4
    least_precision: float = 0.9
    least_cover: int = 5


def learn(labelled: DataFrame, cfg: QualityConfig = QualityConfig()) -> DecisionList:
    """A decision list for ``bad`` (0 or 1) from base counts, doc_id and bad, by sequential covering.

    A third of the rows, by hash of the id, prunes; the others grow. A rule gains, one at a time, the condition
    of most information gain; it is cut after the condition that leaves it the best precision on the pruning
    rows, and ends the list if that is too low. Thresholds are quantiles of all labelled rows. Only counts by
    feature and threshold reach the driver.
    """
    names = list(features())
    cut = [i / (cfg.thresholds + 1) for i in range(1, cfg.thresholds + 1)]
    quantiles = labelled.agg(*[F.percentile_approx(c, cut, 10_000).alias(n) for n, c in features().items()]).first()
    steps = {n: sorted(set(quantiles[n] or [])) for n in names}
    out = DecisionList()
    if not any(steps.values()):
        return out

    def place(n: str) -> Column:  # thresholds below the value
        return F.aggregate(F.array(*[F.lit(t) for t in steps[n]]), F.lit(0), lambda s, t: s + F.when(features()[n] > t, 1).otherwise(0)) if steps[n] else F.lit(0)

    prune = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(3)) == 0
    rows = materialise(labelled.withColumn("_prune", F.coalesce(prune, F.lit(False))).withColumn("_places", F.array(*[place(n) for n in names])))
    while len(out.rules) < cfg.max_rules:
        left = rows.filter(out.verdict())
        rule: list[Condition] = []
        while len(rule) < cfg.max_conditions:
            part = left.filter(~F.col("_prune") & _all(rule)).select("bad", F.posexplode("_places").alias("f", "place"))
            counts = part.groupBy("f", "place").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
            best = _best(counts, names, steps)
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        sums = []
        for i in range(len(rule)):
            hit = _all(rule[: i + 1])
            sums += [F.sum(F.when(hit, F.col("bad")).otherwise(0)).alias(f"p{i}"), F.sum(F.when(hit, 1 - F.col("bad")).otherwise(0)).alias(f"n{i}")]
        seen = left.filter("_prune").agg(*sums).first()
        scored = [((seen[f"p{i}"] or 0), (seen[f"n{i}"] or 0)) for i in range(len(rule))]
        worth = [((p + 1) / (p + n + 2), p) for p, n in scored]
        at = max(range(len(rule)), key=lambda i: (worth[i][0], -i))
        p, n = scored[at]
        if p < cfg.least_cover or p < cfg.least_precision * (p + n):
            break
        out.rules.append(rule[: at + 1])
    return out


def _best(counts: list, names: list[str], steps: dict[str, list[float]]) -> Condition | None:
    by = {}
    for r in counts:
        by.setdefault(r["f"], {})[r["place"]] = (r["p"] or 0, r["n"] or 0)
    best, most = None, 1e-9
    for f, cells in sorted(by.items()):
        thresholds = steps[names[f]]
        total = [sum(c[k] for c in cells.values()) for k in (0, 1)]
        if not total[0] or not total[1]:
            continue
        before = log2(total[0] / (total[0] + total[1]))
        for j, t in enumerate(thresholds):
            low = [sum(c[k] for place, c in cells.items() if place <= j) for k in (0, 1)]
            for above, (p, n) in ((False, low), (True, (total[0] - low[0], total[1] - low[1]))):
                gain = p * (log2(p / (p + n)) - before) if p else 0.0
                if gain > most:
                    best, most = Condition(names[f], above, float(t)), gain
    return best


def labelled_stats(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts of the labelled documents with bad = 1 where quality is 0. A doubly labelled id counts as bad if either says so."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q")).filter("doc_id is not null and q in (0, 1)")
    return stats.join(known.groupBy("doc_id").agg((1 - F.min("q")).cast("long").alias("bad")), "doc_id")


def judge(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig()) -> tuple[DataFrame, DecisionList]:
    """Base counts, base_failed and kept of every document, and the list that was learnt from ``labels``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stats = materialise(base_stats(rows))
    rules = learn(labelled_stats(stats, labels), cfg)
    stats = stats.withColumn("base_failed", base_failed())
    return stats.withColumn("kept", ~F.col("base_failed") & rules.verdict()), rules
