"""Quality rules: text statistics and learned decision lists, as Spark expressions throughout.

``statistics`` measures every whole text with built-in functions. ``learn`` runs sequential covering on
labelled statistics: each rule grows by the threshold condition of the highest information gain, is pruned
on rows held out from growing, and is accepted while it is precise there; the rows it covers leave. The
result is an ordered list of threshold conjunctions over statistics that ``verdict`` emits as one chain of
conditional expressions.
"""

from __future__ import annotations

import math
import random
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh

MIN_WORDS, MAX_REPEAT = 50, 50
#: Rows that rules are learned from, at most: the labelled rows of the least hashes.
MAX_LABELLED = 12_000
#: ASCII white space as a SQL string.
_WS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "bar_rate", "shout_rate", "digit_rate", "words_per_line")


def statistics(df: DataFrame, text: str = "text", out: str = "__stats") -> DataFrame:
    """``df`` with one struct column ``out``: the base counts and the features rules are learned on.

    Words are runs of characters other than ASCII white space. Repeated windows are found by equality of
    64-bit hashes of three words within one text; only texts that have any are looked at again, sorted.
    Null text: no words. Texts of any length are measured whole, in one pass of the row's own task.
    """
    # The row travels as one column, so that no name of its columns can meet one used here.
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__t"))
    t = rows
    t = t.withColumn("__b", F.expr(f"trim(BOTH {_WS} FROM __t)"))
    t = t.withColumn("__w", F.expr(f"case when __b = '' then cast(array() as array<string>) else split(__b, '[{SPACE}]+') end".replace("\\", "\\\\")))
    t = t.withColumn("__l", F.expr(f"filter(split(__t, '\\n', -1), x -> ltrim({_WS}, x) <> '')"))
    # What is counted, and little else, so that each count reads a short string.
    t = t.withColumn("__k", F.regexp_replace("__t", rf"[^{SPACE}#*$%&|<>!0-9\p{{Lu}}]+", ""))
    t = t.withColumn("__n", F.size("__w"))
    t = t.withColumn("__h", F.expr("case when __n < 3 then cast(array() as array<bigint>) else transform(sequence(0, __n - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])) end"))
    t = t.withColumn("__u", F.size("__h") - F.size(F.array_distinct("__h")))
    t = t.withColumn("__s", F.expr("case when __u = 0 then null else sort_array(transform(__h, (h, i) -> struct(h as h, i as i))) end"))
    # Places of windows whose neighbour in hash order is equal, in text order; each covers three words, less
    # what the next one covers too.
    t = t.withColumn("__p", F.expr("sort_array(transform(filter(transform(__s, (s, k) -> struct(s.i as i, (k > 0 and s.h = __s[greatest(k - 1, 0)].h) or (k < size(__s) - 1 and s.h = __s[least(k + 1, size(__s) - 1)].h) as twice)), s -> s.twice), s -> s.i))"))
    t = t.withColumn("__r", F.expr("case when __u = 0 then 0 else aggregate(__p, struct(-3 as at, 0 as n), (a, i) -> struct(i as at, a.n + least(3, i - a.at) as n), a -> a.n) end"))
    count = lambda chars: F.length("__k") - F.length(F.translate("__k", chars, ""))
    per = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    t = t.withColumn("__c", F.length("__t") - count(" \t\n\x0b\x0c\r")).withColumn("__y", count("#*$%&|<>"))
    n, c, lines = F.col("__n"), F.col("__c"), F.size("__l")
    dup = lines - F.size(F.array_distinct("__l"))
    upper = F.length(F.translate("__k", " \t\n\x0b\x0c\r#*$%&|<>!0123456789", ""))
    one = lambda x: F.length("__k") - F.length(F.replace(F.col("__k"), F.lit(x), F.lit("")))
    stats = {
        "n_words": n.cast("long"), "word_chars": c.cast("long"), "n_symbols": F.col("__y").cast("long"), "n_dup_lines": dup.cast("long"), "n_repeat_words": F.col("__r").cast("long"),
        "mean_word": per(c, n), "symbol_rate": per(F.col("__y"), n), "dup_line_rate": per(dup, lines), "repeat_rate": per(F.col("__r"), n), "upper_rate": per(upper, c),
        "bar_rate": per(one("|"), n), "shout_rate": per(one("!"), n), "digit_rate": per(count("0123456789"), c), "words_per_line": per(n, lines),
    }
    # The generator keeps later filters above it: pushed below, they would repeat these expressions for each word.
    t = t.select("__row", F.explode(F.array(F.struct(*(v.alias(k) for k, v in stats.items())))).alias("__stats"))
    return t.select(*(F.col(f"__row.`{c}`").alias(c) for c in df.columns), F.col("__stats").alias(out))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT * stats["n_words"])


# -- learning ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self, stats: Column) -> Column:
        value = stats[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    keep: bool = False

    def covers(self, row: dict) -> bool:
        return all(c.holds(row) for c in self.conditions)

    def __str__(self) -> str:
        return f"{' and '.join(map(str, self.conditions))} -> {'keep' if self.keep else 'reject'}"


def _thresholds(v: list[float], most: int = 24) -> list[float]:
    """Midpoints between neighbouring quantiles of sorted values."""
    cut = sorted({v[min(len(v) - 1, i * len(v) // most)] for i in range(most + 1)})
    return [round((a + b) / 2, 6) for a, b in zip(cut, cut[1:])]


def _grow(bad: list[dict], good: list[dict], features: tuple[str, ...], depth: int) -> list[Condition]:
    found: list[Condition] = []
    while good and len(found) < depth:
        p, n = len(bad), len(good)
        base, best = math.log2(p / (p + n)), None
        for f in features:
            # Thresholds from the rows to be caught and from the rest alike, so that a rare kind shows.
            in_bad, in_good = sorted(r[f] for r in bad), sorted(r[f] for r in good)
            for t in sorted({*_thresholds(in_bad), *_thresholds(in_good)}):
                above_p, above_n = p - bisect_right(in_bad, t), n - bisect_right(in_good, t)
                for above, a, b in ((True, above_p, above_n), (False, p - above_p, n - above_n)):
                    if a:
                        gain = a * (math.log2(a / (a + b)) - base)
                        if best is None or gain > best[0]:
                            best = gain, Condition(f, above, t)
        if best is None or best[0] <= 1e-9:
            break
        found.append(best[1])
        bad, good = [r for r in bad if best[1].holds(r)], [r for r in good if best[1].holds(r)]
    return found


def _worth(conditions: list[Condition], bad: list[dict], good: list[dict]) -> float:
    p = sum(all(c.holds(r) for c in conditions) for r in bad)
    n = sum(all(c.holds(r) for c in conditions) for r in good)
    return (p - n) / (p + n) if p + n else -1.0


def learn(rows: list[dict], label: str = "bad", features: tuple[str, ...] = FEATURES, min_precision: float = 0.9, max_rules: int = 12, depth: int = 3, seed: int = 7) -> list[Rule]:
    """An ordered list of reject rules; what none covers is kept.

    ``rows`` have the features and a boolean ``label``. A third is held out to prune each rule and to judge
    it: a rule enters only if it is precise there, so clean rows stay. No or one label: no rules.
    """
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: [r[f] for f in features])
    rng.shuffle(rows)
    held, grow = rows[: len(rows) // 3], rows[len(rows) // 3 :]
    bad, good = [r for r in grow if r[label]], [r for r in grow if not r[label]]
    held_bad, held_good = [r for r in held if r[label]], [r for r in held if not r[label]]
    rules: list[Rule] = []
    while bad and good and len(rules) < max_rules:
        conditions = _grow(bad, good, features, depth)
        if not conditions:
            break
        if held_bad and held_good:
            cuts = [conditions[:k] for k in range(1, len(conditions) + 1)]
            conditions = max(cuts, key=lambda c: (round(_worth(c, held_bad, held_good), 9), -len(c)))
        rule = Rule(tuple(conditions))
        p, n = sum(map(rule.covers, held_bad + bad)), sum(map(rule.covers, held_good + good))
        hp, hn = sum(map(rule.covers, held_bad)), sum(map(rule.covers, held_good))
        if p < 3 or p < min_precision * (p + n) or hp + hn and hp < min_precision * (hp + hn):
            break
        rules.append(rule)
        bad, good = [r for r in bad if not rule.covers(r)], [r for r in good if not rule.covers(r)]
        held_bad, held_good = [r for r in held_bad if not rule.covers(r)], [r for r in held_good if not rule.covers(r)]
    return rules


def verdict(rules: list[Rule], stats: Column) -> Column:
    """True where the list keeps: the first rule that covers a row decides, and none means keep."""
    if not rules:
        return F.lit(True)
    out = None
    for r in rules:
        test = r.conditions[0].column(stats)
        for c in r.conditions[1:]:
            test = test & c.column(stats)
        out = F.when(test, F.lit(r.keep)) if out is None else out.when(test, F.lit(r.keep))
    return out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", quality: str = "quality", max_labelled: int = MAX_LABELLED, **how) -> list[Rule]:
    """Learn from at most ``max_labelled`` labelled documents that pass the base rules.

    The sample's ids are at most ``max_labelled`` longs, which is why they may be broadcast and why their
    statistics may come to the driver: of documents that share an id the one of the least statistics is taken. Null
    ids and labels, and labels without a document, are left out; no labels give no rules.
    """
    picked = labels.where(F.col(quality).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__i"), F.col(quality).alias("__q"))
    picked = picked.distinct().orderBy(F.xxhash64("__i"), "__i", "__q").limit(max_labelled)
    some = docs.select(F.col(f"`{id_col}`").alias("__i"), F.col(f"`{text}`").alias("__x")).join(F.broadcast(picked), "__i")
    rows = statistics(some, "__x").where(~base_failed(F.col("__stats")))
    rows = rows.groupBy("__i", "__q").agg(F.min(F.struct(*(F.col(f"__stats.{f}") for f in FEATURES))).alias("f")).select("f.*", (F.col("__q") == 0).alias("bad"))
    return learn([r.asDict() for r in rows.collect()], **how)


def judged(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` with ``__stats`` and the booleans ``__base_failed`` and ``__kept``.

    A name that ``docs`` has already gets an underscore more (``common.fresh``). Rows are judged one by one: repeated
    rows alike, null and empty texts rejected (no words), texts of any length whole, an empty table empty. Ids are not
    read.
    """
    stats, failed, kept = fresh(docs, "__stats", "__base_failed", "__kept")
    out = statistics(docs, text, stats).withColumn(failed, base_failed(F.col(stats)))
    return out.withColumn(kept, ~F.col(failed) & verdict(rules, F.col(stats)))


def kept_rows(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base rules and the list keep, columns as they are."""
    out = judged(docs, rules, text)
    return out.where(F.col(out.columns[-1])).select(*(F.col(f"`{c}`") for c in docs.columns))
