"""Operator 9, quality rules: a short-circuit cascade, built from SQL functions only.

Every rule says why a document goes. Rules differ in cost and in how much they reject, so their cost (seconds of a job
over a bounded sample, less those of a job without the rule) and selectivity (share of the sample rejected) are measured first, and the cascade is one CASE
expression with the rules in falling order of rejection per cost: what an early rule rejects never reaches a later one.
The order changes the speed only; the verdict is whether any rule rejects.

Defined results: a null text is an empty one and has no words; repeated rows are judged one by one and all returned;
an empty table gives no rows; other columns are carried along; nothing needs a shuffle.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_RUN, words_of, written

SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, WS_RUN, "")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(words: Column, size: int = 5) -> Column:
    """Words covered by windows of `size` words that are found twice or more in the text.

    Windows are held as 64-bit hashes. Only texts whose hashes are not all distinct are sorted, by (hash, place).
    """
    n = F.size(words)
    hashes = F.when(n > size, F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size)))).otherwise(F.array().cast("array<bigint>"))

    def covered(by_hash: Column) -> Column:
        twice = F.filter(by_hash, lambda x, i: F.coalesce(F.get(by_hash, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(by_hash, i + 1)["h"] == x["h"], F.lit(False)))
        places = F.array_sort(F.transform(twice, lambda x: x["p"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + (p + size - F.greatest(p, a["end"]))).cast("long").alias("n"), (p + size).alias("end")), lambda a: a["n"])

    def counted(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(by_hash, covered))

    return let(hashes, counted)


@dataclass(frozen=True)
class Rule:
    """rejects(text, words): true for a text that must go; text is not null."""

    name: str
    rejects: Callable[[Column, Column], Column]


def _n(words: Column) -> Column:
    return F.size(words)


TOO_SHORT = Rule("too_short", lambda t, w: _n(w) < 10)
REPEATS = Rule("repeated_windows", lambda t, w: 100 * n_repeat_words(w) > 20 * _n(w))
#: What the base rules leave to this library: thresholds on ratios, wide enough for lists, quotations and short texts.
OWN_RULES = (
    Rule("symbols", lambda t, w: n_symbols(t) > 0.2 * _n(w)),
    Rule("word_length", lambda t, w: (word_chars(t) < 2 * _n(w)) | (word_chars(t) > 25 * _n(w))),
    Rule("shouting", lambda t, w: (_n(w) >= 20) & (2 * F.length(F.regexp_replace(t, "[^\\p{Lu}]+", "")) > F.length(F.regexp_replace(t, "[^\\p{L}]+", "")))),
    Rule("stutter", lambda t, w: 5 * F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False)))) > _n(w)),
    Rule("duplicate_lines", lambda t, w: (n_dup_lines(t) >= 3) & (2 * n_dup_lines(t) > F.size(F.split(t, "\n")))),
)
BASE_RULES = (TOO_SHORT, REPEATS)


def _with_words(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with __text and __words, the words in a column of their own.

    Filters and projections on top must not take the expression of the words into their lambdas, which would split the
    text once for each word. Catalyst never does that to an expression that depends on a row's place, so the words
    depend on a condition on it, which always holds.
    """
    text = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    return text.withColumn("__words", F.when(F.monotonically_increasing_id() >= 0, words_of(F.col("__text"))))


def order_rules(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = 1000) -> list[Rule]:
    """rules in falling order of rejection per cost, as measured over at most sample_rows rows of docs.

    A rule's cost is the quicker of two runs over the sample after a first one, which compiles it, less that of a rule that
    looks at the words only; what is below a hundredth of a second counts as that.
    """
    sample = written(docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).limit(sample_rows))
    base = _with_words(sample, "text")

    def measured(rejects: Column) -> tuple[float, float]:
        share, took = 0.0, []
        for _ in range(3):
            began = time.perf_counter()
            share = base.agg(F.avg(F.coalesce(rejects, F.lit(False)).cast("int")).alias("r"), F.sum(F.size("__words")).alias("n")).first()["r"] or 0.0
            took.append(time.perf_counter() - began)
        return share, min(took[1:])

    floor = measured(F.size("__words") < 0)[1]
    rated = []
    for rule in rules:
        share, took = measured(rule.rejects(F.col("__text"), F.col("__words")))
        rated.append((share / max(0.01, took - floor), rule.name, rule))
    return [rule for _, _, rule in sorted(rated, key=lambda x: (-x[0], x[1]))]


def cascade(rules: list[Rule], text: Column, words: Column) -> Column:
    """The name of the first rule that rejects, or null: one CASE, so later rules are not evaluated."""
    out = None
    for rule in rules:
        hit = rule.rejects(text, words)
        out = F.when(hit, F.lit(rule.name)) if out is None else out.when(hit, F.lit(rule.name))
    return out


def quality_filter(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + OWN_RULES, sample_rows: int = 1000) -> DataFrame:
    """The rows of docs that no rule rejects, unchanged, all columns."""
    ordered = order_rules(docs, rules, text_col, sample_rows)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # The words are bound once: the filter is pushed down to the scan, where a column of words would be computed anew in each lambda.
    return docs.where(let(words_of(text), lambda words: cascade(ordered, text, words)).isNull())


def quality_measures(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: tuple[Rule, ...] = OWN_RULES, sample_rows: int = 1000) -> DataFrame:
    """id_col, the base measures, base_failed, kept and the rule that rejected (null if kept or if the base rules failed)."""
    ordered = order_rules(docs, rules, text_col, sample_rows)
    text, words = F.col("__text"), F.col("__words")
    base = _with_words(docs.select(F.col(id_col), F.col(text_col)), text_col).select(
        F.col(id_col), text, words, F.size(words).cast("long").alias("n_words"), word_chars(text).alias("word_chars"), n_symbols(text).alias("n_symbols"), n_dup_lines(text).alias("n_dup_lines"), n_repeat_words(words).alias("n_repeat_words"))
    failed = base.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    told = failed.withColumn("rule", F.when(~F.col("base_failed"), cascade(ordered, text, words)))
    return told.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
