"""Operator 6, mixing sources to target weights by entropy balancing.

A document of source s with c words is taken at a rate r between 0 and `most`. Among all rates whose expected words per
source equal the targets, those nearest to one each are taken, by the entropy of a bounded rate. The optimum is an
exponential tilt, r = most * q / (1 + q) with q = exp(lambda_s * x) / (most - 1) and x = c / (mean words of s), so a tilt
of zero is a rate of one; lambda is found by Newton's iterations on the convex dual, one unknown for each source. They
run over a table of (source, size, documents), which is what the rates depend on: each iteration is one
aggregation per source of the dual's gradient and curvature, and steps that leave the bracket fall back on its
middle. Rates become copies by error diffusion over that table from long to short documents, so that a source's words
miss its target by about half its shortest document; within one (source, size) the copies that do not divide evenly go
to the documents first in the order of a hash.

Targets: sources in order of code points, null last, weigh 1, 2, 3, 1, ... and share all words; a target stops at `most`
times its source's words, and the excess is shared out by weight until none is above.

Defined results: a null text has no words; documents without words are taken once and count nothing; rows that share an
id are one document each; a source whose target equals `most` times its words takes every document `most` times; an
empty table gives no rows; a dual that does not converge raises. The same rows give the same result in any order and
partitioning. mix_table ignores other columns and repeated carries them along, whatever their names; sized and mix, which add columns that
begin with two underscores, refuse such.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words_of, written

WEIGHTS = (1.0, 2.0, 3.0)


def sized(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with __size, the text's words, and __hash, which decides which documents of a size get a copy more."""
    if taken := [c for c in docs.columns if c.startswith("__")]:
        raise ValueError(f"names that begin with __ are taken: {taken}")
    return docs.withColumns({"__size": F.size(words_of(F.col(text_col))).cast("long"), "__hash": F.xxhash64(F.col(id_col), F.col(text_col))})


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """sources: (k, source, source_size, docs) -> with target. One row for each source; numbering them needs one order.

    Sharing the excess again and again caps sources in rising order of capacity by weight, so running sums in that
    order tell how far it goes, without rounds.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    told = sources.withColumn("w", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    capped = told.withColumn("level", level).withColumn("capped", F.col("level") * F.col("w") >= F.col("cap"))
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)
    return capped.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(final * F.col("w")).cast("double")).select("k", "source_size", "docs", "target")


def _rate(lam: Column, x: Column, most: float) -> Column:
    z = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), lam * x))
    return F.lit(most) / (1 + F.lit(most - 1) * F.exp(-z))


def balance(groups: DataFrame, most: float, rounds: int = 60, near: float = 1e-9) -> DataFrame:
    """groups: (k, size, n, source_size, target, mean), k a source's key -> (k, lam), by Newton's iterations on the dual."""
    inner = groups.select("k", "size", "n", (F.col("size") / F.col("mean")).alias("x"))
    state = groups.groupBy("k").agg(F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    state = written(state.withColumns({"lam": F.lit(0.0), "low": F.lit(-1e6), "high": F.lit(1e6), "done": F.col("target") >= most * F.col("source_size")}))
    for _ in range(rounds):
        r = _rate(F.col("lam"), F.col("x"), most)
        words = F.col("n") * F.col("size") * r
        sums = inner.join(state.where("not done").select("k", "lam"), "k").groupBy("k").agg(F.sum(words).alias("g"), F.sum(words * F.col("x") * (1 - r / most)).alias("h"))
        gap = F.col("g") - F.col("target")
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - F.try_divide(gap, F.col("h"))
        good = newton.isNotNull() & (newton > low) & (newton < high) & (F.abs(newton - F.col("lam")) <= 8)
        safe = F.when(good, newton).when((low <= -1e6) | (high >= 1e6), F.col("lam") - 8 * F.signum(gap)).otherwise((low + high) / 2)
        done = F.col("done") | F.col("g").isNull() | (F.abs(gap) <= near * F.col("target"))
        step = state.join(sums, "k", "left")
        state = written(step.select("k", "target", "source_size", F.when(done, F.col("lam")).otherwise(safe).alias("lam"), low.alias("low"), high.alias("high"), done.alias("done")))
        if not state.where("not done").limit(1).count():
            break
    else:
        raise RuntimeError(f"the dual has not converged after {rounds} rounds")
    return state.select("k", "lam")


def diffuse(t: pa.Table, most: int) -> pa.Table:
    """Copies of each size of one source: the words that rounding leaves over are carried to the next shorter size."""
    size, n, rate = (t[c].to_numpy() for c in ("size", "n", "rate"))
    copies, carry = np.zeros(len(size), np.int64), 0.0
    for i in np.argsort(-size, kind="stable").tolist():
        want = n[i] * rate[i] * size[i] + carry
        copies[i] = min(most * int(n[i]), max(0, round(want / size[i])))
        carry = want - float(copies[i]) * float(size[i])
    return pa.table({"k": t["k"], "size": t["size"], "n": t["n"], "copies": pa.array(copies)})


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3, source_col: str = "source", group: int = 1000) -> DataFrame:
    """docs as sized() gives them, with __source_size, __target and __copies (0 .. most) added."""
    keyed = docs.withColumn("__k", F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")))
    hist = written(keyed.groupBy(F.col("__k").alias("k"), F.col("__size").alias("size")).agg(F.first(source_col).cast("string").alias("source"), F.count("*").alias("n")))
    sources = hist.groupBy("k").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    goal = written(targets(sources, weights, float(most)).withColumn("mean", F.greatest(F.lit(1e-9), F.col("source_size") / F.col("docs"))))
    groups = hist.where("size > 0").join(goal.select("k", "source_size", "target", "mean"), "k")
    full = F.col("target") >= most * F.col("source_size")
    rate = F.when(full, F.lit(float(most))).otherwise(F.round(_rate(F.col("lam"), F.col("size") / F.col("mean"), float(most)), 9))
    rated = groups.join(balance(groups, float(most)), "k").select("k", "size", "n", rate.alias("rate"))
    plan = rated.groupBy("k").applyInArrow(lambda t: diffuse(t, most), "k string, size long, n long, copies long")
    plan = plan.unionByName(hist.where("size = 0").select("k", "size", "n", F.col("n").alias("copies"))).join(goal.select("k", "source_size", "target"), "k")
    plan = written(plan.select(F.col("k").alias("__k"), F.col("size").alias("__size"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.expr("copies div n").alias("__each"), (F.col("copies") % F.col("n")).alias("__more"), F.ceil(F.col("n") / F.lit(group)).alias("__parts")))
    told = keyed.join(plan, ["__k", "__size"]).withColumn("__part", F.pmod(F.col("__hash"), F.col("__parts")))
    # Of a (source, size) the first __more documents in the order of (part, hash) get one copy more: parts hold about
    # `group` documents each, and a part's documents are numbered from the sum of the parts before it.
    by = ["__k", "__size", "__part"]
    counts = keyed.select("__k", "__size", "__hash").join(plan.where("__more > 0 and __parts > 1").select("__k", "__size", "__parts"), ["__k", "__size"])
    counts = counts.groupBy("__k", "__size", F.pmod(F.col("__hash"), F.col("__parts")).alias("__part")).agg(F.count("*").alias("c"))
    before = Window.partitionBy("__k", "__size").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__start"))
    place = F.coalesce("__start", F.lit(0)) + F.row_number().over(Window.partitionBy(*by).orderBy("__hash"))
    ranked = told.join(starts, by, "left").withColumn("__copies", (F.col("__each") + (place <= F.col("__more")).cast("long")).cast("long"))
    return ranked.drop("__k", "__part", "__parts", "__each", "__more", "__start")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it."""
    source = options.get("source_col", "source")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # so that no name can clash
    mixed = mix(sized(docs.select(row, "doc_id", "text", F.col(source).alias("source"))).drop("doc_id", "text"), **options | {"source_col": "source"})
    return mixed.where("__copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("row.*")


def mix_table(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target and taken (words taken, repeats counted) for each row of docs."""
    slim = written(sized(docs.select("doc_id", "text", "source")).drop("text"))
    mixed = mix(slim, weights, most)
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))
