"""Graph patterns: nodes of a scope, joined along relations. A pattern is data, so a plan for a question needs no query language.

Every node that a pattern meets lies in the scope, those between the ends of a step of several hops too: the compiler adds the
predicate, whoever wrote the pattern.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..schema import RELATIONS, Scope
from .graph import KINDS, MOST_HOPS

COLUMNS = ("id", "record_id", "document_id", "position", "label", "text")
MOST_ROWS = 1000


@dataclass(frozen=True)
class Node:
    """A node: its kind, columns or properties that equal a value, and a part of its label, in any case."""

    kind: str | None = None
    equals: dict = field(default_factory=dict)
    label_contains: str | None = None


@dataclass(frozen=True)
class Step:
    """From a node to the next: along relations of one kind or any, `hops` from least to most, out, in or both ways."""

    relation: str | None = None
    kind: str | None = None
    hops: tuple[int, int] = (1, 1)
    way: str = "out"


@dataclass(frozen=True)
class Pattern:
    """nodes[i] and nodes[i + 1] are joined by steps[i]; returns are (number of the node, column or property)."""

    nodes: tuple[Node, ...]
    steps: tuple[Step, ...] = ()
    returns: tuple[tuple[int, str], ...] = ()
    limit: int = 30


def pattern_of(told: dict) -> Pattern:
    """A pattern from plain JSON, as a model writes it; raises ValueError for anything else."""
    try:
        nodes = tuple(Node(n.get("kind"), dict(n.get("equals") or {}), n.get("label_contains")) for n in told["nodes"])
        steps = tuple(Step(s.get("relation"), s.get("kind"), (int((h := s.get("hops") or [1, 1])[0]), int(h[1])), s.get("way") or "out") for s in told.get("steps") or ())
        return checked(Pattern(nodes, steps, tuple((int(i), str(c)) for i, c in told["returns"]), int(told.get("limit") or 30)))
    except (KeyError, TypeError, AttributeError, IndexError) as e:
        raise ValueError(f"this is no pattern: {e!r}") from e


def checked(p: Pattern) -> Pattern:
    if not p.nodes or len(p.steps) != len(p.nodes) - 1 or not p.returns:
        raise ValueError("a pattern has a step between each two nodes, and returns something")
    if bad := [n.kind for n in p.nodes if n.kind is not None and n.kind not in KINDS] + [s.relation for s in p.steps if s.relation is not None and s.relation not in RELATIONS] + [s.way for s in p.steps if s.way not in ("out", "in", "both")] + [i for i, _ in p.returns if not 0 <= i < len(p.nodes)]:
        raise ValueError(f"unknown: {bad}")
    if any(not 1 <= s.hops[0] <= s.hops[1] <= MOST_HOPS for s in p.steps):
        raise ValueError(f"hops go from 1 to {MOST_HOPS}")
    return p


def _value(name: str) -> Column:
    return F.col(name) if name in COLUMNS else F.col("properties")[name]


def _links(edges: DataFrame, step: Step, inside: DataFrame) -> DataFrame:
    """(a, b, hop) of a step: pairs, each once, of nodes that lie so many hops apart along one of its ways."""
    e = edges.where(F.col("relation") == step.relation) if step.relation else edges
    e = e.where(F.col("kind") == step.kind) if step.kind else e
    ways = {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[step.way]
    one = reduce(DataFrame.unionByName, [e.select(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in ways]).distinct()
    if step.hops == (1, 1):
        return one
    ids = inside.select("id")
    one = one.join(ids, one["a"] == ids["id"], "left_semi").join(ids, one["b"] == ids["id"], "left_semi")
    far, found = one, [one] if step.hops[0] == 1 else []
    for hop in range(2, step.hops[1] + 1):
        far = far.join(one.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct()
        found += [far] if hop >= step.hops[0] else []
    return reduce(DataFrame.unionByName, found).distinct()


def match(nodes: DataFrame, edges: DataFrame, pattern: Pattern, scope: Scope) -> DataFrame:
    """The values that a pattern returns, a row for each match, columns n<number>_<name>, in their order and up to the limit."""
    p = checked(pattern)
    inside = nodes.where(scope.of_graph())

    def end(i: int) -> DataFrame:
        rows, n = inside, p.nodes[i]
        if n.kind:
            rows = rows.where(F.col("kind") == n.kind)
        for name, value in n.equals.items():
            rows = rows.where(_value(name) == value)
        if n.label_contains:
            rows = rows.where(F.contains(F.lower(collapse(F.col("label"))), F.lit(" ".join(n.label_contains.lower().split()))))
        return rows.select(F.col("id").alias(f"__{i}"), *[_value(c).alias(f"n{j}_{c}") for j, c in dict.fromkeys(p.returns) if j == i])

    found = end(0)
    for i, step in enumerate(p.steps):
        links = _links(edges, step, inside).select(F.col("a").alias(f"__{i}"), F.col("b").alias(f"__{i + 1}"))
        found = found.join(links, f"__{i}").join(end(i + 1), f"__{i + 1}")
    told = [f"n{i}_{c}" for i, c in dict.fromkeys(p.returns)]
    return found.select(*told).orderBy(*told).limit(max(1, min(MOST_ROWS, p.limit)))
