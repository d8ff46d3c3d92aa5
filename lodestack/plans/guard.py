"""What a SQL text that comes from a model may hold: queries over named relations, built-in functions, nothing else.

Spark's own parser reads the text; every node of its tree, of subqueries and of common table expressions too, must be of a kind listed
here. A relation is one of the names allowed or a common table expression that is in scope where it is named, so neither tables of the
catalog nor files by their path can be reached.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

PLANS = frozenset(
    "OneRowRelation Project Filter Aggregate UnresolvedHaving Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except Join LateralJoin SubqueryAlias UnresolvedRelation UnresolvedWith WithWindowDefinition Generate Pivot Unpivot LocalRelation UnresolvedInlineTable UnresolvedSubqueryColumnAliases".split()
)
GENERATORS = frozenset("explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())
#: Built-in functions that call other code, or tell of the cluster or its files.
REFUSED = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_user user session_user current_catalog current_database current_schema version uuid raise_error assert_true spark_partition_id".split())


def _all(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def check_query(spark: SparkSession, text: str, relations: Iterable[str]) -> None:
    """Raises ValueError unless text is one query over `relations`."""
    from py4j.java_gateway import is_instance_of

    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    functions = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    kind = lambda x: x.getClass().getSimpleName()

    def function(parts: list[str], known: frozenset | None = None) -> None:
        name = parts[-1].lower()
        if len(parts) != 1 or name in REFUSED or (name not in known if known else not functions.functionExists(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))):
            raise ValueError(f"the function {'.'.join(parts)} is not allowed")

    def expression(e, names: frozenset) -> None:
        if kind(e) == "UnresolvedFunction":
            function(_all(e.nameParts()))
        elif kind(e) == "UnresolvedGenerator":
            function([e.name().funcName()], GENERATORS)
        elif "Identifier" in kind(e):
            raise ValueError("names that are computed are not allowed")
        if is_instance_of(gateway, e, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
            plan(e.plan(), names)
        for x in _all(e.children()):
            expression(x, names)

    def plan(p, names: frozenset) -> None:
        if kind(p) not in PLANS:
            raise ValueError(f"only queries are allowed, not {p.nodeName()}")
        if kind(p) == "UnresolvedRelation":
            parts = _all(p.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in names:
                raise ValueError(f"the relation {'.'.join(parts)} is not allowed")
        elif kind(p) == "UnresolvedWith":
            for cte in _all(p.cteRelations()):
                if not p.allowRecursion():
                    plan(cte._2(), names)
                names |= {cte._1().lower()}
                if p.allowRecursion():
                    raise ValueError("recursive queries are not allowed")
        for e in _all(p.expressions()):
            expression(e, names)
        for x in _all(p.children()):
            plan(x, names)

    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise ValueError("this is no query") from e
    plan(parsed, frozenset(x.lower() for x in relations))
