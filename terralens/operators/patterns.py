"""Triple patterns, optional and negated groups, and spatial relation lookups as joins.

A pattern is ``(s, p, o)``; an entry starting with ``?`` is a variable, anything
else a constant term. Solutions are DataFrames with one column per variable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rdf

FUNCTION_BASE = "http://www.opengis.net/def/function/geosparql/"
# base of the short function names; set it to the one an existing graph uses
SHORT_BASE = "http://example.org/spatial#"

# fixed values: spatial functions and the relation each one reads
STANDARD_FUNCTIONS = ["sfWithin", "sfTouches", "sfIntersects", "sfCrosses", "sfContains", "sfOverlaps", "sfEquals", "sfCovers"]
SHORT_FUNCTIONS = {
    "within": "sfWithin",
    "touches": "sfTouches",
    "intersects": "sfIntersects",
    "crosses": "sfCrosses",
    "contains": "sfContains",
    "overlaps": "sfOverlaps",
    "equals": "sfEquals",
}
# fixed values: geometry wrappers that are looked through
WRAPPERS = ["transform", "buffer"]


def relation_of(function, short_base=SHORT_BASE):
    """Relation predicate a spatial function IRI stands for."""
    known = {FUNCTION_BASE + n: n for n in STANDARD_FUNCTIONS}
    known.update({short_base + n: r for n, r in SHORT_FUNCTIONS.items()})
    if function not in known:
        raise ValueError(f"{function} has no stored relation")
    return f"<{rdf.GEO}{known[function]}>"


def _variable(term):
    return isinstance(term, str) and term.startswith("?")


def match_one(triples: DataFrame, pattern) -> DataFrame:
    """Solutions of a single pattern: constants filter, variables become columns."""
    columns, conditions = {}, []
    for column, term in zip(("s", "p", "o"), pattern):
        if not _variable(term):
            conditions.append(F.col(column) == term)
        elif term[1:] in columns:
            conditions.append(F.col(column) == F.col(columns[term[1:]]))
        else:
            columns[term[1:]] = column
    kept = reduce(lambda df, c: df.filter(c), conditions, triples)
    return kept.select(*[F.col(c).alias(v) for v, c in columns.items()])


def _shared(left, right):
    return [c for c in left.columns if c in right.columns]


def join_on_shared(left: DataFrame, right: DataFrame, how="inner") -> DataFrame:
    shared = _shared(left, right)
    if not shared:
        raise ValueError("patterns share no variable; a product of solutions is not supported")
    return left.join(right, shared, how)


def join_order(patterns, counts=None):
    """The patterns in the order they are joined: each shares a variable with one before it.

    With ``counts``, the triples of each predicate, the rarest comes first; a constant subject or object counts as rarer
    than any predicate. Without, the written order is kept where it is connected.
    """

    def size(pattern):
        s, p, o = pattern
        constants = sum(not _variable(t) for t in (s, o))
        return (-constants, sum(counts.values()) if _variable(p) else counts.get(p, 0))

    def variables(pattern):
        return {t for t in pattern if _variable(t)}

    rest = list(patterns)
    if counts is not None:
        rest.sort(key=size)
    ordered = [rest.pop(0)]
    while rest:
        known = set().union(*map(variables, ordered))
        position = next((i for i, p in enumerate(rest) if variables(p) & known), None)
        if position is None:
            raise ValueError("the pattern is not connected")
        ordered.append(rest.pop(position))
    return ordered


def match(triples: DataFrame, patterns, counts=None) -> DataFrame:
    """Basic graph pattern: patterns joined on their shared variables in the order of ``join_order``."""
    return reduce(join_on_shared, [match_one(triples, p) for p in join_order(patterns, counts)])


def optional(solution: DataFrame, group: DataFrame) -> DataFrame:
    return join_on_shared(solution, group, "left")


def minus(solution: DataFrame, group: DataFrame) -> DataFrame:
    """Solutions compatible with none of ``group``; without a shared variable nothing is removed."""
    return join_on_shared(solution, group, "left_anti") if _shared(solution, group) else solution


def exists(solution: DataFrame, group: DataFrame, negated=False) -> DataFrame:
    return join_on_shared(solution, group, "left_anti" if negated else "left_semi")


def union(*groups: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), groups)


def filter_all(solution: DataFrame, *conditions) -> DataFrame:
    """Several filters of a group are one conjunction."""
    return solution.filter(reduce(lambda a, b: a & b, conditions))


def filter_any(solution: DataFrame, *conditions, as_union=False) -> DataFrame:
    """Disjunction; ``as_union`` keeps one branch per condition, so rows meeting several repeat."""
    if as_union:
        return union(*[solution.filter(c) for c in conditions])
    return solution.filter(reduce(lambda a, b: a | b, conditions))


def entity_variable(variable, geometry_of):
    """Follow ``wkt → geometry → entity`` aliases to the entity variable."""
    node = geometry_of.get(variable)
    if node is None:
        raise ValueError(f"{variable} is not a geometry expression")
    return geometry_of.get(node, node)


def unwrap(expression, short_base=SHORT_BASE):
    """``(function IRI, variable)`` of a known wrapper → the variable."""
    if isinstance(expression, tuple):
        function, inner = expression[0], expression[1]
        if function not in [short_base + w for w in WRAPPERS]:
            raise ValueError(f"unknown geometry function {function}")
        return inner
    return expression


def spatial(
    solution: DataFrame, relations: DataFrame, function, left, right, geometry_of=None, negated=False, short_base=SHORT_BASE, unique=False
) -> DataFrame:
    """Spatial function over two geometry variables as a lookup of the stored relation.

    ``relations(s, p, o)`` holds materialised pairs, each once if ``unique``. Negation removes the matching
    solutions.
    """
    relation = relation_of(function, short_base)
    a, b = unwrap(left, short_base), unwrap(right, short_base)
    if geometry_of:
        a, b = entity_variable(a, geometry_of), entity_variable(b, geometry_of)
    pairs = match_one(relations, (a, relation, b))
    if negated:
        # only the variables of the solution decide what is removed
        shared = _shared(solution, pairs)
        return minus(solution, pairs.select(*shared).distinct()) if shared else solution
    # solutions are hashed, the many more pairs are not sorted
    return join_on_shared(solution.hint("shuffle_hash"), pairs if unique else pairs.distinct())


def ask(solution: DataFrame) -> DataFrame:
    """One row telling whether there is any solution."""
    return solution.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))


def select(solution: DataFrame, columns, distinct=False, order=(), limit=None) -> DataFrame:
    """Projection with expressions ``{name: Column}``, then DISTINCT, ORDER BY and LIMIT."""
    out = solution.select(*[c.alias(n) for n, c in columns.items()])
    out = out.distinct() if distinct else out
    out = out.orderBy(*order) if order else out
    return out if limit is None else out.limit(limit)


def group(solution: DataFrame, by, aggregates, having=None) -> DataFrame:
    """GROUP BY with expressions, aggregates and HAVING."""
    out = solution.groupBy(*[c.alias(n) for n, c in by.items()]).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out if having is None else out.filter(having)
