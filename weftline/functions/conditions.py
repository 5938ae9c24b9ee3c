"""Predicates with the null and empty rules of the query language."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Missing:
    """The value of an argument that was not given."""

    def __repr__(self):
        return "MISSING"


MISSING = Missing()


class Exists:
    """A test for rows of a subquery or collection; in a where it becomes a semi or anti join."""

    def __init__(self, source, negated: bool = False):
        self.source, self.negated = source, negated

    def column(self) -> Column:
        c = self.source.exists_column()
        return ~c if self.negated else c


class All:
    """Conditions of which all must hold, some of them Exists."""

    def __init__(self, parts):
        self.parts = parts

    def flat(self) -> list:
        return [y for x in self.parts for y in (x.flat() if isinstance(x, All) else [x])]

    def column(self) -> Column:
        return functools.reduce(operator.and_, [condition(x) for x in self.flat()], F.lit(True))


class Param:
    """A named parameter, bound when a prepared query is executed."""

    def __init__(self, name: str):
        self.name = name


_bindings: list[dict] = []


def condition(x) -> Column:
    return x.column() if isinstance(x, Exists | All) else x


def value(x, of=None):
    """A Column for an operand. of: the other operand, whose mapper encodes literals."""
    if isinstance(x, Missing):
        raise ValueError("an operand is missing")
    if isinstance(x, Param):
        if not _bindings:
            raise ValueError(f"parameter {x.name} is not bound")
        if x.name not in _bindings[-1]:
            raise ValueError(f"parameter {x.name} is missing")
        x = _bindings[-1][x.name]
    if isinstance(x, Column):
        return x
    if isinstance(x, DataFrame):
        return x.scalar()
    if hasattr(x, "scalar_column"):
        return x.scalar_column()
    mapper = of.__dict__.get("_mapper") if isinstance(of, Column) else None
    return F.lit(mapper.encode(x) if mapper and x is not None else x)


def stored(x) -> Column:
    """The stored form of a mapped column."""
    return x.__dict__.get("_stored", x) if isinstance(x, Column) else value(x)


def _bound(x):
    """What a parameter stands for now, else the value itself."""
    return _bindings[-1].get(x.name, MISSING) if isinstance(x, Param) and _bindings else x


def _compare(op):
    def compare(a, b=MISSING) -> Column:
        return op(stored(a), stored(value(b, a)))

    return compare


def eq(a, b) -> Column:
    return stored(a).isNull() if _bound(b) is None else stored(a) == stored(value(b, a))


def ne(a, b) -> Column:
    return stored(a).isNotNull() if _bound(b) is None else stored(a) != stored(value(b, a))


gt, gte, lt, lte = map(_compare, (operator.gt, operator.ge, operator.lt, operator.le))


def between(a, low, high) -> Column:
    return stored(a).between(stored(value(low, a)), stored(value(high, a)))


def in_array(a, values) -> Column:
    values = list(values)
    return stored(a).isin(*[value(v, a) for v in values]) if values else F.lit(False)


def not_in_array(a, values) -> Column:
    values = list(values)
    return ~stored(a).isin(*[value(v, a) for v in values]) if values else F.lit(True)


def is_null(a) -> Column:
    return stored(a).isNull()


def is_not_null(a) -> Column:
    return stored(a).isNotNull()


def on_true(*_) -> Column:
    """The condition of a join of all pairs."""
    return F.lit(True)


def and_(*parts):
    parts = [p for p in parts if p is not None]
    if any(isinstance(p, Exists | All) for p in parts):
        return All(parts)
    return functools.reduce(operator.and_, parts, F.lit(True)) if parts else F.lit(True)


def or_(*parts) -> Column:
    """Without parts it is true, as and_ is."""
    parts = [p for p in parts if p is not None]
    return functools.reduce(operator.or_, map(condition, parts)) if parts else F.lit(True)


def not_(part):
    if isinstance(part, Exists):
        return Exists(part.source, not part.negated)
    return ~condition(part)


def exists(source) -> Exists:
    return Exists(source)


def not_exists(source) -> Exists:
    return Exists(source, True)


def in_subquery(a, source) -> Column:
    return stored(a).isin(source.subquery_frame())


def not_in_subquery(a, source) -> Column:
    """No row passes if the subquery gives a null; all do if it gives nothing.

    Planned as an anti join on equal values and two one-row checks: SQL's own NOT IN
    would be planned as a null-aware join, which broadcasts the subquery whatever its size.
    """
    own = stored(a)
    df = source.subquery_frame()
    df = df.toDF("_in")
    one = lambda c: df.agg(c.alias("_n")).scalar()
    listed = df.where(F.col("_in") == own.outer()).exists()
    return All([~listed, one(F.count(F.when(F.col("_in").isNull(), 1))) == 0, own.isNotNull() | (one(F.count(F.lit(1))) == 0)])


eq_subquery, ne_subquery, gt_subquery, gte_subquery, lt_subquery, lte_subquery = map(_compare, (operator.eq, operator.ne, operator.gt, operator.ge, operator.lt, operator.le))


def outer(c: Column) -> Column:
    """A column of an enclosing query, for a correlated subquery."""
    return c.outer()


# Raw expressions.


class Raw:
    """SQL text with {} places. Columns, fragments and subqueries go in by name, other values as literals."""

    def __init__(self, text: str, *args):
        self.text, self.args = text, args

    def column(self) -> Column:
        return sql(self.text, *self.args)


def sql(text: str, *args) -> Column:
    """An expression of SQL text whose {} stand for the arguments."""
    parts = text.split("{}")
    if len(parts) != len(args) + 1:
        raise ValueError("as many arguments as places are needed")
    if not args:
        return F.expr(text)
    columns = [condition(a.column() if isinstance(a, Raw) else a if isinstance(a, Exists | All) else value(a)) for a in args]
    return F.expr("".join(p + (f"({as_sql(c)})" if c is not None else "") for p, c in zip(parts, [*columns, None], strict=True)))


def as_sql(c: Column) -> str:
    """A column as SQL text: its name if it is one, else its expression."""
    name = c.__dict__.get("_name")
    if name:
        return f"`{name}`"
    jvm = SparkSession.getActiveSession()._jvm
    converter = getattr(getattr(jvm.org.apache.spark.sql.classic, "ColumnNodeToExpressionConverter$"), "MODULE$")
    return converter.apply(c._jc.node()).sql()


def raw(text: str) -> Column:
    return F.expr(text)


def empty() -> None:
    """No fragment: where, and_ and join leave it out."""
    return None


def join_conditions(parts, separator: str = "and"):
    parts = [p for p in parts if p is not None]
    return and_(*parts) if separator.strip().lower() == "and" else or_(*parts)


def sql_join(parts, separator: str = ", ") -> Column:
    """Fragments as one piece of SQL text, with a separator between them; empty ones are left out."""
    return F.expr(separator.join(as_sql(condition(p) if not isinstance(p, Column) else p) for p in parts if p is not None))


def map_with(c: Column, change) -> Column:
    """A value transformed after it is read, null kept: change is a function of a column."""
    return F.when(c.isNotNull(), change(c))


def placeholder(name: str) -> Param:
    return Param(name)


# Text.


def like(a, pattern) -> Column:
    return stored(a).like(pattern)


def ilike(a, pattern) -> Column:
    return stored(a).ilike(pattern)


def starts_with(a, prefix) -> Column:
    return stored(a).startswith(prefix)


def regex_matches(a, pattern: str) -> Column:
    return stored(a).rlike(pattern)


def regex_matches_ci(a, pattern: str) -> Column:
    return stored(a).rlike("(?i)" + pattern)


def regex_no_match(a, pattern: str) -> Column:
    return ~stored(a).rlike(pattern)


def regex_no_match_ci(a, pattern: str) -> Column:
    return ~stored(a).rlike("(?i)" + pattern)
