"""Immutable queries over declared entities.

A query holds a lazy DataFrame whose columns carry an alias of their source, and
the rows that lambdas see. Reading a relation in a lambda joins it, once for each
path: a required reference with an inner join, another with a left join. Reading a
collection aggregates its rows by the foreign key and joins the result, so nothing
is asked for each parent. All planning is left to Catalyst.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conditions import All, Exists, condition, value
from ..plans.model import EntityDef, Literal, Model, Relation

_numbers = itertools.count()


def fresh(stem: str) -> str:
    return f"{stem}{next(_numbers)}"


def named(name: str, **marks) -> Column:
    c = F.col(f"`{name}`")
    c.__dict__["_name"] = name
    c.__dict__.update(marks)
    return c


class Frame:
    """The DataFrame that grows joins while a lambda reads rows. One for each step, so queries stay immutable.

    Aggregates of collections wait until the frame is read: those over the same
    children become one aggregation and one join. keep_rows: required references
    are joined as optional ones.
    """

    def __init__(self, db: Database, df: DataFrame, joined: dict, keep_rows: bool = False):
        self.db, self.base, self.joined, self.keep_rows = db, df, dict(joined), keep_rows
        self.waiting: list[tuple[list[Column], Frame, list[str], list[Column]]] = []

    @property
    def df(self) -> DataFrame:
        waiting, self.waiting = self.waiting, []
        for parents, children, keys, values in waiting:
            own = {k: fresh("k") for k in keys}
            grouped = children.df.groupBy(*keys).agg(*values).withColumnsRenamed(own)
            self.base = self.base.join(grouped, same_keys(parents, own.values()), "left")
        return self.base

    @df.setter
    def df(self, df: DataFrame) -> None:
        self.base = df

    def await_aggregate(self, parents: list[Column], children: Frame, keys: list[str], value: Column) -> None:
        for p, c, k, values in self.waiting:
            # Children that joined something of their own for the value are not the same.
            if k == keys and not c.joined and not children.joined and [x.__dict__.get("_name") for x in p] == [x.__dict__.get("_name") for x in parents] and c.df.sameSemantics(children.df):
                values.append(value)
                return
        self.waiting.append((parents, children, keys, [value]))

    def copy(self) -> Frame:
        return Frame(self.db, self.df, self.joined, self.keep_rows)


def same_keys(parents, keys) -> Column:
    return functools.reduce(operator.and_, [p == F.col(f"`{k}`") for p, k in zip(parents, keys, strict=True)])


class Row:
    """A source's row in a lambda: columns, references and collections as attributes."""

    def __init__(self, frame: Frame, entity: EntityDef, alias: str):
        self._frame, self._entity, self._alias = frame, entity, alias

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        e = self._entity
        if name in e.columns:
            c = e.columns[name]
            col = named(f"{self._alias}__{name}")
            if c.mapper and self._frame.db.mappers:
                out = c.mapper.decode(col)
                out.__dict__.update(_mapper=c.mapper, _stored=col)
                return out
            return col
        if name in e.relations:
            r = e.relations[name]
            return Collection(self, r) if r.many else self._reference(r)
        raise AttributeError(f"{e.name} has no property {name}")

    __getitem__ = __getattr__

    def _reference(self, r: Relation) -> Row:
        f = self._frame
        key = (self._alias, r.name)
        if key not in f.joined:
            alias = fresh(r.name)
            target = f.db.frame(r.target, alias)
            f.df = f.df.join(target, on_pairs(r, self._alias, alias), "inner" if r.required and not f.keep_rows else "left")
            f.joined[key] = alias
        return Row(f, f.db.model[r.target], f.joined[key])

    def _all(self) -> dict[str, Column]:
        return {p: self[p] for p in self._entity.columns}


class Fields(Row):
    """A row of named columns: a projection, a common table expression or a derived table. Names map to columns of the frame."""

    def __init__(self, frame: Frame, names: dict[str, str], base: Row | None = None):
        self._frame, self._names, self._base = frame, names, base

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        if name in self._names:
            return named(self._names[name])
        if self._base is not None:
            return getattr(self._base, name)
        raise AttributeError(f"no column {name}")

    __getitem__ = __getattr__

    def _all(self) -> dict[str, Column]:
        return {n: named(c) for n, c in self._names.items()}


def props(row: Row) -> dict[str, Column]:
    """All columns of a row, to spread into a projection."""
    return row._all()


def on_pairs(r: Relation, own: str, theirs: str) -> Column:
    side = lambda x, alias: F.lit(x.value) if isinstance(x, Literal) else F.col(f"`{alias}__{x}`")
    return functools.reduce(operator.and_, [side(a, own) == side(b, theirs) for a, b in r.pairs])


def as_column(x) -> Column:
    """The column of whatever a projection holds."""
    if isinstance(x, dict):
        return F.struct(*[as_column(v).alias(k) for k, v in x.items()])
    if isinstance(x, Row):
        return as_column(x._all())
    if isinstance(x, Collection):
        return x.to_list()
    if isinstance(x, Exists | All):
        return condition(x)
    return value(x)


def sort_pairs(spec) -> list[tuple[Column, bool]]:
    """(column, whether it goes down) of a column, a list, or (column, "ASC" | "DESC") pairs."""
    items = spec if isinstance(spec, list) else [spec]
    pairs = [x if isinstance(x, tuple) else (x, "ASC") for x in items]
    return [(as_column(c), way.upper() == "DESC") for c, way in pairs]


def orderings(spec) -> list[Column]:
    """Sort columns: nulls last going up, first going down."""
    return [c.desc_nulls_first() if down else c.asc_nulls_last() for c, down in sort_pairs(spec)]


def rising(c: Column, kind: T.DataType, down: bool) -> list[Column] | None:
    """Columns without nulls' own order, whose rising order is that of c (nulls last going up, first going down); None if its type has no such form."""
    if not down:
        return [c.isNull(), c]
    if isinstance(kind, T.IntegralType):
        return [c.isNotNull(), F.bitwise_not(c)]
    if isinstance(kind, T.FractionalType):
        return [c.isNotNull(), ~F.isnan(c.cast("double")), -c]
    if isinstance(kind, T.DateType):
        return [c.isNotNull(), -F.unix_date(c)]
    return None


class Database:
    """Entities bound to tables of a session. `tables` gives a DataFrame by table name."""

    def __init__(self, spark: SparkSession, model: Model, tables: Callable[[str], DataFrame]):
        self.spark, self.model, self.tables = spark, model, tables
        self._read: dict[str, DataFrame] = {}
        self._ctes: dict[str, Cte] = {}
        self.strategy, self.mappers = "aggregate", True
        self.timeout, self.tracer = None, None

    def with_options(self, collection_strategy: str | None = None, disable_mappers: bool | None = None, timeout: float | None = None, tracer=None) -> Database:
        """The same tables under other options.

        timeout: seconds after which a query's jobs are stopped. tracer: a plans.batch.Tracer that times queries and tells slow ones.

        collection_strategy: how a collection's rows are gathered. aggregate (also called cte or lateral: Catalyst takes
        correlation apart to the same plan) groups all children by key; keys_first (temptable) keeps only those of the
        parents at hand before, which pays where few parents are left.
        """
        other = Database(self.spark, self.model, self.tables)
        other._read, other._ctes = self._read, self._ctes
        names = {"aggregate": "aggregate", "cte": "aggregate", "lateral": "aggregate", "keys_first": "keys_first", "temptable": "keys_first"}
        other.strategy = names[collection_strategy] if collection_strategy else self.strategy
        other.mappers = not disable_mappers if disable_mappers is not None else self.mappers
        other.timeout, other.tracer = timeout or self.timeout, tracer or self.tracer
        return other

    def run(self, phase: str, action: Callable):
        """action() under the time limit and the tracer of these options."""
        from ..plans.batch import with_timeout

        limited = action if self.timeout is None else lambda: with_timeout(self.spark, action, self.timeout)
        return limited() if self.tracer is None else self.tracer.run(phase, limited)

    def raw_frame(self, entity: str) -> DataFrame:
        table = self.model[entity].qualified
        if table not in self._read:
            self._read[table] = self.tables(table)
        return self._read[table]

    def frame(self, entity: str, alias: str) -> DataFrame:
        """The entity's mapped columns under an alias."""
        e = self.model[entity]
        df = self.raw_frame(entity)
        return df.select(*[F.col(f"`{c.stored or p}`").alias(f"{alias}__{p}") for p, c in e.columns.items()])

    def table(self, entity: str) -> Query:
        alias = fresh(entity)
        f = Frame(self, self.frame(entity, alias), {})
        return Query(f, lambda fr: Row(fr, self.model[entity], alias))

    def __getattr__(self, name: str) -> Query:
        if name.startswith("_") or name not in self.model.entities:
            raise AttributeError(name)
        return self.table(name)

    def query(self, text: str, *args, **named_args) -> Query:
        """SQL text with ? or :name parameters."""
        return self.of(self.spark.sql(text, args=list(args) or named_args or None))

    def of(self, df: DataFrame) -> Query:
        """A query over any DataFrame."""
        alias = fresh("t")
        names = {c: f"{alias}__{c}" for c in df.columns}
        return Query(Frame(self, df.toDF(*names.values()), {}), lambda fr: Fields(fr, names))

    def select_from_cte(self, cte: Cte) -> Query:
        return self.of(cte.df())

    def cte(self, name: str, query: Query, materialized: bool = False) -> Cte:
        return self._kept(Cte(self, name, query.df(), materialized))

    def _kept(self, cte: Cte) -> Cte:
        self._ctes[cte.name] = cte
        return cte

    def ctes(self) -> list[Cte]:
        """The frames named so far."""
        return list(self._ctes.values())

    def clear_ctes(self) -> None:
        for c in self._ctes.values():
            c._df.unpersist()
        self._ctes.clear()

    def mutation_cte(self, name: str, written) -> Cte:
        """The rows that a write affects, as a frame; what else reads the table sees it as it was."""
        return self._kept(Cte(self, name, written.affected))

    def aggregation_cte(self, name: str, query: Query, key: Callable, alias: str) -> Cte:
        """One row for each key, with the other columns of the query's rows as an array of structs."""
        df = query.df()
        keys = key(Names(df))
        keys = keys if isinstance(keys, dict) else {_name_of(keys): keys}
        used = {_name_of(c) for c in keys.values()}
        rest = [c for c in df.columns if c not in used]
        out = df.groupBy(*[as_column(c).alias(k) for k, c in keys.items()]).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in rest])).alias(alias))
        return self._kept(Cte(self, name, out, False, (alias,)))


def _name_of(c: Column) -> str:
    return c.__dict__.get("_name", "")


class Names:
    """The columns of a DataFrame as attributes."""

    def __init__(self, df: DataFrame):
        self._df = df

    def __getattr__(self, name: str):
        if name.startswith("__") or name not in self._df.columns:
            raise AttributeError(name)
        return named(name)

    __getitem__ = __getattr__


class Cte:
    """A named frame. materialized: it is computed once and kept; the copy can be computed again if an executor is lost."""

    def __init__(self, db: Database, name: str, df: DataFrame, materialized: bool = False, arrays: tuple[str, ...] = ()):
        self.db, self.name, self.arrays = db, name, arrays
        self._df = df.persist() if materialized else df

    def df(self) -> DataFrame:
        return self._df

    def as_view(self) -> str:
        """Registers the frame for SQL text under its name."""
        self._df.createOrReplaceTempView(self.name)
        return self.name


class Query:
    """Rows of a frame; make: the row (or rows of joined sources) that lambdas get."""

    def __init__(self, frame: Frame, make: Callable, out: dict[str, str] | None = None, order=(), limit_=None, offset_=None, distinct=False, counted: Frame | None = None):
        self._frame, self._make, self._out = frame, make, out
        self._order, self._limit, self._offset, self._distinct = tuple(order), limit_, offset_, distinct
        self._counted = counted or frame

    def _but(self, **changes) -> Query:
        state = {"frame": self._frame, "make": self._make, "out": self._out, "order": self._order, "limit_": self._limit, "offset_": self._offset, "distinct": self._distinct, "counted": self._counted}
        return type(self)(**{**state, **changes})

    @property
    def db(self) -> Database:
        return self._frame.db

    def _row(self, frame: Frame):
        row = self._make(frame)
        return row if self._out is None else Fields(frame, self._out, row if isinstance(row, Row) else None)

    # Filters and projections.

    def where(self, test: Callable) -> Query:
        """Rows for which test(row) is true; several calls are joined by and. Existence tests become semi and anti joins."""
        q = self._settled()
        f, counted = _filtered(q._frame, q._row, test), None
        if q._counted is not q._frame and q._out is None:
            counted = _filtered(q._counted, q._row, test)
        return q._but(frame=f, counted=counted or f)

    def select(self, shape: Callable) -> Query:
        """Columns of shape(row): a dict (nested ones become structs), a row, or one column."""
        q = self._settled()
        f = q._frame.copy()
        got = shape(*_args(q._row(f)))
        if isinstance(got, Row) and not isinstance(got, dict):
            got = got._all()
        if not isinstance(got, dict):
            got = {_last(_name_of(got)) or "value": got}
        stem = fresh("out")
        out = {k: f"{stem}__{k}" for k in got}
        columns = {out[k]: as_column(v) for k, v in got.items()}
        f.df = f.df.withColumns(columns)
        return q._but(frame=f, out=out, counted=q._counted)

    def select_distinct(self, shape: Callable) -> Query:
        return self.select(shape)._but(distinct=True)

    def _settled(self) -> Query:
        """Limits and distinctness applied, so that a further step sees their rows."""
        if self._limit is None and self._offset is None and not self._distinct:
            return self
        return self.db.of(self.df())

    # Joins.

    def _joined(self, other, on: Callable, shape: Callable | None, how: str) -> Query:
        q = self._settled()
        f = q._frame.copy()
        right, arrays = _source(f.db, other)
        g = right._frame.copy()
        make = lambda fr, left=q, right=right: (*_args(left._row(fr)), right._row(fr))
        both = Frame(f.db, f.df, {**f.joined, **g.joined})
        left_rows, right_row = _args(q._row(both)), right._row(both)
        test = F.lit(True) if on is None else condition(on(*left_rows, right_row))
        # References that the condition reads are part of the left side.
        both.df = both.df.join(g.df, test, how) if on is not None else both.df.crossJoin(g.df)
        for a in arrays:
            if how in ("left", "full"):
                name = right._out[a] if right._out else right._row(both)._names[a]
                both.df = both.df.withColumn(name, F.coalesce(F.col(f"`{name}`"), F.array().cast(both.df.schema[name].dataType)))
        joined = Query(both, make)
        return joined.select(shape) if shape else joined

    def inner_join(self, other, on: Callable, shape: Callable | None = None) -> Query:
        return self._joined(other, on, shape, "inner")

    def left_join(self, other, on: Callable, shape: Callable | None = None) -> Query:
        return self._joined(other, on, shape, "left")

    def right_join(self, other, on: Callable, shape: Callable | None = None) -> Query:
        return self._joined(other, on, shape, "right")

    def full_outer_join(self, other, on: Callable, shape: Callable | None = None) -> Query:
        return self._joined(other, on, shape, "full")

    def cross_join(self, other, shape: Callable | None = None) -> Query:
        return self._joined(other, None, shape, "cross")

    def join_filter(self, other, on: Callable, test: Callable | None = None) -> Query:
        """An inner join that leaves the projection as it is; several partners repeat a row."""
        return self._join_filter(other, on, test, "inner")

    def left_join_filter(self, other, on: Callable, test: Callable | None = None) -> Query:
        return self._join_filter(other, on, test, "left")

    def _join_filter(self, other, on, test, how) -> Query:
        q = self._settled()
        both = q._frame.copy()
        right, _ = _source(both.db, other)
        g = right._frame.copy()
        both.joined |= g.joined
        rows = (*_args(q._row(both)), right._row(both))
        matched = condition(on(*rows))
        both.df = both.df.join(g.df, matched, how)
        if test is not None:
            both.df = both.df.filter(condition(test(*rows)))
        return q._but(frame=both, counted=both)

    # Order, limits, ends.

    def order_by(self, spec: Callable) -> Query:
        """The last call holds. spec(row): a column, a list, or (column, direction) pairs."""
        f = self._frame.copy()
        row = self._row(f)
        return self._but(frame=f, order=orderings(spec(*_args(row))))

    def limit(self, n: int) -> Query:
        return self._but(limit_=n)

    def offset(self, n: int) -> Query:
        return self._but(offset_=n)

    def _names(self) -> dict[str, str]:
        if self._out is not None:
            return self._out
        row = self._make(self._frame)
        if isinstance(row, Fields):
            return row._names
        if isinstance(row, Row):
            return {p: f"{row._alias}__{p}" for p in row._entity.columns}
        raise ValueError("a join of several sources needs a select")

    def _mapped(self, name: str) -> Column:
        row = self._make(self._frame) if self._out is None else None
        return getattr(row, name) if isinstance(row, Row) and not isinstance(row, Fields) else F.col(f"`{self._names()[name]}`")

    def df(self) -> DataFrame:
        """The rows as a lazy DataFrame."""
        df, names = self._frame.df, self._names()
        shown = [self._mapped(n).alias(n) for n in names]
        if self._distinct:
            df = df.select(*shown).distinct()
            if self._order:
                back = {c: n for n, c in names.items()}
                df = df.select(*df.columns, *[F.col(f"`{n}`").alias(c) for c, n in back.items() if c != n]).orderBy(*self._order)
            shown = [F.col(f"`{n}`") for n in names]
        elif self._order:
            df = df.orderBy(*self._order)
        if self._offset is not None:
            df = df.offset(self._offset)
        if self._limit is not None:
            df = df.limit(self._limit)
        return df.select(*shown)

    def to_list(self) -> list:
        df = self.df()
        return self.db.run("list", df.collect)

    def first(self):
        """The first row, or None."""
        rows = self.db.run("first", self.limit(1).df().collect)
        return rows[0] if rows else None

    first_or_default = first

    def first_or_throw(self):
        row = self.first()
        if row is None:
            raise LookupError("the query has no rows")
        return row

    def explain(self) -> str:
        return self.df()._jdf.queryExecution().explainString(self.db.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    to_sql = explain

    # Aggregates over all rows. Limits, distinctness and joins that only a projection needs don't count.

    def count_frame(self) -> DataFrame:
        return self._counted.df.select(F.count(F.lit(1)).alias("count"))

    def count(self) -> int:
        return self.db.run("count", self.count_frame().first)[0]

    def exists_frame(self) -> DataFrame:
        """One row: whether there is any."""
        return self._counted.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("exists"))

    def exists(self) -> bool:
        return bool(self._counted.df.limit(1).count())

    def aggregate_frame(self, fn: str, shape: Callable | None = None) -> DataFrame:
        f = self._frame.copy()
        row = self._row(f)
        c = as_column(shape(*_args(row))) if shape else named(next(iter(self._names().values())))
        return f.df.select(getattr(F, fn)(c).alias(fn))

    def min(self, shape: Callable | None = None):
        return self.aggregate_frame("min", shape).first()[0]

    def max(self, shape: Callable | None = None):
        return self.aggregate_frame("max", shape).first()[0]

    def sum(self, shape: Callable | None = None):
        return self.aggregate_frame("sum", shape).first()[0]

    def count_over_frame(self, total: str = "total") -> DataFrame:
        """The page's rows, each with the number of rows before limits. The total is one aggregate joined on, so no window gathers all rows in a task."""
        page = self.df()
        n = self._frame.df.agg(F.count(F.lit(1)).alias(total))
        return page.crossJoin(F.broadcast(n))

    def count_over(self) -> tuple[list, int]:
        rows = self.count_over_frame("_total").collect()
        return [r[:-1] for r in rows], rows[0][-1] if rows else 0

    # Grouping, sets, subqueries.

    def group_by(self, keys: Callable) -> Grouped:
        """Groups by columns or expressions; earlier order and limits are dropped."""
        f = self._frame.copy()
        row = self._row(f)
        got = keys(*_args(row))
        got = got if isinstance(got, dict) else {_last(_name_of(got)) or "key": got}
        return Grouped(self._but(frame=f, order=(), limit_=None, offset_=None, distinct=False), {k: as_column(v) for k, v in got.items()})

    def union(self, other: Query) -> Union:
        return Union(self.db, self.df()).union(other)

    def union_all(self, other: Query) -> Union:
        return Union(self.db, self.df()).union_all(other)

    def intersect(self, other: Query) -> Union:
        return Union(self.db, self.df().intersect(other.df()))

    def except_all(self, other: Query) -> Union:
        return Union(self.db, self.df().exceptAll(other.df()))

    def as_subquery(self, mode: str = "table") -> Subquery:
        return Subquery(self, mode)

    def subquery_frame(self) -> DataFrame:
        return self.df()

    def scalar_column(self) -> Column:
        return self.df().scalar()

    def exists_column(self) -> Column:
        return self._frame.df.exists()

    def with_(self, *ctes: Cte) -> Query:
        """Makes frames known to SQL text by name."""
        for c in ctes:
            c.as_view()
        return self

    # Execution shapes (plans.batch).

    def prepare(self, name: str = ""):
        raise TypeError("prepare a function of the parameters: plans.batch.prepare")


class Subquery:
    """A query in a position that takes a value (scalar), a list (array) or rows (table)."""

    def __init__(self, query: Query, mode: str):
        if mode not in ("scalar", "array", "table"):
            raise ValueError(mode)
        self.query, self.mode = query, mode

    def df(self) -> DataFrame:
        return self.query.df()

    subquery_frame = df

    def scalar_column(self) -> Column:
        return self.query.scalar_column()

    def exists_column(self) -> Column:
        return self.query.exists_column()


def _source(db: Database, other) -> tuple[Query, tuple[str, ...]]:
    if isinstance(other, Cte):
        return db.of(other.df()), other.arrays
    if isinstance(other, str):
        return db.table(other), ()
    if isinstance(other, DataFrame):
        return db.of(other), ()
    if isinstance(other, Query) and other._out is None and not other._order and other._limit is None and other._offset is None and not other._distinct:
        return other, ()
    return db.of(other.df()), ()


def _args(row) -> tuple:
    return row if isinstance(row, tuple) else (row,)


def _last(name: str) -> str:
    return name.rpartition("__")[2]


def _filtered(frame: Frame, make: Callable, test: Callable) -> Frame:
    f = frame.copy()
    got = test(*_args(make(f)))
    if got is None:
        return f
    for part in got.flat() if isinstance(got, All) else [got]:
        if part is None:
            continue
        if isinstance(part, Exists) and isinstance(part.source, Collection):
            part.source.keep(f, part.negated)
        else:
            f.df = f.df.filter(condition(part))
    return f


class Union:
    """Set operations, from left to right; columns go by place and are named as in the first leg."""

    def __init__(self, db: Database, df: DataFrame, order=(), limit_=None, offset_=None):
        self.db, self._df, self._order, self._limit, self._offset = db, df, order, limit_, offset_

    def _leg(self, other) -> DataFrame:
        return self._df.union(other.df().toDF(*self._df.columns))

    def union(self, other) -> Union:
        return Union(self.db, self._leg(other).distinct())

    def union_all(self, other) -> Union:
        return Union(self.db, self._leg(other))

    def order_by(self, spec: Callable) -> Union:
        return Union(self.db, self._df, orderings(spec(Names(self._df))), self._limit, self._offset)

    def limit(self, n: int) -> Union:
        return Union(self.db, self._df, self._order, n, self._offset)

    def offset(self, n: int) -> Union:
        return Union(self.db, self._df, self._order, self._limit, n)

    def df(self) -> DataFrame:
        df = self._df.orderBy(*self._order) if self._order else self._df
        df = df.offset(self._offset) if self._offset is not None else df
        return df.limit(self._limit) if self._limit is not None else df

    def to_list(self) -> list:
        return self.df().collect()

    def first_or_default(self):
        rows = self.limit(1).to_list()
        return rows[0] if rows else None

    def count_frame(self) -> DataFrame:
        return self.df().agg(F.count(F.lit(1)).alias("count"))

    def count(self) -> int:
        return self.count_frame().first()[0]

    def query(self) -> Query:
        return self.db.of(self.df())

    def as_subquery(self, mode: str = "table") -> Subquery:
        return Subquery(self.query(), mode)

    subquery_frame = df


class Group:
    """What a grouped select or having sees: the keys and aggregates over the group's rows."""

    def __init__(self, keys: dict[str, Column], row, values: dict):
        self.key, self._row, self._values = Attributes(keys), row, values

    def _of(self, shape: Callable) -> Column:
        from ..functions.conditions import stored

        return stored(as_column(shape(*_args(self._row))))

    def count(self) -> Column:
        return F.count(F.lit(1)).cast("int")

    def sum(self, shape: Callable) -> Column:
        return F.sum(self._of(shape)).cast("double")

    def avg(self, shape: Callable) -> Column:
        return F.avg(self._of(shape)).cast("double")

    def min(self, shape: Callable) -> Column:
        return F.min(self._of(shape))

    def max(self, shape: Callable) -> Column:
        return F.max(self._of(shape))

    def count_distinct(self, shape: Callable) -> Column:
        """An extension."""
        return F.countDistinct(self._of(shape)).cast("int")

    def approx_count_distinct(self, shape: Callable) -> Column:
        """An extension."""
        return F.approx_count_distinct(self._of(shape)).cast("int")


class Attributes:
    def __init__(self, names: dict):
        self.__dict__.update(names)

    def __getitem__(self, name: str):
        return self.__dict__[name]


class Grouped:
    """A grouping before its projection. kind: groupBy, or the extensions rollup and cube."""

    def __init__(self, query: Query, keys: dict[str, Column], tests=(), kind: str = "groupBy"):
        self._query, self._keys, self._tests, self._kind = query, keys, tuple(tests), kind

    def rollup(self) -> Grouped:
        return Grouped(self._query, self._keys, self._tests, "rollup")

    def cube(self) -> Grouped:
        return Grouped(self._query, self._keys, self._tests, "cube")

    def having(self, test: Callable) -> Grouped:
        return Grouped(self._query, self._keys, (*self._tests, test), self._kind)

    def select(self, shape: Callable) -> GroupedSelect:
        return GroupedSelect(self, shape)


class GroupedSelect:
    def __init__(self, grouped: Grouped, shape: Callable, tests=()):
        self._grouped, self._shape, self._tests = grouped, shape, tuple(tests)

    def having(self, test: Callable) -> GroupedSelect:
        return GroupedSelect(self._grouped, self._shape, (*self._tests, test))

    def query(self) -> Query:
        """The groups as rows of a query, for order, limits and joins."""
        g = self._grouped
        f = g._query._frame.copy()
        stem = fresh("key")
        names = {k: f"{stem}__{k}" for k in g._keys}
        row = g._query._row(f)
        group = Group({k: named(c) for k, c in names.items()}, row, {})
        got = self._shape(group)
        tests = [condition(t(group)) for t in (*g._tests, *self._tests)]
        df = f.df.withColumns({names[k]: c for k, c in g._keys.items()})
        keys = [F.col(f"`{c}`") for c in names.values()]
        out = {k: as_column(v) for k, v in got.items()}
        asked = [c.alias(f"_o{i}") for i, c in enumerate(out.values())] + [t.alias(f"_t{i}") for i, t in enumerate(tests)]
        df = getattr(df, g._kind)(*keys).agg(*asked)
        for i in range(len(tests)):
            df = df.filter(F.col(f"_t{i}"))
        return g._query.db.of(df.select(*[F.col(f"_o{i}").alias(k) for i, k in enumerate(out)]))

    def df(self) -> DataFrame:
        return self.query().df()

    def to_list(self) -> list:
        return self.df().collect()

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.query(), name)


class Collection:
    """The rows that a 1:N relation gives each parent. Ends (count, to_list, ...) aggregate them by the foreign key and join the result to the parents' frame."""

    def __init__(self, parent: Row, relation: Relation):
        self._parent, self._r = parent, relation
        self._tests: tuple = ()
        self._order = self._shape = self._limit = self._offset = None
        self._distinct = False
        self._through: tuple = ()

    def _but(self, **changes) -> Collection:
        c = Collection(self._parent, self._r)
        c.__dict__.update(self.__dict__)
        c.__dict__.update({f"_{k}": v for k, v in changes.items()})
        return c

    def where(self, test: Callable) -> Collection:
        return self._but(tests=(*self._tests, test))

    def select(self, shape: Callable) -> Collection:
        return self._but(shape=shape)

    def select_distinct(self, shape: Callable) -> Collection:
        return self._but(shape=shape, distinct=True)

    def order_by(self, spec: Callable) -> Collection:
        return self._but(order=spec)

    def limit(self, n: int) -> Collection:
        return self._but(limit=n)

    def offset(self, n: int) -> Collection:
        return self._but(offset=n)

    def select_many(self, step: Callable) -> Collection:
        """Flattens a collection of the items: what follows sees the inner rows."""
        return self._but(through=(*self._through, (step, self._tests)), tests=(), order=None, shape=None)

    # The children's frame.

    def _children(self) -> tuple[Frame, object, list[str]]:
        """(frame, row, key columns) of the filtered children, keys named as the parent's pairs."""
        db = self._parent._frame.db
        # The same name each time: equal collections of a parent then have equal plans.
        alias = f"{self._parent._alias}_{self._r.name}"
        f = Frame(db, db.frame(self._r.target, alias), {})
        row = Row(f, db.model[self._r.target], alias)
        keys = []
        for i, (own, theirs) in enumerate(self._r.pairs):
            if isinstance(theirs, Literal):
                raise ValueError("a literal of a 1:N key belongs to the children's side: give it as the own part")
            if isinstance(own, Literal):
                f.df = f.df.filter(F.col(f"`{alias}__{theirs}`") == own.value)
            else:
                name = f"{alias}__fk{i}"
                f.df = f.df.withColumn(name, F.col(f"`{alias}__{theirs}`"))
                keys.append(name)
        if db.strategy == "keys_first" and keys:
            asked = self._parent._frame.base.select(*[p.alias(f"{k}_p") for p, k in zip(self._parent_keys(), keys, strict=True)])
            f.df = f.df.join(asked, functools.reduce(operator.and_, [F.col(f"`{k}`") == F.col(f"`{k}_p`") for k in keys]), "left_semi")
        for step, tests in self._through:
            for t in tests:
                f = _filtered(f, lambda fr, e=row._entity, a=row._alias: Row(fr, e, a), t)
            inner = step(Row(f, row._entity, row._alias))
            g = f"{row._alias}_{inner._r.name}"
            f.df = f.df.join(db.frame(inner._r.target, g), on_pairs(inner._r, row._alias, g), "inner")
            row = Row(f, db.model[inner._r.target], g)
            for t in inner._tests:
                f = _filtered(f, lambda fr, e=row._entity, a=row._alias: Row(fr, e, a), t)
        for t in self._tests:
            f = _filtered(f, lambda fr, e=row._entity, a=row._alias: Row(fr, e, a), t)
        return f, Row(f, row._entity, row._alias), keys

    def _parent_keys(self) -> list[Column]:
        return [named(f"{self._parent._alias}__{own}") for own, theirs in self._r.pairs if not isinstance(own, Literal) and not isinstance(theirs, Literal)]

    def keep(self, frame: Frame, negated: bool) -> None:
        """Parents that have such a child (or none), by a semi or anti join."""
        f, _, keys = self._children()
        own = {k: fresh("k") for k in keys}
        children = f.df.select(*[F.col(f"`{k}`").alias(n) for k, n in own.items()])
        frame.df = frame.df.join(children, same_keys(self._parent_keys(), own.values()), "left_anti" if negated else "left_semi")

    def _attach(self, df: DataFrame, keys: list[str], name: str) -> Column:
        frame = self._parent._frame
        own = {k: fresh("k") for k in keys}
        frame.df = frame.df.join(df.withColumnsRenamed(own), same_keys(self._parent_keys(), own.values()), "left")
        return named(name)

    def _awaited(self, f: Frame, keys: list[str], aggregate: Column, name: str) -> Column:
        self._parent._frame.await_aggregate(self._parent_keys(), f, keys, aggregate.alias(name))
        return named(name)

    def _ranked(self):
        """Children with their values, in order, cut by limit and offset for each parent: (df, keys, order columns, value)."""
        f, row, keys = self._children()
        order = orderings(self._order(row)) if self._order else []
        cut = self._limit is not None or self._offset is not None
        # Keys of the child break ties, so that a cut is the same each time.
        ties = [F.col(f"`{row._alias}__{k}`") for k in (row._entity.key or tuple(row._entity.columns))]
        rank = None
        if self._distinct:
            shape = self._shape(row) if self._shape else row._all()
            f.df = f.df.withColumn("_v", as_column(shape)).select(*keys, "_v").distinct()
            order, ties = [F.col("_v").asc_nulls_last()], []
        if order or cut:
            f.df = f.df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*(order + ties))))
            rank = F.col("_rn")
            low = self._offset or 0
            if low:
                f.df = f.df.filter(rank > low)
            if self._limit is not None:
                f.df = f.df.filter(rank <= low + self._limit)
        if not self._distinct:
            # After the cut: collections in the shape are joined to the items that stay.
            shape = self._shape(row) if self._shape else row._all()
            v = as_column(shape)
            f.df = f.df.withColumn("_v", v)
        return f.df, keys, rank, shape

    def _gathered(self) -> tuple[Frame, list[str], Column, T.DataType] | None:
        """(children, keys, their values as an array in order, type of a value), where nothing is cut or made distinct and the order has a rising form: no window is needed then."""
        if self._limit is not None or self._offset is not None or self._distinct:
            return None
        f, row, keys = self._children()
        v = as_column(self._shape(row) if self._shape else row._all())
        if not self._order:
            return f, keys, F.collect_list(v), f.df.select(v.alias("v")).schema["v"].dataType
        ties = [(F.col(f"`{row._alias}__{k}`"), False) for k in (row._entity.key or tuple(row._entity.columns))]
        pairs = [*sort_pairs(self._order(row)), *ties]
        kinds = f.df.select(v.alias("v"), *[c.alias(f"c{i}") for i, (c, _) in enumerate(pairs)]).schema
        fields = []
        for i, (c, down) in enumerate(pairs):
            up = rising(c, kinds[f"c{i}"].dataType, down)
            if up is None or isinstance(kinds[f"c{i}"].dataType, T.MapType | T.VariantType):
                return None
            fields += up
        items = F.collect_list(F.struct(*[x.alias(f"f{i}") for i, x in enumerate(fields)], F.struct(v.alias("v")).alias("item")))
        if isinstance(kinds["v"].dataType, T.MapType | T.VariantType):
            return None
        return f, keys, F.transform(F.array_sort(items), lambda x: x["item"]["v"]), kinds["v"].dataType

    def to_list(self) -> Column:
        """An array of the items, empty where there are none."""
        name = fresh("list")
        found = self._gathered()
        if found:
            f, keys, items, kind = found
            return F.coalesce(self._awaited(f, keys, items, name), F.array().cast(T.ArrayType(kind)))
        df, keys, rank, _ = self._ranked()
        if rank is None:
            items = F.collect_list("_v")
        else:
            items = F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rn"), F.col("_v").alias("v")))), lambda x: x["v"])
        kind = T.ArrayType(df.schema["_v"].dataType)
        c = self._attach(df.groupBy(*keys).agg(items.alias(name)), keys, name)
        return F.coalesce(c, F.array().cast(kind))

    to_number_list = to_string_list = to_list

    def first_or_default(self) -> Column:
        """The first item, or null."""
        df, keys, _, _ = self._but(limit=1, order=self._order or (lambda r: []))._ranked()
        name = fresh("first")
        return self._attach(df.select(*keys, F.col("_v").alias(name)), keys, name)

    def _aggregate(self, make: Callable[[Column], Column], shape: Callable | None) -> Column:
        c = self if self._shape or shape is None else self._but(shape=shape)
        name = fresh("agg")
        if c._limit is None and c._offset is None and not c._distinct:
            f, row, keys = c._children()
            return self._awaited(f, keys, make(as_column(c._shape(row)) if c._shape else F.lit(1)), name)
        df, keys, _, _ = c._ranked()
        return self._attach(df.groupBy(*keys).agg(make(F.col("_v")).alias(name)), keys, name)

    def count(self) -> Column:
        return F.coalesce(self._but(shape=self._shape if self._distinct else None)._aggregate(lambda v: F.count(F.lit(1)), None), F.lit(0))

    def sum(self, shape: Callable | None = None) -> Column:
        return self._aggregate(F.sum, shape)

    def min(self, shape: Callable | None = None) -> Column:
        return self._aggregate(F.min, shape)

    def max(self, shape: Callable | None = None) -> Column:
        return self._aggregate(F.max, shape)

    def exists_column(self) -> Column:
        """Whether there is an item, in any position but a where's top."""
        return F.coalesce(self._aggregate(lambda v: F.max(F.lit(True)), None), F.lit(False))

    exists = exists_column
