"""Writes as transforms: each takes the table's rows and gives its rows afterwards, or the rows affected.

Nothing is changed in place. A write is a plan over one immutable state of the
table, so all legs of a batch see the same one; `sources.tables.Store` puts the
result in the table's place.

Conflicts fail rather than pick a row: an insert of a key that exists, and two new
rows for one key (a null in a key is equal to nothing). Rows given as dicts are
checked at once; what only the tables can tell fails when the plan runs.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conditions import condition
from ..plans.model import EntityDef
from .query import Database, Query, as_column, fresh


@dataclass
class Written:
    """after: the table's rows. affected: those inserted, updated or deleted, in the table's columns. kind: whether affected rows are new ones (insert, change) or old ones (delete)."""

    db: Database
    entity: EntityDef
    after: DataFrame
    affected: DataFrame
    kind: str = "change"

    def returning(self, shape: Callable | None = None) -> Query:
        """The affected rows as a query: projections may walk relations and collections."""
        alias = fresh(self.entity.name)
        e = self.entity
        df = self.affected.select(*[F.col(f"`{c.stored or p}`").alias(f"{alias}__{p}") for p, c in e.columns.items()])
        from .query import Frame, Row

        q = Query(Frame(self.db, df, {}), lambda fr: Row(fr, e, alias))
        return q.select(shape) if shape else q

    def affected_count(self) -> int:
        return self.affected.count()


class Writer:
    """Writes on one entity's table. base: its rows, by default those that the database reads."""

    def __init__(self, db: Database, entity: str, base: DataFrame | None = None):
        self.db, self.entity = db, db.model[entity]
        self.base = base if base is not None else db.raw_frame(entity)

    def _stored(self, name: str) -> str:
        """A property's column; an unmapped column is known by its own name."""
        c = self.entity.columns.get(name)
        return (c.stored if c else None) or name

    def _incoming(self, rows) -> DataFrame:
        """Rows (dicts or a DataFrame) in the table's columns; values of mapped columns are encoded."""
        if isinstance(rows, DataFrame):
            return rows
        fields = self.base.schema.fields
        encode = {self._stored(p): c.mapper.encode for p, c in self.entity.columns.items() if c.mapper}
        names = {p: self._stored(p) for p in self.entity.columns}
        given = [{names.get(k, k): v for k, v in r.items()} for r in rows]
        data = [tuple(encode[f.name](r[f.name]) if f.name in encode and r.get(f.name) is not None else r.get(f.name) for f in fields) for r in given]
        present = {f.name for f in fields} & {k for r in given for k in r}
        df = self.db.spark.createDataFrame(data, self.base.schema) if data else self.base.limit(0)
        return df.select(*[f.name for f in fields if f.name in present]) if data else df

    def _filled(self, rows: DataFrame) -> DataFrame:
        """All the table's columns: what rows lack is its default or null."""
        defaults = {self._stored(p): c.default for p, c in self.entity.columns.items()}
        return rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in self.base.schema.fields])

    def _key(self, key) -> list[str]:
        names = [key] if isinstance(key, str) else list(key or self.entity.key)
        return [self._stored(k) if k in self.entity.columns else k for k in names]

    def _result(self, after: DataFrame, affected: DataFrame, kind: str = "change") -> Written:
        return Written(self.db, self.entity, after, affected, kind)

    def _once(self, rows, new: DataFrame, key: list[str]) -> DataFrame:
        """new, which fails if two of its rows have one key."""
        if not key or any(k not in new.columns for k in key):
            return new
        if not isinstance(rows, DataFrame):
            names = {p: self._stored(p) for p in self.entity.columns}
            keys = [tuple(r.get(k) for k in key) for r in ({names.get(k, k): v for k, v in row.items()} for row in rows)]
            keys = [k for k in keys if None not in k]
            if len(set(keys)) < len(keys):
                raise KeyConflict(f"several new rows of {self.entity.name} have one key ({', '.join(key)})")
            return new
        return refused(new, new.groupBy(*key).count().where("count > 1").drop("count"), key, f"several new rows of {self.entity.name} have one key")

    # Inserts.

    def insert(self, row: dict) -> Written:
        return self.insert_bulk([row])

    def insert_bulk(self, rows, on_conflict_do_nothing=None) -> Written:
        new = self._filled(self._incoming(rows))
        if on_conflict_do_nothing is not None:
            key = self._key(on_conflict_do_nothing)
            some = functools.reduce(operator.or_, [F.col(f"`{k}`").isNull() for k in key])
            # Of several new rows with one key one is as good as another; a null in a key conflicts with nothing.
            new = new.where(~some).dropDuplicates(key).join(self.base.select(*key), key, "left_anti").select(*self.base.columns).unionByName(new.where(some))
        else:
            key = self._key(None)
            new = self._once(rows, new, key)
            if key:
                new = refused(new, self.base.select(*key), key, f"a new row of {self.entity.name} has a key that exists")
        return self._result(self.base.unionByName(new), new, "insert")

    def insert_numbered(self, rows, column: str) -> Written:
        """Rows that get consecutive numbers behind the highest in `column`, in the order given: each partition counts its own rows from where those before it end."""
        kind = self.base.schema[column].dataType
        place = self._incoming(rows).withColumn("_id", F.monotonically_increasing_id())
        place = place.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        # One row for each partition.
        sizes = place.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
        top = self.base.agg(F.coalesce(F.max(column), F.lit(0)).alias("_top"))
        numbered = place.join(F.broadcast(before), "_part").crossJoin(F.broadcast(top))
        new = self._filled(numbered.withColumn(column, (F.col("_top") + F.col("_before") + F.col("_at") + 1).cast(kind)).drop("_id", "_part", "_at", "_before", "_top"))
        return self._result(self.base.unionByName(new), new, "insert")

    def upsert_bulk(self, rows, key=None, update_columns=None, update_filter: Callable | None = None, target_where: Callable | None = None, set_where: Callable | None = None) -> Written:
        """Inserts rows; where the key exists, update_columns (all but the key) take the new values, nulls included.

        set_where(old, new) must hold for an update to happen.
        """
        key = self._key(key)
        new = self._once(rows, self._incoming(rows), key)
        columns = list(update_columns) if update_columns is not None else [c for c in new.columns if c not in key]
        if update_filter:
            columns = [c for c in columns if update_filter(c)]
        return self._merged(new, key, columns, set_where, target_where, insert=True)

    def merge_bulk(self, rows, on, match_where: Callable | None = None, update_columns=None, insert: bool = True) -> Written:
        """MERGE: rows that match on the columns `on` (and match_where(old, new)) are updated, others inserted. The table needs no unique key: a new row may update several."""
        key = self._key(on)
        new = self._once(rows, self._incoming(rows), key)
        columns = list(update_columns) if update_columns is not None else [c for c in new.columns if c not in key]
        return self._merged(new, key, columns, match_where, None, insert)

    def _merged(self, new: DataFrame, key, columns, set_where, target_where, insert: bool) -> Written:
        old = self.base.select(*[F.col(f"`{c}`").alias(f"o__{c}") for c in self.base.columns])
        fresh_rows = new.select(*[F.col(f"`{c}`").alias(f"n__{c}") for c in new.columns]).withColumn("n__there", F.lit(True))
        on = functools.reduce(operator.and_, [F.col(f"o__{k}") == F.col(f"n__{k}") for k in key])
        if target_where:
            on = on & target_where(Prefixed("o__"))
        both = old.withColumn("o__there", F.lit(True)).join(fresh_rows, on, "full" if insert else "left")
        hit = F.col("o__there").isNotNull() & F.col("n__there").isNotNull()
        if set_where:
            hit = hit & F.coalesce(set_where(Prefixed("o__"), Prefixed("n__")), F.lit(False))
        added = F.col("o__there").isNull()
        defaults = {self._stored(p): c.default for p, c in self.entity.columns.items()}

        def final(f) -> Column:
            given = F.col(f"n__{f.name}") if f.name in new.columns else F.lit(defaults.get(f.name))
            c = F.when(added, given.cast(f.dataType))
            if f.name in columns and f.name in new.columns:
                c = c.when(hit, F.col(f"n__{f.name}").cast(f.dataType))
            return c.otherwise(F.col(f"o__{f.name}")).alias(f.name)

        out = both.select(*[final(f) for f in self.base.schema.fields], (added | hit).alias("_hit"))
        return self._result(out.drop("_hit"), out.filter("_hit").drop("_hit"))

    def bulk_update(self, rows, key=None) -> Written:
        """Updates by key; each row changes only the columns that it names, and must name the key and at least one more."""
        key = self._key(key)
        if isinstance(rows, DataFrame):
            if not set(key) < set(rows.columns):
                raise ValueError("a bulk update needs the key and a column to change")
            return self._merged(self._once(rows, rows, key), key, [c for c in rows.columns if c not in key], None, None, insert=False)
        names = {p: self._stored(p) for p in self.entity.columns}
        fields = {f.name: f for f in self.base.schema.fields}
        encode = {self._stored(p): c.mapper.encode for p, c in self.entity.columns.items() if c.mapper}
        given = [{names.get(k, k): v for k, v in r.items()} for r in rows]
        for r in given:
            if any(r.get(k) is None for k in key):
                raise ValueError(f"a bulk update needs the key ({', '.join(key)}) in each row")
            if not set(r) - set(key):
                raise ValueError("a row of a bulk update changes nothing")
        if not given:
            return self._result(self.base, self.base.limit(0))
        used = [c for c in fields if any(c in r for r in given)]
        data = [(*(encode[c](r[c]) if c in encode and r.get(c) is not None else r.get(c) for c in used), sorted(set(r) - set(key))) for r in given]
        schema = T.StructType([T.StructField(c if c in key else f"n__{c}", fields[c].dataType) for c in used] + [T.StructField("_given", T.ArrayType(T.StringType()))])
        new = self._once(rows, self.db.spark.createDataFrame(data, schema), key)
        both = self.base.join(new, key, "left")
        hit = F.col("_given").isNotNull()
        change = [c for c in used if c not in key]
        out = both.select(*[F.when(hit & F.array_contains("_given", c), F.col(f"`n__{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c in change else F.col(f"`{c}`") for c in self.base.columns], hit.alias("_hit"))
        return self._result(out.drop("_hit"), out.filter("_hit").drop("_hit"))

    # Fluent update and delete: the test may walk relations.

    def _aliased(self, df: DataFrame) -> tuple[DataFrame, str, dict[str, str]]:
        """df with mapped columns under an alias, the alias, and the frame's name of each stored column; columns without a mapping keep theirs."""
        alias = fresh(self.entity.name)
        names = {c.stored or p: f"{alias}__{p}" for p, c in self.entity.columns.items()}
        names = {c: names.get(c, c) for c in self.base.columns}
        return df.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()], *[c for c in df.columns if c not in names]), alias, names

    def _split(self, test: Callable) -> tuple[DataFrame, DataFrame]:
        """(other rows, rows that pass). A test of own columns is a filter; one that walks relations gives the keys of the rows that pass, for a semi and an anti join."""
        from .query import Frame, Row, _filtered

        e = self.entity
        df, alias, names = self._aliased(self.base)
        f = Frame(self.db, df, {})
        got = test(Row(f, e, alias))
        back = [F.col(f"`{a}`").alias(c) for c, a in names.items()]
        if isinstance(got, Column) and f.df is df:
            hit = F.coalesce(got, F.lit(False))
            return df.filter(~hit).select(*back), df.filter(hit).select(*back)
        f = _filtered(Frame(self.db, df, {}), lambda fr: Row(fr, e, alias), test)
        # Without a key the whole row tells it, which equal rows share.
        key = self._key(None) or self.base.columns
        hits = f.df.select(*[F.col(f"`{names[k]}`").alias(f"_k{i}") for i, k in enumerate(key)]).distinct()
        on = functools.reduce(operator.and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)])
        return self.base.join(hits, on, "left_anti"), self.base.join(hits, on, "left_semi")

    def update(self, test: Callable, changes) -> Written:
        """Sets columns where test(row) holds. changes: a dict, or a function of the row that gives one. A reference without a partner gives nulls there, required or not; no row is lost."""
        if test is None:
            raise ValueError("an update needs a condition")
        from .query import Frame, Row

        kinds = {x.name: x.dataType for x in self.base.schema.fields}

        def changed(rows: DataFrame):
            df, alias, names = self._aliased(rows)
            f = Frame(self.db, df, {}, keep_rows=True)
            row = Row(f, self.entity, alias)
            got = changes(row) if callable(changes) else changes
            values = {self._stored(k): as_column(v).cast(kinds[self._stored(k)]) if self._stored(k) in kinds else None for k, v in got.items()}
            unknown = set(values) - set(kinds)
            if unknown:
                raise ValueError(f"{self.entity.name} has no column {', '.join(sorted(unknown))}")
            return f, df, row, names, values

        f, df, row, names, values = changed(self.base)
        passes = test(row)
        if f.df is df and isinstance(passes, Column) and f.df is df:
            # All of it reads the row's own columns: one pass.
            out = df.withColumn("_hit", F.coalesce(passes, F.lit(False)))
            out = out.select(*[(F.when(F.col("_hit"), values[c]).otherwise(F.col(f"`{a}`")) if c in values else F.col(f"`{a}`")).alias(c) for c, a in names.items()], "_hit")
            return self._result(out.drop("_hit"), out.filter("_hit").drop("_hit"))
        rest, hit = self._split(test)
        f, _, _, names, values = changed(hit)
        new = f.df.select(*[(values[c] if c in values else F.col(f"`{a}`")).alias(c) for c, a in names.items()])
        return self._result(rest.unionByName(new), new)

    def delete(self, test: Callable) -> Written:
        if test is None:
            raise ValueError("a delete needs a condition")
        rest, hit = self._split(test)
        return self._result(rest, hit, "delete")

    # Parents with children.

    def insert_with_children(self, rows, key: str, children: dict[str, tuple[str, list[list[dict]]]], unless_exists: Callable | None = None) -> dict[str, Written]:
        """Parents with generated keys, and for each child entity (its foreign key, a list of rows for each parent) rows that carry them. unless_exists: nothing happens if a row passes it."""
        rows = [rows] if isinstance(rows, dict) else list(rows)
        if unless_exists is not None and self.db.table(self.entity.name).where(unless_exists).exists():
            rows, children = [], {n: (fk, []) for n, (fk, _) in children.items()}
        stored = self._stored(key)
        top = self.base.agg(F.coalesce(F.max(stored), F.lit(0))).first()[0]
        numbered = [{**r, key: top + i + 1} for i, r in enumerate(rows)]
        out = {self.entity.name: self.insert_bulk(numbered)}
        for name, (fk, lists) in children.items():
            writer = Writer(self.db, name)
            own = [{**c, fk: numbered[i][key]} for i, cs in enumerate(lists) for c in cs]
            out[name] = writer.insert_bulk(own) if own else writer._result(writer.base, writer.base.limit(0))
        return out


class KeyConflict(ValueError):
    """Two rows would have one key."""


def refused(new: DataFrame, keys: DataFrame, key: list[str], message: str) -> DataFrame:
    """new, whose plan fails when it meets a row whose key is among keys."""
    there = keys.select(*[F.col(f"`{k}`").alias(f"_c{i}") for i, k in enumerate(key)], F.lit(True).alias("_there"))
    on = functools.reduce(operator.and_, [F.col(f"`{k}`") == F.col(f"_c{i}") for i, k in enumerate(key)])
    checked = new.join(there, on, "left").filter(F.when(F.col("_there"), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))
    return checked.select(*[F.col(f"`{c}`") for c in new.columns])


class Prefixed:
    def __init__(self, prefix: str):
        self._prefix = prefix

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return F.col(f"{self._prefix}{name}")


class MutationBatch:
    """Writes that all see the tables as they were: each leg is planned over the state from before the batch."""

    def __init__(self, db: Database):
        self.db, self.legs = db, {}

    def _add(self, name: str, written: Written | None) -> str | None:
        if written is None:
            return None
        self.legs[name] = written
        return name

    def add_insert_bulk(self, name: str, entity: str, rows, **options):
        return self._add(name, Writer(self.db, entity).insert_bulk(rows, **options) if len(rows) else None)

    def add_bulk_update(self, name: str, entity: str, rows, **options):
        return self._add(name, Writer(self.db, entity).bulk_update(rows, **options) if len(rows) else None)

    def add_upsert_bulk(self, name: str, entity: str, rows, **options):
        return self._add(name, Writer(self.db, entity).upsert_bulk(rows, **options) if len(rows) else None)

    def add_delete_where_in(self, name: str, entity: str, column: str, values):
        return self._add(name, Writer(self.db, entity).delete(lambda r: r[column].isin(list(values))) if len(values) else None)

    def add_update_where_in(self, name: str, entity: str, column: str, values, changes: dict):
        return self._add(name, Writer(self.db, entity).update(lambda r: r[column].isin(list(values)), changes) if len(values) else None)

    def add_dependent_insert(self, name: str, entity: str, parent: str, shape: Callable):
        """Rows made of another leg's affected rows."""
        rows = self.legs[parent].returning(shape).df()
        return self._add(name, Writer(self.db, entity).insert_bulk(rows))

    def add_insert_with_children(self, name: str, entity: str, rows, key: str, children: dict):
        for e, written in Writer(self.db, entity).insert_with_children(rows, key, children).items():
            self._add(f"{name}.{e}", written)
        return name

    def execute(self) -> dict[str, DataFrame]:
        """The affected rows of each leg."""
        return {k: w.affected for k, w in self.legs.items()}

    def states(self) -> dict[str, DataFrame]:
        """The rows of each table after all legs, whose changes are put together by key. Two legs that touch one row contradict each other: the plan fails."""
        out = {}
        for name in dict.fromkeys(w.entity.name for w in self.legs.values()):
            legs = [w for w in self.legs.values() if w.entity.name == name]
            if len(legs) == 1:
                out[name] = legs[0].after
                continue
            writer = Writer(self.db, name)
            key = writer._key(None)
            if not key:
                raise ValueError(f"legs on {name} can't be put together without a key")
            touched = functools.reduce(DataFrame.unionByName, [w.affected.withColumn("_gone", F.lit(w.kind == "delete")) for w in legs])
            touched = refused(touched, touched.groupBy(*key).count().where("count > 1"), key, f"several legs write one row of {name}")
            keys = touched.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(key)])
            on = functools.reduce(operator.and_, [F.col(f"`{k}`") == F.col(f"_k{i}") for i, k in enumerate(key)])
            out[name] = writer.base.join(keys, on, "left_anti").unionByName(touched.where("not _gone").drop("_gone"))
        return out

    def commit(self, store) -> dict[str, DataFrame]:
        """Puts the new states of all tables into the store together; gives them as they are read from it."""
        from ..sources.tables import Transaction

        states = {self.db.model[e].qualified: df for e, df in self.states().items()}
        with Transaction(store):
            for table, df in states.items():
                store.commit(table, df)
        return {table: store(table) for table in states}


def violations(db: Database, entity: str) -> DataFrame:
    """Rows that break a check of the entity, with the check's name."""
    e = db.model[entity]
    q = db.table(entity)
    out = None
    for name, test in e.checks.items():
        part = q.where(lambda r, t=test: ~F.coalesce(condition(t(r)), F.lit(True))).df().withColumn("violated", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else q.df().limit(0).withColumn("violated", F.lit(None).cast("string"))
