"""Catalog tables of a model: creation, removal, comparison and migration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import TWO_LETTERS, accents
from .model import EntityDef, Model


@dataclass(frozen=True)
class Operation:
    """kind: create_table, drop_column, add_column or change_type."""

    kind: str
    table: str
    column: str | None = None
    type: str | None = None


class SchemaManager:
    def __init__(self, spark: SparkSession, model: Model):
        self.spark, self.model = spark, model

    def _create(self, e: EntityDef) -> None:
        if e.schema_name:
            self.spark.sql(f"create schema if not exists `{e.schema_name}`")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' not null'}" for f in e.struct())
        parts = ""
        if e.partitioning:
            names = ", ".join(f"`{c}`" for c in e.partitioning["columns"])
            parts = f" clustered by ({names}) into 16 buckets" if e.partitioning["strategy"] == "hash" else f" partitioned by ({names})"
        self.spark.sql(f"create table if not exists {e.qualified} ({columns}) using parquet{parts}")

    def ensure_created(self) -> None:
        for name, v in self.model.settings.items():
            self.spark.conf.set(name, v)
        for e in self.model.entities.values():
            self._create(e)

    def ensure_deleted(self) -> None:
        for e in self.model.entities.values():
            self.spark.sql(f"drop table if exists {e.qualified}")

    def analyze(self) -> list[Operation]:
        """What must change in the catalog for it to match the model."""
        out = []
        for e in self.model.entities.values():
            if not self.spark.catalog.tableExists(e.qualified):
                out.append(Operation("create_table", e.qualified))
                continue
            have = {f.name: f.dataType.simpleString() for f in self.spark.table(e.qualified).schema}
            want = {f.name: f.dataType.simpleString() for f in e.struct()}
            out += [Operation("add_column", e.qualified, c, t) for c, t in want.items() if c not in have]
            out += [Operation("drop_column", e.qualified, c) for c in have if c not in want]
            out += [Operation("change_type", e.qualified, c, t) for c, t in want.items() if have.get(c, t) != t]
        return out

    def migrate(self) -> list[Operation]:
        """Applies what a file table allows: new tables and new columns. Others are returned as not applied."""
        left = []
        for o in self.analyze():
            if o.kind == "create_table":
                self._create(next(e for e in self.model.entities.values() if e.qualified == o.table))
            elif o.kind == "add_column":
                self.spark.sql(f"alter table {o.table} add columns (`{o.column}` {o.type})")
            else:
                left.append(o)
        return left

    def scaffold(self) -> str:
        """Python text of a migration step that would bring the catalog to the model: what analyze finds, as SQL to read before it is run."""
        types = {e.qualified: {f.name: f.dataType.simpleString() for f in e.struct()} for e in self.model.entities.values()}
        up, down = [], []
        for o in self.analyze():
            if o.kind == "create_table":
                up.append(f"create table {o.table} ({', '.join(f'`{c}` {t}' for c, t in types[o.table].items())}) using parquet")
                down.append(f"drop table {o.table}")
            elif o.kind == "add_column":
                up.append(f"alter table {o.table} add columns (`{o.column}` {o.type})")
                down.append(f"alter table {o.table} drop column `{o.column}`")
            elif o.kind == "drop_column":
                up.append(f"alter table {o.table} drop column `{o.column}`")
            else:
                up.append(f"alter table {o.table} alter column `{o.column}` type {o.type}")
        body = lambda lines: "".join(f"    spark.sql({x!r})\n" for x in lines) or "    pass\n"
        return f"def up(spark):\n{body(up)}\n\ndef down(spark):\n{body(reversed(down))}"

    def compute_statistics(self) -> None:
        for e in self.model.entities.values():
            for _, columns in e.statistics:
                self.spark.sql(f"analyze table {e.qualified} compute statistics for columns {', '.join(columns)}")

    def use_search_normalize(self) -> None:
        """Makes search_normalize(text) known to SQL."""
        marked, plain = accents()
        text = f"translate(s, '{marked}', '{plain}')"
        for one, two in TWO_LETTERS.items():
            text = f"""replace({text}, '{one}', "{two}")"""
        self.spark.sql(f"create or replace temporary function search_normalize(s string) returns string return lower({text})")

    def columns(self, entity: str) -> list[dict]:
        e = self.model[entity]
        return [{"property": p, "column": c.stored or p, "type": c.type.simpleString(), "required": c.required, "key": p in e.key} for p, c in e.columns.items()]

    def column_keys(self, entity: str) -> list[str]:
        return list(self.model[entity].columns)


def validated(e: EntityDef, df: DataFrame) -> list[str]:
    """How a table's columns differ from the declaration."""
    have = {f.name: f.dataType for f in df.schema}
    out = []
    for p, c in e.columns.items():
        name = c.stored or p
        if name not in have:
            out.append(f"{name} is missing")
        elif have[name] != c.type:
            out.append(f"{name} is {have[name].simpleString()}, not {c.type.simpleString()}")
    return out


def outside_enum(e: EntityDef, df: DataFrame) -> DataFrame:
    """Rows with a value that an enumerated column does not have."""
    bad = F.lit(False)
    for p, c in e.columns.items():
        if c.values:
            bad = bad | (F.col(c.stored or p).isNotNull() & ~F.col(c.stored or p).isin(*c.values))
    return df.filter(bad)


def enum_order(values: tuple[str, ...], column) -> object:
    """An enumeration's place, to sort by declaration order."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), column)


class Migrations:
    """Named steps, applied once each and noted in a journal table."""

    def __init__(self, spark: SparkSession, journal: str = "weftline_migrations"):
        self.spark, self.journal = spark, journal
        self.steps: list[tuple[str, Callable, Callable | None]] = []
        spark.sql(f"create table if not exists {journal} (name string, direction string, at timestamp) using parquet")

    def add(self, name: str, up: Callable, down: Callable | None = None) -> None:
        self.steps.append((name, up, down))

    def applied(self) -> list[str]:
        rows = self.spark.sql(f"select name, max_by(direction, at) d from {self.journal} group by name").collect()
        done = {r["name"] for r in rows if r["d"] == "up"}
        return [n for n, _, _ in self.steps if n in done]

    def _note(self, name: str, direction: str) -> None:
        self.spark.sql(f"insert into {self.journal} select '{name}', '{direction}', current_timestamp()")

    def status(self) -> list[tuple[str, bool]]:
        """Each step, and whether it is applied."""
        done = set(self.applied())
        return [(n, n in done) for n, _, _ in self.steps]

    def up(self) -> list[str]:
        done, ran = set(self.applied()), []
        for name, up, _ in self.steps:
            if name not in done:
                up(self.spark)
                self._note(name, "up")
                ran.append(name)
        return ran

    def down(self) -> str | None:
        done = self.applied()
        if not done:
            return None
        name, _, down = next(s for s in self.steps if s[0] == done[-1])
        if down is None:
            raise ValueError(f"{name} can't be undone")
        down(self.spark)
        self._note(name, "down")
        return name
