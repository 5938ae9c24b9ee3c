"""Declared entities: columns, keys, and the relations that queries walk along."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Mapper:
    """How a column's stored value and its value in queries correspond: both directions as expressions, literals by `encode`."""

    decode: Callable[[Column], Column]
    encode: Callable[[object], object] = lambda v: v


@dataclass(frozen=True)
class ColumnDef:
    """A property's column. stored: its name in the table, where that differs."""

    type: T.DataType
    stored: str | None = None
    required: bool = False
    unique: bool = False
    default: object = None
    mapper: Mapper | None = None
    values: tuple[str, ...] | None = None  # of an enumeration, in order
    generated: bool = False

    def but(self, **changes) -> ColumnDef:
        return ColumnDef(**{**self.__dict__, **changes})


def _of(kind: T.DataType) -> Callable[..., ColumnDef]:
    return lambda **options: ColumnDef(kind, **options)


integer, bigint, smallint = _of(T.IntegerType()), _of(T.LongType()), _of(T.ShortType())
real, double = _of(T.FloatType()), _of(T.DoubleType())
text, uuid, json, interval_text = _of(T.StringType()), _of(T.StringType()), _of(T.StringType()), _of(T.StringType())
boolean, date, binary = _of(T.BooleanType()), _of(T.DateType()), _of(T.BinaryType())
timestamp, timestamptz = _of(T.TimestampNTZType()), _of(T.TimestampType())
#: Microseconds of the day.
time = _of(T.LongType())
money = _of(T.DecimalType(19, 2))
point = _of(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def serial(**options) -> ColumnDef:
    return ColumnDef(T.IntegerType(), generated=True, **options)


def bigserial(**options) -> ColumnDef:
    return ColumnDef(T.LongType(), generated=True, **options)


def decimal(precision: int = 38, scale: int = 18, **options) -> ColumnDef:
    return ColumnDef(T.DecimalType(precision, scale), **options)


def varchar(length: int, **options) -> ColumnDef:
    return ColumnDef(T.StringType(), **options)


char = varchar


def enum(*values: str, **options) -> ColumnDef:
    return ColumnDef(T.StringType(), values=values, **options)


def array(of: ColumnDef, **options) -> ColumnDef:
    return ColumnDef(T.ArrayType(of.type), **options)


def vector(size: int, **options) -> ColumnDef:
    return ColumnDef(T.ArrayType(T.FloatType()), **options)


def collated(name: str, **options) -> ColumnDef:
    return ColumnDef(T.StringType(name), **options)


def custom(stored: ColumnDef, mapper: Mapper) -> ColumnDef:
    return stored.but(mapper=mapper)


#: Whole seconds since the start of 2025, as a timestamp.
EPOCH_2025 = 1735689600
int_datetime = Mapper(lambda c: F.timestamp_seconds(c + EPOCH_2025), lambda v: int(v.timestamp()) - EPOCH_2025 if hasattr(v, "timestamp") else v)
#: Minute of the day, as hour and minute.
minute_of_day = Mapper(
    lambda c: F.struct((c / 60).cast("int").alias("hour"), (c % 60).cast("int").alias("minute")),
    lambda v: v["hour"] * 60 + v["minute"] if isinstance(v, dict) else v,
)


@dataclass(frozen=True)
class Relation:
    """An edge to `target`. pairs: own column or literal, with the target's column or literal."""

    name: str
    target: str
    pairs: tuple[tuple[object, object], ...]
    many: bool
    required: bool = False


@dataclass(frozen=True)
class Literal:
    """A constant in a key."""

    value: object


@dataclass
class EntityDef:
    name: str
    table: str
    columns: dict[str, ColumnDef]
    key: tuple[str, ...] = ()
    relations: dict[str, Relation] = field(default_factory=dict)
    indexes: list[dict] = field(default_factory=list)
    statistics: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    checks: dict[str, Callable] = field(default_factory=dict)
    partitioning: dict | None = None
    schema_name: str | None = None

    def to_table(self, table: str) -> EntityDef:
        self.table = table
        return self

    def to_schema(self, schema: str) -> EntityDef:
        self.schema_name = schema
        return self

    def prop(self, name: str, column: ColumnDef) -> EntityDef:
        self.columns[name] = column
        return self

    def _relate(self, name, target, own, theirs, many, required) -> EntityDef:
        own, theirs = [x if isinstance(x, list | tuple) else [x] for x in (own, theirs)]
        self.relations[name] = Relation(name, target, tuple(zip(own, theirs, strict=True)), many, required)
        return self

    def has_one(self, name: str, target: str, own, theirs, required: bool = False) -> EntityDef:
        """N:1: own columns (or Literals) equal the target's."""
        return self._relate(name, target, own, theirs, False, required)

    def has_many(self, name: str, target: str, own, theirs) -> EntityDef:
        """1:N."""
        return self._relate(name, target, own, theirs, True, False)

    def has_index(self, name: str, columns, **options) -> EntityDef:
        """Recorded only: the engine has no indexes."""
        self.indexes.append({"name": name, "columns": tuple(columns), **options})
        return self

    def has_statistics(self, name: str, columns) -> EntityDef:
        self.statistics.append((name, tuple(columns)))
        return self

    def has_check(self, name: str, condition: Callable) -> EntityDef:
        self.checks[name] = condition
        return self

    def has_partitioning(self, strategy: str, columns) -> EntityDef:
        if not set(columns) <= set(self.key or columns):
            raise ValueError("partitioning columns must be part of the key")
        self.partitioning = {"strategy": strategy, "columns": tuple(columns)}
        return self

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.stored or p, c.type, not c.required) for p, c in self.columns.items()])

    @property
    def qualified(self) -> str:
        return f"{self.schema_name}.{self.table}" if self.schema_name else self.table


class Model:
    """The registry of entities."""

    def __init__(self):
        self.entities: dict[str, EntityDef] = {}
        self.sequences: dict[str, Sequence] = {}
        self.settings: dict[str, str] = {}
        self.schema_name: str | None = None

    def entity(self, name: str, key=(), /, **columns: ColumnDef) -> EntityDef:
        key = (key,) if isinstance(key, str) else tuple(key)
        self.entities[name] = e = EntityDef(name, name, dict(columns), key, schema_name=self.schema_name)
        return e

    def sequence(self, name: str, start: int = 1, step: int = 1) -> Sequence:
        return self.sequences.setdefault(name, Sequence(name, start, step))

    def has_setting(self, name: str, value: str) -> Model:
        self.settings[name] = value
        return self

    def __getitem__(self, name: str) -> EntityDef:
        return self.entities[name]


class Sequence:
    """A counter on the driver: it hands out blocks of keys, so that a whole batch of rows takes one step."""

    def __init__(self, name: str, start: int = 1, step: int = 1):
        self.name, self.step, self._next, self._last = name, step, start, None

    def next_value(self) -> int:
        self._last, self._next = self._next, self._next + self.step
        return self._last

    def current_value(self) -> int:
        if self._last is None:
            raise RuntimeError(f"{self.name} has given no value yet")
        return self._last

    def take(self, n: int) -> int:
        """The first of n values."""
        first = self._next
        self._next += n * self.step
        self._last = self._next - self.step
        return first

    def resync(self, highest: int | None) -> None:
        if highest is not None:
            self._next = highest + self.step
