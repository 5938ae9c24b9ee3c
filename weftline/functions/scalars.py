"""Scalar functions: arithmetic, bit flags, JSON, search."""

from __future__ import annotations

import functools
import operator
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .conditions import stored, value


def _fold(op, parts) -> Column:
    first = next((p for p in parts if isinstance(p, Column) and p.__dict__.get("_mapper")), None)
    return functools.reduce(op, [stored(value(p, first)) for p in parts])


def add(*parts) -> Column:
    return _fold(operator.add, parts)


def sub(a, b) -> Column:
    return _fold(operator.sub, (a, b))


def mul(*parts) -> Column:
    return _fold(operator.mul, parts)


def div(a, b) -> Column:
    """Division of fractions; raises on zero."""
    return _fold(operator.truediv, (a, b))


def int_div(a, b) -> Column:
    """Division of integers, truncated; raises on zero."""
    return _truncated(stored(value(a, b)), stored(value(b, a)))


def _truncated(a: Column, b: Column) -> Column:
    # Exact for integers: what is left over is taken off before dividing.
    return ((a - a % b) / b).cast("long")


def coalesce(*parts) -> Column:
    first = next((p for p in parts if isinstance(p, Column)), None)
    return F.coalesce(*[stored(value(p, first)) for p in parts])


def flag_has(c, mask: int) -> Column:
    return stored(c).bitwiseAND(value(mask)) != 0


flag_has_any = flag_has


def flag_has_all(c, mask: int) -> Column:
    return stored(c).bitwiseAND(value(mask)) == value(mask)


def flag_has_none(c, mask: int) -> Column:
    return stored(c).bitwiseAND(value(mask)) == 0


def flag_set(c, mask: int) -> Column:
    return stored(c).bitwiseOR(value(mask))


def flag_unset(c, mask: int) -> Column:
    return stored(c).bitwiseAND(F.bitwise_not(value(mask)))


# JSON columns are strings.


def json_select(c, key: str) -> Column:
    """A property as JSON text; a value that is itself JSON in a string is opened."""
    c = stored(c)
    inner = F.get_json_object(c, "$")
    return F.coalesce(F.get_json_object(c, f"$.{key}"), F.get_json_object(inner, f"$.{key}"))


def json_select_text(c, key: str) -> Column:
    return F.get_json_object(stored(c), f"$.{key}")


def json_merge(target, patch) -> Column:
    """Shallow merge in which the patch wins; a null target is empty."""
    patch = F.lit(patch) if isinstance(patch, str) else patch
    opened = lambda c: F.from_json(c, "map<string,variant>")
    t, p = opened(F.coalesce(stored(target), F.lit("{}"))), opened(patch)
    return F.to_json(F.map_concat(F.map_filter(t, lambda k, _: ~F.array_contains(F.map_keys(p), k)), p))


def json_array_some(c, test) -> Column:
    """Whether test holds for an element of a JSON array; test gets a reader of the element's paths as text."""
    items = F.from_json(stored(c), "array<variant>")
    return F.coalesce(F.exists(items, lambda e: test(Element(F.to_json(e)))), F.lit(False))


class Element:
    """An element of a JSON array: element.a.b is the text at that path."""

    def __init__(self, text: Column, path: str = "$"):
        self._text, self._path = text, path

    def __getattr__(self, name: str) -> Element:
        return Element(self._text, f"{self._path}.{name}")

    @property
    def as_text(self) -> Column:
        return F.get_json_object(self._text, self._path)

    def __eq__(self, other) -> Column:
        return self.as_text == json_unwrap(other)

    __hash__ = None


def json_unwrap(v) -> str:
    """A literal as the text that JSON paths compare with."""
    return "true" if v is True else "false" if v is False else str(v)


# Search: lower case without accents.


@functools.lru_cache
def accents() -> tuple[str, str]:
    """Letters with accents, and what each is without, from Unicode decompositions of the Latin, Greek and Cyrillic blocks."""
    pairs = {}
    for n in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(n)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(n):
            pairs[chr(n)] = plain
    pairs |= dict(zip("øØłŁđĐħıŧ", "oOlLdDhit", strict=True))
    return "".join(pairs), "".join(pairs.values())


# Letters that stand for two.
TWO_LETTERS = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ĳ": "ij", "Ĳ": "IJ", "ŉ": "'n", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl"}


def search_normalize(v) -> Column:
    text = stored(value(v)).cast("string")
    plain = F.translate(text, *accents())
    several = plain
    for one, two in TWO_LETTERS.items():
        several = F.replace(several, F.lit(one), F.lit(two))
    # Texts of ASCII letters only have a byte for each; others mostly lack the letters that become two.
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.lower(F.when(ascii_only, text).when(~plain.rlike(f"[{''.join(TWO_LETTERS)}]"), plain).otherwise(several))


def normalized_eq(c, v) -> Column:
    return search_normalize(c) == search_normalize(v)


def normalized_like(c, pattern) -> Column:
    return F.like(search_normalize(c), search_normalize(pattern))


def normalized_starts_with(c, v) -> Column:
    return search_normalize(c).startswith(search_normalize(v))


def array_of(*items) -> Column:
    """An array of literals or columns."""
    return F.array(*[stored(value(x)) for x in items])


def contains_search(s: str) -> str:
    return f"%{s}%"


def starts_with_search(s: str) -> str:
    return f"{s}%"


def ends_with_search(s: str) -> str:
    return f"%{s}"
