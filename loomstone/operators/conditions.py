"""Condition trees as predicates: must, should, must-not over leaves, compiled to columns that reach the scan.

A tree is a dict.  A group has any of ``must`` (all hold), ``should`` (one holds) and
``must_not`` (none holds), lists of trees.  A leaf is one of

* ``{"key": k, "match": {"value": v}}``, ``{"any": [...]}`` or ``{"except": [...]}``
* ``{"key": k, "range": {"gte": x, "gt": x, "lte": x, "lt": x}}``
* ``{"is_empty": k}`` (null, an empty list or an empty text) and ``{"has_id": [...]}``

An array has a value if one of its elements is it.  A missing value is in no match and
no range, and passes ``except``.  Values of another type than the column's are in it
nowhere; true is no number.  A condition of an unknown kind or column is an error, for
one that is passed over would widen the filter.

Negations are pushed down to the leaves, where they are written so that a missing value
keeps its meaning without a function around the column; so comparisons of plain
columns, negated ones too, become filters of a Parquet scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import UTC, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUP = {"must", "should", "must_not"}
BOUNDS = {"gte": lambda c, x: c >= x, "gt": lambda c, x: c > x, "lte": lambda c, x: c <= x, "lt": lambda c, x: c < x}
BELOW = {"gte": "lt", "gt": "lte", "lte": "gt", "lt": "gte"}


class ConditionError(ValueError):
    """A condition that cannot be compiled."""


def _all(parts: Sequence[Column], none: bool) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(none)


def _any(parts: Sequence[Column], none: bool) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(none)


def _fits(kind: T.DataType, value: Any) -> bool:
    if isinstance(kind, T.BooleanType):
        return isinstance(value, bool)
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    if isinstance(kind, T.NumericType):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and value == value
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return isinstance(value, datetime)
    return False


class Compiler:
    """Compiles trees over the columns of a schema."""

    def __init__(self, schema: T.StructType, id_col: str = "doc_id"):
        self.types, self.id_col = {f.name: f.dataType for f in schema.fields}, id_col

    def _kind(self, key: Any) -> T.DataType:
        if key not in self.types:
            raise ConditionError(f"no column {key!r}")
        return self.types[key]

    def compile(self, tree: Mapping[str, Any]) -> Column:
        return self._tree(tree, True)

    def _tree(self, tree: Any, holds: bool) -> Column:
        """A tree that has to hold, or one that must not."""
        if not isinstance(tree, Mapping):
            raise ConditionError(f"not a condition: {tree!r}")
        if tree.keys() <= GROUP:
            must = [self._tree(x, holds) for x in tree.get("must") or ()]
            must += [self._tree(x, not holds) for x in tree.get("must_not") or ()]
            if should := tree.get("should"):
                each = [self._tree(x, holds) for x in should]
                must.append(_any(each, False) if holds else _all(each, True))
            return _all(must, True) if holds else _any(must, False)
        leaves = {frozenset(("key", "match")): self._match, frozenset(("key", "range")): self._range, frozenset(("is_empty",)): self._empty, frozenset(("has_id",)): self._ids}
        if not (leaf := leaves.get(frozenset(tree))):
            raise ConditionError(f"unknown condition: {sorted(map(str, tree))}")
        return leaf(tree, holds)

    def _among(self, key: str, values: Sequence[Any], holds: bool) -> Column:
        """Whether the column has one of some values."""
        kind, c = self._kind(key), F.col(f"`{key}`")
        if isinstance(kind, T.ArrayType):
            own = [v for v in values if _fits(kind.elementType, v)]
            if not own:
                return F.lit(not holds)
            found = F.coalesce(F.exists(c, lambda x: F.coalesce(x.isin(*own), F.lit(False))), F.lit(False))
            return found if holds else ~found
        own = [v for v in values if _fits(kind, v)]
        if not own:
            return F.lit(not holds)
        found = c == own[0] if len(own) == 1 else c.isin(*own)
        return found if holds else c.isNull() | ~found

    def _match(self, tree: Mapping, holds: bool) -> Column:
        match = tree["match"]
        if not isinstance(match, Mapping) or len(match) != 1:
            raise ConditionError(f"not a match: {match!r}")
        (how, what), key = next(iter(match.items())), tree["key"]
        if how == "value":
            return self._among(key, [what], holds)
        if how not in ("any", "except") or isinstance(what, (str, bytes)) or not isinstance(what, Sequence):
            raise ConditionError(f"not a match: {match!r}")
        return self._among(key, what, holds if how == "any" else not holds)

    def _range(self, tree: Mapping, holds: bool) -> Column:
        kind, bounds, c = self._kind(tree["key"]), tree["range"], F.col(f"`{tree['key']}`")
        if not isinstance(bounds, Mapping) or not bounds.keys() <= BOUNDS.keys():
            raise ConditionError(f"not a range: {bounds!r}")
        own = {k: v for k, v in bounds.items() if v is not None}
        if not isinstance(kind, (T.NumericType, T.TimestampType, T.TimestampNTZType)) or not all(_fits(kind, v) for v in own.values()):
            return F.lit(not holds)
        odd = [F.isnan(c)] if isinstance(kind, (T.DoubleType, T.FloatType)) else []
        if holds:
            return _all([c.isNotNull(), *(~x for x in odd), *(BOUNDS[k](c, v) for k, v in own.items())], True)
        return _any([c.isNull(), *odd, *(BOUNDS[BELOW[k]](c, v) for k, v in own.items())], False)

    def _empty(self, tree: Mapping, holds: bool) -> Column:
        kind, c = self._kind(tree["is_empty"]), F.col(f"`{tree['is_empty']}`")
        if isinstance(kind, T.ArrayType):
            return c.isNull() | (F.size(c) == 0) if holds else c.isNotNull() & (F.size(c) > 0)
        if isinstance(kind, T.StringType):
            return c.isNull() | (c == "") if holds else c.isNotNull() & (c != "")
        return c.isNull() if holds else c.isNotNull()

    def _ids(self, tree: Mapping, holds: bool) -> Column:
        ids = tree["has_id"]
        if isinstance(ids, (str, bytes)) or not isinstance(ids, Sequence):
            raise ConditionError(f"not a list of ids: {ids!r}")
        return self._among(self.id_col, ids, holds)


def matching(docs: DataFrame, tree: Mapping[str, Any], id_col: str = "doc_id") -> DataFrame:
    """The rows for which a tree holds."""
    return docs.where(Compiler(docs.schema, id_col).compile(tree))


# --- arguments of a tool ----------------------------------------------------------------

#: Fixed: arguments that are lists, each with the column that it narrows.
LISTS = {"doc_types": "doc_type", "source_types": "source_type", "tags": "tags", "languages": "lang", "document_ids": "document_id"}
DATES = {"date_from": "gte", "date_to": "lte"}


def moment(value: Any) -> datetime | None:
    """An ISO date or time, in UTC where it names no zone; None where there is none to read."""
    try:
        found = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    except (ValueError, AttributeError):
        return None
    return found if found.tzinfo else found.replace(tzinfo=UTC)


def from_arguments(arguments: Mapping[str, Any], columns: Mapping[str, str] = LISTS, modified: str = "modified", section: str = "section", base: Mapping[str, Any] | None = None) -> dict[str, Any] | None:
    """The tree of a tool's arguments within that of its caller: a tool can only narrow what its caller may search.  None if neither asks for anything.

    Lists that are empty or no lists, dates that cannot be read and unknown names narrow nothing.
    """
    must: list[dict[str, Any]] = [dict(base)] if base else []
    for name, key in columns.items():
        value = arguments.get(name)
        if isinstance(value, (list, tuple)) and value:
            must.append({"key": key, "match": {"any": [str(x) for x in value]}})
    if isinstance(prefix := arguments.get("section_prefix"), str) and prefix:
        must.append({"key": section, "match": {"value": prefix}})
    bounds = {bound: at for name, bound in DATES.items() if (at := moment(arguments.get(name)))}
    if bounds:
        must.append({"key": modified, "range": bounds})
    return {"must": must} if must else None
