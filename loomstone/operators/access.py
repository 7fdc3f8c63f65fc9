"""Access control and facets as predicates.

A missing list is an empty one: arrays are made non-null before they are tested, for
a null would drop the row under NOT.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listed(name: str | Column) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.coalesce(c, F.array().cast("array<string>"))


def unrestricted() -> Column:
    return (F.size(listed("allowed_groups")) == 0) & (F.size(listed("allowed_roles")) == 0) & (F.size(listed("allowed_users")) == 0)


def acl_filter(tenant: Column, user: Column, roles: Column, groups: Column, clearance: Column, include_deleted: bool = False) -> Column:
    """The predicate of what a caller may read: tenant, not deleted, within clearance, not denied, and granted."""
    granted = F.array_contains(listed("allowed_users"), user) | unrestricted() | F.arrays_overlap(listed("allowed_groups"), listed(groups)) | F.arrays_overlap(listed("allowed_roles"), listed(roles))
    out = (F.col("tenant_id") == tenant) & (F.col("classification_rank") <= clearance) & ~F.array_contains(listed("denied_users"), user) & granted
    return out if include_deleted else out & ~F.coalesce(F.col("is_deleted"), F.lit(False))


def permits(tenant: Column, user: Column, roles: Column, groups: Column, clearance: Column) -> Column:
    """The same rule written as a decision, to be held against acl_filter; deletion is no part of it."""
    has = lambda a, b: F.size(F.array_intersect(listed(a), listed(b))) > 0
    return (
        F.when(F.col("tenant_id") != tenant, False)
        .when(F.col("classification_rank") > clearance, False)
        .when(F.size(F.filter(listed("denied_users"), lambda x: x == user)) > 0, False)
        .when(F.size(F.concat(listed("allowed_groups"), listed("allowed_roles"), listed("allowed_users"))) == 0, True)
        .when(F.exists(listed("allowed_users"), lambda x: x == user), True)
        .otherwise(has("allowed_groups", groups) | has("allowed_roles", roles))
    )


def visible(corpus: DataFrame, principals: DataFrame, include_deleted: bool = False) -> DataFrame:
    """(corpus row, principal) for each row a principal may read: an equi-join by tenant, the rest of the rule beside it.

    Principals are callers of one batch; Spark broadcasts them by their size.
    """
    rule = acl_filter(F.col("tenant"), F.col("user"), F.col("roles"), F.col("groups"), F.col("clearance"), include_deleted)
    return corpus.join(principals, rule)


@dataclass(frozen=True)
class Facets:
    """A facet filter: any-of lists, an inclusive time range, a ceiling; ``nothing`` matches no row."""

    doc_types: tuple[str, ...] = ()
    langs: tuple[str, ...] = ()
    document_ids: tuple[int, ...] = ()
    modified_from: int | None = None
    modified_to: int | None = None
    max_rank: int | None = None
    nothing: bool = field(default=False)

    def column(self) -> Column:
        if self.nothing:
            return F.lit(False)
        out = F.lit(True)
        for name, values in (("doc_type", self.doc_types), ("lang", self.langs), ("doc_id", self.document_ids)):
            if values:
                out &= F.col(name).isin(*values)
        if self.modified_from is not None:
            out &= F.col("modified") >= self.modified_from
        if self.modified_to is not None:
            out &= F.col("modified") <= self.modified_to
        return out if self.max_rank is None else out & (F.col("classification_rank") <= self.max_rank)

    def __and__(self, other: Facets) -> Facets:
        """Both at once: lists intersect, ranges narrow, and an empty intersection matches nothing."""
        nothing, lists = self.nothing or other.nothing, []
        for a, b in ((self.doc_types, other.doc_types), (self.langs, other.langs), (self.document_ids, other.document_ids)):
            both = tuple(x for x in a if x in b) if a and b else a or b
            nothing |= bool(a and b and not both)
            lists.append(both)
        pick = lambda f, a, b: f(x for x in (a, b) if x is not None) if a is not None or b is not None else None
        return Facets(*lists, pick(max, self.modified_from, other.modified_from), pick(min, self.modified_to, other.modified_to), pick(min, self.max_rank, other.max_rank), nothing)

    def filled_by(self, other: Facets) -> Facets:
        """The caller's facets, with those of ``other`` where there are none; an inverted range is left out."""
        low, high = (self.modified_from, self.modified_to) if self.modified_from is not None or self.modified_to is not None else (other.modified_from, other.modified_to)
        if low is not None and high is not None and low > high:
            low, high = self.modified_from, self.modified_to
        return Facets(self.doc_types or other.doc_types, self.langs or other.langs, self.document_ids or other.document_ids, low, high, self.max_rank, self.nothing)


def effective_at(start: str, end: str, moment: Column) -> Column:
    """start <= moment < end, where a missing bound is open."""
    return (F.col(start).isNull() | (F.col(start) <= moment)) & (F.col(end).isNull() | (moment < F.col(end)))


def merge_acl(item: str = "item", base: str = "base") -> list[Column]:
    """Access lists of an item with its source's defaults, never wider: grants come whole from one side, denials add up."""
    own = [listed(f"{item}_{x}") for x in ("groups", "roles", "users")]
    free = F.size(F.concat(*own)) == 0
    out = [F.when(free, listed(f"{base}_{x}")).otherwise(c).alias(x) for x, c in zip(("groups", "roles", "users"), own, strict=True)]
    return [*out, F.array_sort(F.array_union(listed(f"{item}_denied"), listed(f"{base}_denied"))).alias("denied"), F.greatest(f"{item}_rank", f"{base}_rank").alias("rank")]


def parse_list(raw: Column) -> Column:
    """Identifiers of a JSON array or of a text split at comma, semicolon or bar: trimmed, distinct, in order."""
    json = F.from_json(raw, "array<string>")
    parts = F.when(F.trim(raw).startswith("["), json).otherwise(F.split(raw, "[,;|]"))
    return F.array_distinct(F.filter(F.transform(listed(parts), lambda x: F.trim(x)), lambda x: x != ""))


def acl_fingerprint() -> Column:
    """SHA-256 of the access lists, sorted, with the tenant and the rank."""
    parts = [F.concat_ws(",", F.array_sort(listed(x))) for x in ("allowed_groups", "allowed_roles", "allowed_users", "denied_users")]
    return F.sha2(F.concat_ws("|", "tenant_id", *parts, F.col("classification_rank").cast("string")), 256)


#: Fixed: names under which a map of metadata may declare the groups of an item, best first.
GROUP_NAMES = ("allowed_groups", "groups", "acl_groups")


def from_map(found: Column, names: tuple[str, ...] = GROUP_NAMES) -> Column:
    """The groups that a map declares under the first of some names that it has; null if none."""
    raw = F.coalesce(*(F.try_element_at(found, F.lit(k)) for k in names))
    return F.when(raw.isNotNull(), parse_list(raw))


def from_sidecar(raw: Column, name: str = "allowed_groups") -> Column:
    """The groups of a sidecar file of JSON, each once; null where it does not parse or declares none."""
    return F.array_distinct(F.from_json(raw, f"`{name}` array<string>")[name])


def from_metadata(tags: Column, metadata: Column, names: tuple[str, ...] = GROUP_NAMES) -> Column:
    """What an item's tags declare, else its metadata."""
    return F.coalesce(from_map(tags, names), from_map(metadata, names))


#: Fixed: the shape of a permission object, and the reach of a link that opens an item to everybody.
PERMISSION, EVERYBODY = "array<struct<group:string,user:string,scope:string>>", "organization"


def from_permissions(raw: Column) -> Column:
    """Grants of permission objects: groups and users by id, numbers refused; a link for the whole organisation leaves none, which is no restriction."""
    p = F.from_json(raw, PERMISSION)
    ids = F.filter(F.transform(p, lambda x: F.coalesce(x["group"], x["user"])), lambda x: x.isNotNull() & ~x.rlike("^[0-9]+$"))
    return F.when(F.exists(p, lambda x: F.coalesce(x["scope"], F.lit("")) == EVERYBODY), F.array().cast("array<string>")).otherwise(ids)


def resolved(*sources: Column, default: tuple[str, ...] = ()) -> Column:
    """The first source that declares groups, best first, else the default."""
    last = F.array(*map(F.lit, default)).cast("array<string>")
    return F.coalesce(*(F.when(F.size(c) > 0, c) for c in sources), last)


def filter_fingerprint(facets: Facets, tenant: Column, clearance: Column, version: int = 1) -> Column:
    """A short hash of what decides a search's rows, equal for equal filters in any order."""
    named = (("doc_type", facets.doc_types), ("lang", facets.langs), ("doc_id", facets.document_ids))
    parts = [f"{k}={','.join(sorted(map(str, v)))}" for k, v in named if v]
    parts += [f"{k}={v}" for k, v in (("from", facets.modified_from), ("to", facets.modified_to), ("rank", facets.max_rank)) if v is not None] + ["nothing"] * facets.nothing
    return F.substring(F.sha2(F.concat_ws("|", F.lit(str(version)), tenant, clearance.cast("string"), *map(F.lit, parts)), 256), 1, 32)
