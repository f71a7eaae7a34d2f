"""Weights and sort orders of looked-up items. Weights are Columns, so they are computed once and before the sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Weight by kind of element; others weigh 0. Fixed values.
KIND_WEIGHTS = {"local": 1000, "parameter": 950, "field": 800, "method": 700, "type": 600, "package": 400, "module": 300}
#: Weights of an equal, a case-sensitive and a case-insensitive prefix match. Fixed values.
EQUAL, PREFIX, PREFIX_ANY_CASE = 200, 100, 50
#: Priorities of what can be constructed: concrete, unknown, abstract, interface; and what others lose. Fixed values.
CONCRETE, UNKNOWN, ABSTRACT, INTERFACE, NOT_EXPECTED = 110, 95, 90, 80, 10
#: Priorities when nothing is expected: concrete, abstract or missing, interface. Fixed values.
PLAIN_CONCRETE, PLAIN_ABSTRACT, PLAIN_INTERFACE = 10, 0, -10
#: Class access flags, as in the class file format.
IS_INTERFACE, IS_ABSTRACT, IS_PUBLIC = 0x200, 0x400, 0x1


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def exact_prefix_weight(lookup, typed: str) -> Column:
    n = _c(lookup)
    if not typed:
        return F.lit(0)
    return F.when(n == typed, EQUAL).when(n.startswith(typed), PREFIX).when(F.lower(n).startswith(typed.lower()), PREFIX_ANY_CASE).otherwise(0)


def kind_weight(kind) -> Column:
    out = F.lit(0)
    for k, w in KIND_WEIGHTS.items():
        out = F.when(_c(kind) == k, w).otherwise(out)
    return out


def construction_priority(flags, expected) -> Column:
    """For places where a type is to be constructed; flags null: unknown."""
    f = _c(flags)
    p = F.when(f.isNull(), UNKNOWN).when(f.bitwiseAND(F.lit(IS_INTERFACE)) != 0, INTERFACE).when(f.bitwiseAND(F.lit(IS_ABSTRACT)) != 0, ABSTRACT).otherwise(CONCRETE)
    return p - F.when(F.coalesce(_c(expected), F.lit(False)), 0).otherwise(NOT_EXPECTED)


def plain_priority(flags) -> Column:
    f = _c(flags)
    return F.when(f.isNull(), PLAIN_ABSTRACT).when(f.bitwiseAND(F.lit(IS_INTERFACE)) != 0, PLAIN_INTERFACE).when(f.bitwiseAND(F.lit(IS_ABSTRACT)) != 0, PLAIN_ABSTRACT).otherwise(PLAIN_CONCRETE)


def order(weights: dict[str, Column] | None = None, lookup: str = "lookup", priority: str = "priority", tie: str = "ordinal") -> list[Column]:
    """Sort keys: the first weight, priority, the other weights in order, all descending; then the name in lower case.

    Equal items keep their ordinal's order. Without weights: priority, then name.
    """
    w = [c.desc() for c in (weights or {}).values()]
    return [*w[:1], F.col(priority).desc(), *w[1:], F.lower(F.col(lookup)).asc(), F.col(tie).asc()]


def rank(items: DataFrame, typed: str, limit: int | None = None, extra: dict[str, Column] | None = None, tie: str = "ordinal") -> DataFrame:
    """items (lookup, priority, kind, ordinal) in order; with a limit this plans as one top-k, not a full sort."""
    w = {"exact_prefix": exact_prefix_weight("lookup", typed), "kind_weight": kind_weight("kind"), **(extra or {})}
    out = items.withColumns(w)
    out = out.orderBy(*order({k: F.col(k) for k in w}, tie=tie))
    return out.limit(limit) if limit is not None else out


def enrich(items: DataFrame, stubs: DataFrame, key: str = "name") -> DataFrame:
    """items with flags and the plain priority of the stub of that name; items without one keep null flags."""
    return items.join(stubs.select(key, "flags"), key, "left").withColumn("priority", plain_priority("flags"))


def constructor_needs_arguments(methods) -> Column:
    """A public constructor exists and none of them is without arguments. methods: array<struct<name,descriptor,access_flags>>."""
    ctor = lambda m: (m["name"] == "<init>") & (m["access_flags"].bitwiseAND(F.lit(IS_PUBLIC)) != 0)
    return F.exists(_c(methods), ctor) & ~F.exists(_c(methods), lambda m: ctor(m) & m["descriptor"].startswith("()"))


def members(stubs: DataFrame, typed: str, want_static: bool) -> DataFrame:
    """Members of stubs (name, methods) that fit: no constructors, accessible, static or not, name near what was typed."""
    from ..functions.text import SCOPE_SCORE, fuzzy_token_set

    m = stubs.select("name", F.explode("methods").alias("m")).where("m.name not in ('<init>', '<clinit>')")
    m = m.where((F.col("m.access_flags").bitwiseAND(F.lit(IS_PUBLIC)) != 0) & ((F.col("m.access_flags").bitwiseAND(F.lit(8)) != 0) == F.lit(want_static)))
    if typed and not typed.endswith("."):
        m = m.where(fuzzy_token_set(F.substring_index("m.name", "(", 1), F.lit(typed)) >= SCOPE_SCORE)
    return m.select("name", F.col("m.name").alias("member"), F.col("m.descriptor").alias("descriptor"))


def overloads(members_: DataFrame) -> DataFrame:
    """(name, member, descriptors): methods of one name together, sorted."""
    return members_.groupBy("name", "member").agg(F.array_sort(F.collect_list("descriptor")).alias("descriptors"))


def queue_head(queue: DataFrame, limit: int, current: str | None = None) -> DataFrame:
    """The next paths of a queue (path, ordinal) without the one being worked on."""
    q = queue if current is None else queue.where(F.col("path") != current)
    return q.orderBy("ordinal").limit(limit)
