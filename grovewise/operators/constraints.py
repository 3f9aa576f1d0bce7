"""Checks that refuse a whole table instead of mending it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovewise.functions import records


class BadInput(ValueError):
    """Rows that break a rule; the message quotes the first five."""


def refuse(rows: DataFrame, why: str) -> None:
    found = rows.limit(5).collect()
    if found:
        raise BadInput(f"{why}: {[tuple(r) for r in found]}")


def unique(df: DataFrame, keys: list[str], why: str = "repeated key") -> None:
    """Each key once."""
    refuse(df.groupBy(*keys).count().filter(F.col("count") > 1), why)


def content_keyed(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The table, if every key is the content id of its cleaned sequence and none is repeated."""
    clean = df.select(F.col(key), records.cleaned(F.col(seq)).alias("seq"))
    refuse(clean.filter(~F.col(key).eqNullSafe(records.content_id(F.col("seq")))).select(key), "id isn't the content's")
    unique(clean, [key])
    return df


def one_content(df: DataFrame, key: str, seq: str) -> None:
    """No two contents under one short id: a collision is refused, never merged."""
    spread = df.groupBy(key).agg(F.min(seq).alias("a"), F.max(seq).alias("b")).filter(F.col("a") != F.col("b"))
    refuse(spread.select(key), "two contents under one id")


def holds(df: DataFrame, rule: Column, why: str) -> None:
    """A rule for every row; null counts as broken."""
    refuse(df.filter(~F.coalesce(rule, F.lit(False))), why)


def same_rows(a: DataFrame, b: DataFrame, why: str = "tables differ") -> None:
    """Equal as bags of rows."""
    refuse(a.exceptAll(b).unionAll(b.exceptAll(a)), why)


def all_present(planned: DataFrame, made: DataFrame, keys: list[str], why: str = "missing") -> None:
    """Everything planned is there."""
    refuse(planned.select(*keys).join(made.select(*keys), keys, "left_anti"), why)


def nested(levels: DataFrame) -> None:
    """Groups of a level are unions of groups of the finer one: no finer group lies in two coarser.

    ``levels(k, tip, grp)`` with k numbering levels from fine to coarse.
    """
    a = levels.filter(F.col("grp").isNotNull()).select("k", "tip", "grp")
    b = levels.select((F.col("k") - 1).alias("k"), "tip", F.col("grp").alias("parent"))
    split = a.join(b, ["k", "tip"]).groupBy("k", "grp").agg(F.count_distinct("parent").alias("n"), F.count_if(F.col("parent").isNull()).alias("lost"))
    refuse(split.filter((F.col("n") > 1) | (F.col("lost") > 0)), "a group isn't within one coarser group")


def within_one(rows: DataFrame, inner: str, outer: str) -> None:
    """Each unit lies in one component."""
    refuse(rows.groupBy(inner).agg(F.min(outer).alias("a"), F.max(outer).alias("b")).filter(F.col("a") != F.col("b")), f"a {inner} spans more than one {outer}")


def fresh(products: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted products that are not there yet; stale ones are refused.

    ``wanted(product, key, tips)`` and ``products(product, key, tips)``, tips as sorted arrays. A product that is
    there without a key, with another key or with other tips was made from something else: nothing is reused
    or overwritten, the first five are named. Null ``tips`` in ``wanted`` are not compared.
    """
    there = products.select("product", F.col("key").alias("made_of"), F.col("tips").alias("made_tips"), F.lit(True).alias("there"))
    both = wanted.join(there, "product", "left")
    found = both.filter(F.col("there"))
    refuse(found.filter(F.col("made_of").isNull()).select("product"), "products without a key")
    refuse(found.filter(F.col("made_of") != F.col("key")).select("product", "made_of", "key"), "products made from other inputs or settings")
    refuse(found.filter(F.col("tips").isNotNull() & ~F.col("tips").eqNullSafe(F.col("made_tips"))).select("product"), "products with other tips than asked for")
    return both.filter(F.col("there").isNull()).select(*wanted.columns)


def single_units(top_groups: DataFrame, unit_of: DataFrame, component_of: DataFrame) -> None:
    """Every unit is one group at the top of its component or a lone tip, and lies in one component.

    ``top_groups(tip, grp)``, ``unit_of(tip, unit)``, ``component_of(tip, component)``; every tip needs a unit."""
    each = component_of.join(unit_of, "tip", "left").join(top_groups.filter(F.col("grp").isNotNull()), "tip", "left")
    refuse(each.filter(F.col("unit").isNull()).select("tip"), "tips without a unit")
    within_one(each, "unit", "component")
    units = each.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("grp").alias("groups"), F.count("grp").alias("grouped"), F.min("grp").alias("grp"))
    refuse(units.filter(~((F.col("groups") == 1) & (F.col("grouped") == F.col("n"))) & ~((F.col("n") == 1) & (F.col("grouped") == 0))).select("unit"), "units that are no group")
    sizes = top_groups.filter(F.col("grp").isNotNull()).groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    refuse(units.filter(F.col("grouped") > 0).join(sizes, "grp").filter(F.col("size") != F.col("n")).select("unit"), "units that are part of a group")
