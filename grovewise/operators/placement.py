"""Late partial records placed into an existing hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.functions import records


def candidates(hits: DataFrame, home: DataFrame, queries: DataFrame, built: DataFrame) -> DataFrame:
    """Best reference of each query, its component, and what can be done with it.

    ``hits(query, target, identity)``, ``home(target, component)``, ``queries(query)``, ``built(component)``.
    All targets tied at the best identity count, those without a component too (together they count as one
    that isn't built); the smallest is the candidate. Status: ``no_match``, ``spans_components``,
    ``not_built`` or ``job``.
    """
    known = hits.filter(F.col("identity").isNotNull()).join(home, "target", "left")
    best = known.groupBy("query").agg(F.max("identity").alias("identity"))
    n_components = F.count_distinct("component") + F.max(F.col("component").isNull().cast("int"))
    tied = known.join(best, ["query", "identity"]).groupBy("query", "identity").agg(F.min("target").alias("candidate"), F.min("component").alias("component"), n_components.alias("n_components"))
    whole = queries.select("query").distinct().join(tied, "query", "left").join(built.select("component").distinct().withColumn("is_built", F.lit(True)), "component", "left")
    status = F.when(F.col("candidate").isNull(), "no_match").when(F.col("n_components") > 1, "spans_components").when(F.col("is_built").isNull(), "not_built").otherwise("job")
    return whole.select("query", "candidate", "identity", F.when(F.col("n_components") == 1, F.col("component")).alias("component"), status.alias("status"))


def reduced(results: DataFrame) -> DataFrame:
    """Median join of each query with each member over the shards, in DOUBLE, and number of shards.

    ``results(query, shard, member, height)``."""
    low = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY height)")
    high = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY height DESC)")
    each = results.groupBy("query", "member").agg(low.alias("low"), high.alias("high"), F.count(F.lit(1)).alias("n_shards"))
    return each.select("query", "member", ((F.col("low") + F.col("high")) / 2).alias("height"), "n_shards")


def assigned(joins: DataFrame, group_at: DataFrame) -> DataFrame:
    """The finest level at which a query belongs to a group.

    ``joins(query, member, height)``, ``group_at(level, member, grp)``. At each level the group with the
    smallest mean join to its co-sampled members is tested (ties: smaller id); the first level at which
    the mean is within the level wins. Result: query, level, grp, mean, n; null where none does.
    """
    scaled = F.round(F.col("height").cast("double") * float(1 << 40)).cast("decimal(38,0)")
    means = joins.join(group_at.filter(F.col("grp").isNotNull()), "member").groupBy("query", "level", "grp").agg((F.sum(scaled).cast("double") / F.count(F.lit(1)) / float(1 << 40)).alias("mean"), F.count(F.lit(1)).alias("n"))
    best = means.groupBy("query", "level").agg(F.min(F.struct("mean", "grp", "n")).alias("b"))
    within = best.filter(F.col("b.mean") <= F.col("level")).groupBy("query").agg(F.min(F.struct("level", "b")).alias("f"))
    return joins.select("query").distinct().join(within, "query", "left").select("query", F.col("f.level").alias("level"), F.col("f.b.grp").alias("grp"), F.col("f.b.mean").alias("mean"), F.col("f.b.n").alias("n"))


def ancestors(group_at: DataFrame) -> DataFrame:
    """``level``, ``grp``, ``above``, ``up``: the one group that holds all members of a group at a coarser level, null for none.

    ``group_at(level, member, grp)`` with rows for ungrouped members too."""
    own = group_at.filter(F.col("grp").isNotNull()).select("level", "grp", "member")
    later = group_at.select(F.col("level").alias("above"), "member", F.col("grp").alias("up"))
    pairs = own.join(later, "member").filter(F.col("above") >= F.col("level"))
    lost = F.max(F.col("up").isNull())
    told = pairs.groupBy("level", "grp", "above").agg(F.min("up").alias("up"), (F.min("up").eqNullSafe(F.max("up")) & ~lost).alias("one"))
    return told.select("level", "grp", "above", F.when(F.col("one"), F.col("up")).alias("up"))


def placed(planned: DataFrame, results: DataFrame, group_at: DataFrame) -> DataFrame:
    """Rows of placed queries (A28): query, status (``placed`` or ``ungrouped``), level, grp, join, shards, rearranged.

    ``planned(query, shard)`` are the jobs; ``results(query, shard, joins map<string,double>, moved)`` must be these,
    each once. ``join`` is the mean join with the group, rounded to 5; ``rearranged`` counts shards whose tree changed.
    """
    exactly_once(planned, results, ["query", "shard"])
    joins = results.select("query", "shard", F.explode_outer("joins").alias("member", "height"))
    told = assigned(reduced(joins.filter(F.col("member").isNotNull())), group_at)
    each = results.groupBy("query").agg(F.count(F.lit(1)).alias("shards"), F.count_if("moved").alias("rearranged"))
    whole = each.join(told, "query", "left")
    status = F.when(F.col("grp").isNotNull(), "placed").otherwise("ungrouped").alias("status")
    return whole.select("query", status, "level", "grp", records.rounded(F.col("mean"), 5).alias("join"), "shards", "rearranged")


def jobs(candidates: DataFrame, central: DataFrame) -> DataFrame:
    """``query``, ``component``, ``shard``: each query with a job meets the central shards of its candidate.

    ``candidates(query, candidate, component, status)``, ``central(tip, shard)``."""
    wanted = candidates.filter(F.col("status") == "job").select("query", "component", F.col("candidate").alias("tip"))
    return wanted.join(central.select("tip", "shard").distinct(), "tip").select("query", "component", "shard").distinct()


def tied(hits: DataFrame) -> DataFrame:
    """Every target tied at a query's best identity (A29): query, target, identity."""
    known = hits.filter(F.col("identity").isNotNull()).select("query", "target", "identity").distinct()
    best = known.groupBy("query").agg(F.max("identity").alias("identity"))
    return known.join(best, ["query", "identity"]).select("query", "target", "identity")


def exactly_once(planned: DataFrame, results: DataFrame, keys: list[str]) -> None:
    """Refuse results that aren't the planned jobs, each once."""
    missing = planned.select(*keys).distinct().join(results.select(*keys), keys, "left_anti")
    extra = results.select(*keys).join(planned.select(*keys), keys, "left_anti")
    double = results.groupBy(*keys).count().filter(F.col("count") > 1)
    for what, rows in (("missing", missing), ("not planned", extra), ("given twice", double)):
        found = rows.limit(5).collect()
        if found:
            raise ValueError(f"results {what}: {[tuple(r)[: len(keys)] for r in found]}")
