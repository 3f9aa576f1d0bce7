"""The tables of a release, from a build, and a former release as sets of inputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewise.operators import build, lineage
from grovewise.storage import Scratch

#: Columns of the tables, in the order in which they are written.
COLUMNS = {
    "inputs": ["input_id", "tip_id", "status", "component"],
    "tips": ["tip_id", "component", "n_inputs", "seen", "part"],
    "groups": ["group_id", "component", "n_components", "n_tips", "level_min", "level_max", "parent_id", "cohesion", "votes", "pull", "margin", "held", "stem", "stem_shards", "spread", "spread_median",
               "identity_min", "identity_median", "nearest_id", "nearest_distance", "second_id", "second_distance", "gap", "n_clade", "n_unresolved", "n_conflict", "n_whole", "kind", "height", "height_top", "measured_at"],
    "group_levels": ["group_id", "level", "cohesion", "votes", "pull", "margin", "held"],
    "group_members": ["group_id", "tip_id"],
    "membership": ["tip_id", "level", "group_id", "membership", "votes", "partners", "pull", "pull_target", "pull_votes"],
    "lineage": ["event", "group_id", "previous_id", "jaccard", "shared"],
    "minted": ["group_id", "release"],
}
_VERDICTS = ("n_clade", "n_unresolved", "n_conflict", "n_whole")


@dataclass
class Former:
    """A former release: ``groups(grp, input)`` and the ids ever given, ``minted(id, release)``."""

    groups: DataFrame
    minted: DataFrame


def group_inputs(group_members: DataFrame, inputs: DataFrame) -> DataFrame:
    """``grp``, ``input``: the inputs of all tips of each group.

    ``group_members(group_id, tip_id)``, ``inputs(input_id, tip_id)``; inputs without a tip are in no group."""
    known = inputs.filter(F.col("tip_id").isNotNull()).select("tip_id", F.col("input_id").alias("input"))
    return group_members.join(known, "tip_id").select(F.col("group_id").alias("grp"), "input").distinct()


def previous_groups(spark: SparkSession, path: str) -> Former:
    """A release written by ``write_release``."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Former(group_inputs(read("group_members"), read("inputs")), read("minted").select(F.col("group_id").alias("id"), "release"))


def status_of(classes: DataFrame, built_tips: DataFrame) -> DataFrame:
    """``inputs``: every input with its tip and whether it is ``built``, ``not_built`` or ``dropped:`` and its class.

    ``classes(input_id, class, tip_id, component)``, ``built_tips(tip)``."""
    done = built_tips.select(F.col("tip").alias("tip_id"), F.lit(True).alias("done")).distinct()
    full = F.when(F.col("done"), "built").otherwise("not_built")
    status = F.when(F.col("class") == "full", full).otherwise(F.concat(F.lit("dropped:"), "class"))
    return classes.join(done, "tip_id", "left").select("input_id", "tip_id", status.alias("status"), "component")


def release_tables(found: build.Built, classes: DataFrame, release: str, former: Former | None = None, identities: DataFrame | None = None, salt: str = "", verdicts: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a release of one build.

    ``classes(input_id, class, tip_id, component)``: every input. A group keeps the id of the former group that it
    continues, else it gets a new one. ``identities(grp, n_tips, identity_min, identity_median)`` and ``verdicts`` (``trees.tallied`` with ``n_tips``) are optional.
    Nodes of the linkage between levels are groups of kind ``node``.
    """
    scratch = Scratch(classes.sparkSession)
    cuts = found.tips.filter(F.col("grp").isNotNull())
    # a node is a name and a size; its members are those of its last level, or of the height it is measured at
    level_nodes = found.nodes.select("grp", "n_tips", F.lit("level").alias("kind"), "level_max")
    members = cuts.join(level_nodes.withColumnRenamed("level_max", "level"), ["grp", "level"]).select("grp", "n_tips", "kind", "tip")
    stems = found.stems.select(F.col("a").alias("grp"), F.col("size").alias("n_tips"), F.lit("node").alias("kind"), "measured_at")
    inner = _below(found, stems)
    members = members.unionByName(inner)
    key = F.concat_ws("|", F.col("grp").cast("string"), F.col("n_tips").cast("string")).alias("key")
    held = scratch.keep(members.select(key, F.col("tip").alias("tip_id")))
    home = classes.filter(F.col("tip_id").isNotNull()).select("input_id", "tip_id", "component").distinct()
    new = scratch.keep(held.join(home, "tip_id").select(F.col("key").alias("grp"), F.col("input_id").alias("input")).distinct())
    events = lineage.lineage(new, former.groups) if former else new.select(F.lit("born").alias("event"), "grp", F.lit(None).cast("string").alias("previous"), F.lit(None).cast("double").alias("jaccard"), F.lit(0).cast("bigint").alias("shared")).distinct()
    events = scratch.keep(events)
    kept = events.filter("event = 'continued'").select(F.col("grp").alias("key"), F.col("previous").alias("group_id"))
    fresh = lineage.minted(new.join(kept, new["grp"] == kept["key"], "left_anti"), former.minted if former else None, salt, scratch)
    ids = scratch.keep(kept.unionByName(fresh.select(F.col("grp").alias("key"), F.col("id").alias("group_id"))))
    before = former.minted if former else fresh.select("id", F.lit("").alias("release")).limit(0)
    named = lambda c, to: ids.select(F.col("key").alias(c), F.col("group_id").alias(to))

    at = cuts.groupBy("level", "grp").agg(F.count(F.lit(1)).alias("n_tips")).withColumn("key", key).join(ids, "key").select("level", "grp", "group_id")
    at = scratch.keep(at)
    levels = found.levels.join(at, ["level", "grp"])
    up = at.select(F.col("level").alias("above"), F.col("grp").alias("parent"), F.col("group_id").alias("parent_id"))
    steps = found.levels.select("level").distinct().select("level", F.col("level").alias("l"))
    steps = steps.join(steps.select(F.col("level").alias("above")), F.col("above") > F.col("l")).groupBy("level").agg(F.min("above").alias("above"))
    last = levels.join(steps, "level", "left").join(up, ["above", "parent"], "left").select("grp", F.col("level").alias("level_max"), "cohesion", "votes", "pull", "margin", "held", "parent_id")
    relative = lambda c: at.select(F.col("level").alias("level_max"), F.col("grp").alias(c), F.col("group_id").alias(f"{c}_id"))
    groups = found.nodes.withColumn("key", key).join(ids, "key").join(last, ["grp", "level_max"]).join(relative("nearest"), ["level_max", "nearest"], "left").join(relative("second"), ["level_max", "second"], "left").withColumn("kind", F.lit("level"))
    between = found.stems.withColumnRenamed("a", "grp").withColumnRenamed("size", "n_tips").withColumn("key", key).join(ids, "key").withColumn("kind", F.lit("node"))
    groups = groups.unionByName(between, allowMissingColumns=True)
    if identities is not None:
        groups = groups.join(identities, ["grp", "n_tips"], "left")
    if verdicts is not None:
        groups = groups.join(verdicts.select("grp", "n_tips", "stem", F.col("stem_n").alias("stem_shards"), *_VERDICTS), ["grp", "n_tips"], "left")
    places = held.join(home, "tip_id").groupBy("key").agg(F.count_distinct("component").alias("n_components"), F.min("component").alias("component"))
    groups = groups.join(places, "key").withColumn("component", F.when(F.col("n_components") == 1, F.col("component")))
    groups = groups.select(*(F.col(c) if c in groups.columns else F.lit(None).cast("bigint" if c in ("stem_shards", *_VERDICTS) else "double").alias(c) for c in COLUMNS["groups"]))

    inputs = status_of(classes, found.parts)
    n_inputs = home.groupBy("tip_id").agg(F.count_distinct("input_id").alias("n_inputs"), F.min("component").alias("component"))
    tips = found.parts.withColumnRenamed("tip", "tip_id").join(n_inputs, "tip_id", "left").select("tip_id", "component", F.coalesce("n_inputs", F.lit(0)).alias("n_inputs"), F.col("seen").cast("int").alias("seen"), "part")
    target = at.select("level", F.col("grp").cast("string").alias("target"), F.lit("group").alias("target_kind"), F.col("group_id").alias("target_id"))
    rows = found.tips.join(at, ["level", "grp"], "left").join(target, ["level", "target_kind", "target"], "left")
    return {
        "inputs": inputs.select(*COLUMNS["inputs"]),
        "tips": tips,
        "groups": groups,
        "group_levels": levels.select(*COLUMNS["group_levels"]),
        "group_members": held.join(ids, "key").select(*COLUMNS["group_members"]),
        "membership": rows.select(F.col("tip").alias("tip_id"), "level", "group_id", "membership", "votes", "partners", "pull", F.coalesce("target_id", "target").alias("pull_target"), "pull_votes"),
        "lineage": events.join(named("grp", "group_id"), "grp", "left").select("event", "group_id", F.col("previous").alias("previous_id"), "jaccard", "shared"),
        "minted": lineage.registry(before, fresh.select("id"), release).withColumnRenamed("id", "group_id"),
    }


def _below(found: build.Built, stems: DataFrame) -> DataFrame:
    """The tips of each stem node: those whose cluster it holds at the height it is measured at."""
    points = sorted(r[0] for r in stems.select("measured_at").distinct().collect())  # multiples of the grid
    if not points:
        return stems.select("grp", "n_tips", "kind", F.col("grp").alias("tip")).limit(0)
    at = build.linkage.cut(found.merges, found.parts.select("tip"), points).withColumnRenamed("level", "measured_at")
    return stems.join(at, ["measured_at", "grp"]).select("grp", "n_tips", "kind", "tip")


def regions(components: DataFrame, hits: DataFrame, large: int = 150, nearest: int = 150, context: int = 30) -> tuple[DataFrame, DataFrame]:
    """Components with what their covers draw on.

    ``components(tip, component)``, ``hits(query, target, identity)``. First table: ``component``, ``n_tips``,
    ``kind`` (``large`` from ``large`` tips on, ``small``, ``lone``). Second: ``component``, ``query``, ``target``, ``identity``,
    ``own``: the neighbours of each tip of a component with two tips or more, inside a large one only its own
    tips; tips of a small one also draw on up to ``nearest`` - 1 + ``context`` of all tips, which are its context where
    they aren't its own.
    """
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n_tips"))
    kinds = sizes.withColumn("kind", F.when(F.col("n_tips") >= large, "large").when(F.col("n_tips") >= 2, "small").otherwise("lone"))
    of = components.join(kinds, "component").filter(F.col("kind") != "lone")
    near = hits.join(of.select(F.col("tip").alias("query"), "component", "kind"), "query").join(components.select(F.col("tip").alias("target"), F.col("component").alias("other")), "target", "left")
    near = near.withColumn("own", F.coalesce(F.col("component") == F.col("other"), F.lit(False))).filter((F.col("query") != F.col("target")) & (F.col("own") | (F.col("kind") == "small")))
    wide, narrow = near.filter("kind = 'small'"), near.filter("kind = 'large'")
    kept = ["component", "query", "target", "identity", "own"]
    first = build.layers.top_per_key(wide.select(*kept), ["component", "query"], [("identity", "descending"), ("target", "descending")], nearest - 1 + context)
    return kinds, first.select(*kept).unionByName(narrow.select(*kept))

