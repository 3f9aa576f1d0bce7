"""Which groups of one release continue groups of another, and new ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.functions import records
from grovewise.storage import Scratch


def lineage(new: DataFrame, old: DataFrame) -> DataFrame:
    """Events between two sets of groups by shared inputs.

    ``new`` and ``old`` have ``grp`` and ``input``. Only inputs in any group of both count. A group
    inherits iff both are each other's best match (greatest Jaccard, then fewest inputs outside, then the
    greatest id) with a Jaccard above 1/2. Result: event (``continued``, ``born``, ``retired``), grp,
    previous, jaccard, shared.
    """
    a, b = new.select("grp", "input").distinct(), old.select("grp", "input").distinct()
    a_in = a.join(b.select("input").distinct(), "input", "left_semi").select(F.col("grp").alias("n"), "input")
    b_in = b.join(a.select("input").distinct(), "input", "left_semi").select(F.col("grp").alias("o"), "input")
    n_size = a_in.groupBy("n").agg(F.count(F.lit(1)).alias("n_common"))
    o_size = b_in.groupBy("o").agg(F.count(F.lit(1)).alias("o_common"))
    n_all = a.groupBy(F.col("grp").alias("n")).agg(F.count(F.lit(1)).alias("n_all"))
    o_all = b.groupBy(F.col("grp").alias("o")).agg(F.count(F.lit(1)).alias("o_all"))
    shared = a_in.join(b_in, "input").groupBy("n", "o").agg(F.count(F.lit(1)).alias("shared")).join(n_size, "n").join(o_size, "o").join(n_all, "n").join(o_all, "o")
    shared = shared.withColumn("jaccard", F.col("shared") / (F.col("n_common") + F.col("o_common") - F.col("shared")))
    best = lambda key, other, extra: shared.groupBy(key).agg(F.max(F.struct("jaccard", (-extra).alias("extra"), F.col(other).alias("id"), "shared")).alias("m"))
    for_new = best("n", "o", F.col("o_all") - F.col("o_common")).select("n", F.col("m.id").alias("o"), F.col("m.jaccard").alias("jaccard"), F.col("m.shared").alias("shared"))
    for_old = best("o", "n", F.col("n_all") - F.col("n_common")).select("o", F.col("m.id").alias("n"), F.col("m.jaccard").alias("jaccard"), F.col("m.shared").alias("shared"))
    heirs = for_new.join(for_old.select("o", "n"), ["n", "o"]).filter(F.col("jaccard") > 0.5)
    continued = heirs.select(F.lit("continued").alias("event"), F.col("n").alias("grp"), F.col("o").alias("previous"), "jaccard", "shared")
    born = n_all.join(heirs, "n", "left_anti").join(for_new, "n", "left").select(F.lit("born").alias("event"), F.col("n").alias("grp"), F.col("o").alias("previous"), "jaccard", F.coalesce("shared", F.lit(0)).alias("shared"))
    retired = o_all.join(heirs, "o", "left_anti").join(for_old, "o", "left").select(F.lit("retired").alias("event"), F.col("n").alias("grp"), F.col("o").alias("previous"), "jaccard", F.coalesce("shared", F.lit(0)).alias("shared"))
    return continued.unionByName(born).unionByName(retired)


def minted(groups: DataFrame, taken: DataFrame | None = None, salt: str = "", scratch: Scratch | None = None) -> DataFrame:
    """A new id for each group from its inputs, whatever their order (A38, P13): ``grp``, ``id``.

    ``groups(grp, input)``, ``taken(id)`` all ids ever given. The id is the first eight digits, in base 32, of a
    hash of ``salt`` and the group's content; where it is taken, or goes to a group that comes before (by
    smallest input, then size, then name), it is one digit longer, and so on until every group has one.
    The content is the sum of the inputs' hashes and their number, so no group's inputs are gathered.
    """
    scratch = scratch or Scratch(groups.sparkSession)
    text = F.col("input").cast("string")
    digest = [F.sum(F.conv(F.substring(F.sha2(text, 256), at, 12), 16, 10).cast("decimal(38,0)")) for at in (1, 13, 25)]
    keyed = groups.select("grp", "input").distinct().groupBy("grp").agg(
        F.concat_ws(":", *(d.cast("string") for d in digest), F.count(F.lit(1)).cast("string")).alias("content"), F.struct(F.min("input"), F.count(F.lit(1)), "grp").alias("turn"),
    )
    rest = scratch.keep(keyed)
    used = scratch.keep(taken.select("id").distinct()) if taken is not None else None
    done: list[DataFrame] = []
    for digits in range(8, 52):
        drawn = rest.withColumn("id", records.short_id(F.concat_ws("|", F.lit(salt), "content"), digits))
        free = drawn if used is None else drawn.join(used, "id", "left_anti")
        first = scratch.keep(free.groupBy("id").agg(F.min("turn").alias("turn")).select(F.col("turn.grp").alias("grp"), "id"))
        done.append(first)
        rest = scratch.keep(rest.join(first.select("grp"), "grp", "left_anti"))
        if rest.isEmpty():
            return reduce(DataFrame.unionAll, done)
    raise ValueError("groups with equal content can't all have an id")


def registry(before: DataFrame, new: DataFrame, release: str) -> DataFrame:
    """All ids ever given with their release: those of ``before(id, release)`` and ``new(id)`` (U9). An id stays
    with the release that gave it first."""
    fresh = new.select("id").distinct().join(before.select("id"), "id", "left_anti").select("id", F.lit(release).alias("release"))
    return before.select("id", "release").unionByName(fresh)


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, one row (A39): 1 for fewer than two items or where it is degenerate."""
    cells = labels.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda df: df.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0)).alias("p"))
    rows = [cells.groupBy(k).agg(F.sum("n").alias("n")) for k in ("a", "b")]
    index, of_a, of_b = pairs(cells), pairs(rows[0]).withColumnRenamed("p", "pa"), pairs(rows[1]).withColumnRenamed("p", "pb")
    n = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    one = index.crossJoin(of_a).crossJoin(of_b).crossJoin(n)  # one row each
    x, pa, pb, total = (F.col(c).cast("double") for c in ("p", "pa", "pb", "n"))
    chance = pa * pb / F.nullif(total * (total - 1), F.lit(0.0))
    return one.select(F.coalesce((x - chance) / F.nullif((pa + pb) / 2 - chance, F.lit(0.0)), F.lit(1.0)).alias("adjusted_rand"))
