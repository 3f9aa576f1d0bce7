"""Queries of the grouping operators over the given tables, with their SQL.

Votes: the shard is an order, its tips the order's suppliers, a vote the distance of two suppliers'
discounts in it, and a tip's group its supplier's nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewise.functions import ids, records
from grovewise.operators import build, covers, graph, layers, linkage, numbering, placement, votes
from grovewise.operators import lineage as lines
from grovewise.operators.dereplicate import dereplicate, summary
from grovewise.operators.hotkeys import top_per_key
from grovewise.plans.tables import table
from grovewise.sources import release
from grovewise.storage import Scratch

LEVELS = [0.0, 0.01, 0.02, 0.05]
CUTS = [0.02, 0.03, 0.04]


def _shard_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("shard"), F.col("l_suppkey").alias("tip"), "l_discount")
    return rows.repartition("shard").groupBy("shard", "tip").agg(F.min("l_discount").alias("x"))  # the rows of a shard meet once


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.pair_votes(_shard_tips(spark, sf_dir), "shard", "tip", "x")


def _group_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with a negative balance have no group."""
    supplier = table(spark, sf_dir, "supplier")
    grp = F.when(F.col("s_acctbal") >= 0, F.col("s_nationkey"))
    return supplier.select(F.explode(F.array(*(F.lit(x) for x in LEVELS))).alias("level"), F.col("s_suppkey").alias("tip"), grp.alias("grp"))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = votes.consensus(_votes(spark, sf_dir), LEVELS)
    return votes.with_groups(votes.at_levels(pairs, LEVELS), _group_of(spark, sf_dir))


def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by content."""
    return dereplicate(table(spark, sf_dir, "documents"), "text", "doc_id")


def input_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, empty ones, distinct contents."""
    return summary(table(spark, sf_dir, "documents"), "text")


def pair_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and number of votes of each pair."""
    return votes.consensus(_votes(spark, sf_dir), LEVELS).select("i", "j", "med", "votes")


def votes_at_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and votes of each pair at each level."""
    return votes.at_levels(votes.consensus(_votes(spark, sf_dir), LEVELS), LEVELS)


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return votes.membership(_grouped(spark, sf_dir))


def cohesion_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, A14."""
    return votes.cohesion(_grouped(spark, sf_dir), _group_of(spark, sf_dir))


def tip_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target that pulls each supplier most."""
    return votes.tip_pull(_grouped(spark, sf_dir))


def group_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohesion, pull and margin of each group."""
    grouped = _grouped(spark, sf_dir)
    inner = votes.cohesion(grouped, _group_of(spark, sf_dir))
    pull = votes.group_pull(votes.tip_pull(grouped))
    whole = inner.join(pull, ["level", "grp"], "left")
    return whole.select("level", "grp", "cohesion", F.coalesce("pull", F.lit(0.0)).alias("pull"), records.margin(F.col("cohesion"), F.coalesce("pull", F.lit(0.0))).alias("margin"))


def level_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, tips in groups, largest group, tenth percentile of held, by level."""
    inner = votes.cohesion(_grouped(spark, sf_dir), _group_of(spark, sf_dir))
    return inner.groupBy("level").agg(F.count(F.lit(1)).alias("groups"), F.sum("n_tips").alias("tips_in_groups"), F.max("n_tips").alias("largest"), F.percentile("held", F.lit(0.1)).alias("held_10"))


def separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22, W4."""
    pairs = votes.consensus(_votes(spark, sf_dir), LEVELS).select("i", "j", F.col("med").alias("d"))
    groups = _group_of(spark, sf_dir).filter(F.col("level") == 0.0)
    return votes.separation(pairs, groups)


def unit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus of units (groups and lone tips), pairs of at least 3 votes."""
    unit_of = layers.units(_group_of(spark, sf_dir).filter(F.col("level") == 0.0))
    pairs = votes.consensus(layers.unit_votes(_votes(spark, sf_dir), unit_of), LEVELS)
    return layers.enough(pairs, 3).select("i", "j", "med", "votes")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    knn = table(spark, sf_dir, "knn")
    percent = F.when(F.col("identity") <= 1, F.col("identity") * 100).otherwise(F.col("identity"))
    rows = knn.select(ids.tip_id(F.col("query")).alias("query"), ids.tip_id(F.col("target")).alias("target"), percent.alias("identity"))
    known = rows.filter(F.col("query").isNotNull() & F.col("target").isNotNull() & (F.col("query") != F.col("target")))
    return known.groupBy("query", "target").agg(F.max("identity").alias("identity"))


def knn_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar targets of each query."""
    return graph.neighbours(_hits(spark, sf_dir).filter(F.col("identity").isNotNull()), 5)


def _knn_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tip of the search, found or not."""
    tips = table(spark, sf_dir, "knn").select(F.explode(F.array(ids.tip_id(F.col("query")), ids.tip_id(F.col("target")))).alias("tip"))
    return tips.filter(F.col("tip").isNotNull()).distinct()


def _home(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong = _hits(spark, sf_dir).filter(F.col("identity") >= 86)
    vertices = _knn_tips(spark, sf_dir).withColumnRenamed("tip", "v")
    return graph.components(strong.select(F.col("query").alias("a"), F.col("target").alias("b")), vertices=vertices).withColumnRenamed("v", "tip")


def component_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of tips linked at 86 percent, lone ones too; the member hit most often stands for each."""
    hit = _hits(spark, sf_dir).groupBy(F.col("target").alias("tip")).agg(F.count(F.lit(1)).alias("copies"))
    members = _home(spark, sf_dir).join(hit, "tip", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    return graph.anchors(members, "component", "tip", "copies")


def outgroups_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13, W6."""
    return layers.outgroups(_hits(spark, sf_dir), _home(spark, sf_dir))


def scaffold_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to thirty tips of each component with the most copies."""
    return layers.scaffold(table(spark, sf_dir, "scaffold"), "component", "tip_id", "copies")


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ids.tip_lists(table(spark, sf_dir, "manifest"), ["plan_id", "component", "cover", "shard"], ["members", "context"])
    return rows.withColumn("component", ids.component_id(F.col("component"))).filter(F.size("members") > 0)


def coverage_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tip of the search, found or not, and of the shards, by the distinct shards that hold it."""
    shards = _shards(spark, sf_dir).select("plan_id", F.sort_array(F.array_distinct("members")).alias("members")).distinct()
    held = Scratch(spark).keep(shards.select(F.explode("members").alias("tip")).groupBy("tip").agg(F.count(F.lit(1)).alias("n_shards")))
    tips = _knn_tips(spark, sf_dir).unionAll(held.select("tip")).distinct()
    return covers.accounted(held, _hits(spark, sf_dir), tips, 3)


def twin_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9."""
    return covers.twins(_shards(spark, sf_dir))


def distinct_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10, U8."""
    return covers.distinct_inputs(_shards(spark, sf_dir))


def central_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three shards of each cover in which a tip stands first."""
    return covers.central_shards(_shards(spark, sf_dir))


def hash_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cover of the tips of the search by shards of up to 150, three deep, with 30 members below 97 percent where there are."""
    near = _hits(spark, sf_dir).filter(F.col("identity").isNotNull()).withColumn("component", F.lit("all"))
    return covers.hash_cover(near, 150, 3, quota=30).select("cover", "seed", F.array_join("members", ",").alias("members"), "n")


def sparse_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards that draw one tip from each of 150 groups of a component, 24 votes a pair on average."""
    groups = table(spark, sf_dir, "groups").select(ids.group_id(F.col("group_id")).alias("unit"), ids.component_id(F.col("component")).alias("component")).dropna().distinct()
    members = table(spark, sf_dir, "group_members").select(ids.group_id(F.col("group_id")).alias("unit"), ids.tip_id(F.col("tip_id")).alias("tip"))
    return covers.sparse_plan(members.join(groups, "unit"))


def vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every twentieth, exact, on the given values."""
    rows = table(spark, sf_dir, "embeddings")
    return graph.nearest(rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "vec_id", "v", F.col("vec_id") % 20 == 0, 10)


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts grouped by brand and type, against the same with small parts in groups of their own."""
    part = table(spark, sf_dir, "part")
    old = part.select(F.concat_ws("/", "p_brand", "p_type").alias("grp"), F.col("p_partkey").alias("input"))
    new = part.select(F.concat_ws("/", "p_brand", "p_type", F.when(F.col("p_size") <= 15, "s").otherwise("l")).alias("grp"), F.col("p_partkey").alias("input"))
    return lines.lineage(new, old)


def minted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New ids of the finest groups from their tips."""
    members = table(spark, sf_dir, "group_members")
    return lines.minted(members.select(ids.group_id(F.col("group_id")).alias("grp"), ids.tip_id(F.col("tip_id")).alias("input")))


def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders labelled by status and by priority."""
    return lines.adjusted_rand(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


def candidate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query's best target and what can be done with it; components of two tips count as not built."""
    home = _home(spark, sf_dir)
    built = home.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2)
    hits = _hits(spark, sf_dir)
    queries = table(spark, sf_dir, "knn").select(ids.tip_id(F.col("query")).alias("query")).filter(F.col("query").isNotNull())
    return placement.candidates(hits, home.withColumnRenamed("tip", "target"), queries, built)


def tied_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target tied at a query's best identity."""
    return placement.tied(_hits(spark, sf_dir))


def placement_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that can be placed, by the central shards of their best target."""
    central = covers.central_shards(_shards(spark, sf_dir)).select("tip", F.concat_ws("/", "plan_id", "shard").alias("shard"))
    return placement.jobs(candidate_status(spark, sf_dir), central)


def region_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of 150 tips or more, small and lone ones."""
    return release.regions(_home(spark, sf_dir), _hits(spark, sf_dir))[0]


def region_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the covers of components draw on: own tips, and around small ones their context."""
    return release.regions(Scratch(spark).keep(_home(spark, sf_dir)), _hits(spark, sf_dir).filter(F.col("identity").isNotNull()))[1]


def group_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spellings under which the search names the tips of each group, as its inputs."""
    names = table(spark, sf_dir, "knn").select(F.explode(F.array("query", "target")).alias("input_id"))
    members = _members(spark, sf_dir).select(F.col("grp").alias("group_id"), F.col("tip").alias("tip_id"))
    return release.group_inputs(members, names.select("input_id", ids.tip_id(F.col("input_id")).alias("tip_id")))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries by status."""
    return candidate_status(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as queries, joined to the suppliers of their lines, assigned to a nation."""
    results = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("shard"), F.col("l_suppkey").alias("member"), F.col("l_discount").alias("height"))
    return placement.assigned(placement.reduced(results), _group_of(spark, sf_dir).withColumnRenamed("tip", "member"))


def chunk_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First order, last order and size of 23 contiguous chunks of the orders by customer and key."""
    placed = numbering.numbered(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"])
    total = F.lit(placed.count())
    ends = [F.min_by("o_orderkey", "place").alias("first_order"), F.max_by("o_orderkey", "place").alias("last_order")]
    return placed.groupBy(records.chunk_of(F.col("place"), total, 23).alias("chunk")).agg(*ends, F.count(F.lit(1)).alias("n"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by the median of their votes, and how many there are: i, j, d, w."""
    return _medians(spark, sf_dir).select("i", "j", F.col("med").alias("d"), F.col("votes").alias("w"))


def _medians(spark: SparkSession, sf_dir: str, levels: list[float] | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("shard"), F.col("l_suppkey").alias("tip"), "l_discount")
    return votes.shard_medians(rows, "shard", "tip", "l_discount", levels)


def _merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.average_linkage(_pairs(spark, sf_dir))


def average_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by the mean of their pair medians."""
    return _merges(spark, sf_dir).drop("round", "made_a", "made_b", "weakest")


def forest_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the linkage that no observed pair joins, with their size."""
    return linkage.parts(_merges(spark, sf_dir), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tip")))


def numbered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the linkage numbered at each level, larger ones first."""
    return numbering.groups_by_size(Scratch(spark).keep(cut_groups(spark, sf_dir)))


def cut_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the linkage at each level."""
    tips = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tip"))
    return linkage.cut(_merges(spark, sf_dir), tips, CUTS)


def stem_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes set apart that no level shows."""
    found = linkage.stem_nodes(linkage.nodes(_merges(spark, sf_dir)), [0.03, 0.04])
    return found.select("a", "b", "height", "height_top", "size", "measured_at")


def weakest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest votes behind any merge below each node."""
    return linkage.weakest(_merges(spark, sf_dir))


def merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observed pairs across each merge."""
    scratch = Scratch(spark)
    pairs = scratch.keep(_pairs(spark, sf_dir))
    return linkage.cross_pairs(linkage.average_linkage(pairs, scratch), pairs, scratch)


def verification_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs to verify across the merges of fewer than three votes."""
    scratch = Scratch(spark)
    pairs = scratch.keep(_pairs(spark, sf_dir))
    return layers.verification_round(linkage.average_linkage(pairs, scratch), pairs, scratch=scratch)


def formed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the linkage that stay the same over levels."""
    return linkage.formed_nodes(cut_groups(spark, sf_dir))


def enclosing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarser group around each group of the linkage."""
    return linkage.enclosing(Scratch(spark).keep(cut_groups(spark, sf_dir)), CUTS)


_BUILT: dict[str, list[float]] = {"fine": CUTS, "coarse": [0.05, 0.06]}


def _built(spark: SparkSession, sf_dir: str) -> build.Built:
    tips = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tip"))
    return build.build(lambda at: _medians(spark, sf_dir, at), tips, _BUILT["fine"], floor=0.001, least_stem=0.0001, grid=0.00005)


def build_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build: groups of suppliers at each level with number, evidence and parent."""
    return _built(spark, sf_dir).levels


def build_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build: every supplier at each level with its group, membership and pull."""
    return _built(spark, sf_dir).tips


def build_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build: groups over runs of levels with spread, relatives and gap."""
    return _built(spark, sf_dir).nodes


def layer_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a layer over the nations (and suppliers without one), in terms of suppliers, with their spread."""
    fine = Scratch(spark).keep(_group_of(spark, sf_dir).filter(F.col("level") == 0.0))
    unit_of = layers.units(fine)
    given = _votes(spark, sf_dir)
    layer = build.build(layers.unit_votes(given, unit_of), unit_of.select(F.col("unit").alias("tip")), _BUILT["coarse"], least_votes=3)
    names = fine.filter(F.col("grp").isNotNull()).groupBy("grp").agg(F.min("tip").alias("name"))
    cuts, groups, _ = build.appended(fine.join(names, "grp", "left").select("level", "tip", F.col("name").alias("grp")), unit_of, layer)
    pairs = votes.consensus(given, LEVELS).select("i", "j", F.col("med").alias("d"))
    return groups.join(build.coarse_spread(pairs, cuts), ["level", "grp"], "left")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "group_members")
    return members.select(ids.group_id(F.col("group_id")).alias("grp"), ids.tip_id(F.col("tip_id")).alias("tip")).distinct()


def group_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and median identity within the finest groups."""
    return layers.identities(_hits(spark, sf_dir), _members(spark, sf_dir))


def _unit_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit_of = _members(spark, sf_dir).groupBy("tip").agg(F.min("grp").alias("unit"))
    return layers.unit_neighbours(_hits(spark, sf_dir).filter(F.col("identity").isNotNull()), unit_of, 30)


def unit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 30 nearest groups of each finest group by their best hit."""
    return _unit_near(spark, sf_dir)


def unit_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cover of the finest groups by shards of up to 150, six deep."""
    found = layers.unit_cover(_unit_near(spark, sf_dir), 150, 6)
    return found.select("cover", "seed", F.array_join("members", ",").alias("members"), "n")


def context_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest groups of each shard's seed beyond its members."""
    near = Scratch(spark).keep(_unit_near(spark, sf_dir))
    return layers.context_units(near, layers.unit_cover(near, 10, 6), 20)


def unit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tip drawn for each group of each shard, repeated until each group is in twelve, with tips of context."""
    near = Scratch(spark).keep(_unit_near(spark, sf_dir))
    tips = _members(spark, sf_dir).groupBy("tip").agg(F.min("grp").alias("unit"))
    return layers.unit_shards(Scratch(spark).keep(layers.unit_cover(near, 150, 6)), tips, near)


def large_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three largest parts of each brand."""
    return top_per_key(table(spark, sf_dir, "part"), ["p_brand"], [("p_size", "descending"), ("p_partkey", "ascending")], 3, ["p_brand", "p_partkey", "p_size"])


QUERIES = {f.__name__: f for f in (
    content_dedup, input_summary, pair_consensus, votes_at_levels, membership, cohesion_held, tip_pull, group_margin, level_summary, separation, unit_pairs,
    knn_top, component_anchors, outgroups_top8, scaffold_top, coverage_account, twin_shards, distinct_shards, central_shards, hash_cover, sparse_plan,
    vector_neighbours, tied_targets, placement_jobs, region_kinds, region_neighbours, group_inputs, lineage, minted_ids, adjusted_rand, candidate_status, status_counts, assigned, chunk_contiguous, average_linkage, cut_groups,
    stem_nodes, weakest_links, merge_pairs, verification_pairs, forest_parts, numbered_groups, build_levels, build_tips, build_nodes, layer_levels, formed_nodes, enclosing_groups, group_identities, unit_neighbours, unit_cover, context_units, unit_shards, large_parts,
)}

_VOTES = """base AS (SELECT l_orderkey AS shard, l_suppkey AS tip, min(l_discount) AS x FROM lineitem GROUP BY 1, 2),
vote AS (SELECT a.shard, a.tip AS i, b.tip AS j, CAST(abs(a.x - b.x) AS FLOAT) AS v FROM base a JOIN base b ON a.shard = b.shard AND a.tip < b.tip),
pair AS (SELECT i, j, count(*) AS votes, list_sort(list(v)) AS vs FROM vote GROUP BY 1, 2),
med AS (SELECT i, j, CAST((vs[(votes - 1) // 2 + 1] + vs[votes // 2 + 1]) / CAST(2 AS FLOAT) AS FLOAT) AS med, votes FROM pair),
lv AS (SELECT unnest(CAST([0.0, 0.01, 0.02, 0.05] AS DOUBLE[])) AS level),
hit AS (SELECT i, j, level, CAST(len(list_filter(vs, lambda x: x <= CAST(level AS FLOAT))) AS BIGINT) AS hits, votes FROM pair, lv),
g AS (SELECT s_suppkey AS tip, CASE WHEN s_acctbal >= 0 THEN s_nationkey END AS grp FROM supplier),
both_ AS (SELECT h.*, a.grp AS gi, b.grp AS gj FROM hit h LEFT JOIN g a ON a.tip = i LEFT JOIN g b ON b.tip = j),
ends AS (SELECT level, hits, votes, i AS tip, gi AS grp, j AS other, gj AS og FROM both_ UNION ALL SELECT level, hits, votes, j, gj, i, gi FROM both_),
coh AS (SELECT level, gi AS grp, sum(hits) AS h, sum(votes) AS votes, count(*) AS pairs FROM both_ WHERE gi = gj GROUP BY 1, 2),
size AS (SELECT grp, count(*) AS n_tips FROM g WHERE grp IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
inner_ AS (SELECT lv.level, s.grp, s.n_tips, h / c.votes AS cohesion, CAST(coalesce(c.votes, 0) AS BIGINT) AS votes, coalesce(pairs, 0) AS pairs,
    coalesce(pairs, 0) / (n_tips * (n_tips - 1) / 2) AS held FROM size s CROSS JOIN lv LEFT JOIN coh c ON c.level = lv.level AND c.grp = s.grp),
pool AS (SELECT level, tip, grp, CASE WHEN og IS NULL THEN 1 ELSE 0 END AS kind, og, CASE WHEN og IS NULL THEN other END AS ot,
    sum(hits) AS h, sum(votes) AS v, count(*) AS n FROM ends WHERE grp IS NULL OR og IS NULL OR grp <> og GROUP BY ALL),
tot AS (SELECT level, tip, sum(v) AS all_v, sum(n) AS all_n FROM pool GROUP BY 1, 2),
top AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY level, tip ORDER BY h / v DESC, v DESC, kind, og, ot) = 1),
pull AS (SELECT p.level, p.tip, p.grp, CASE WHEN h > 0 THEN h / v ELSE 0.0::DOUBLE END AS pull, CASE WHEN h = 0 THEN 'nothing_joins' WHEN kind = 0 THEN 'group' ELSE 'tip' END AS target_kind,
    CASE WHEN h > 0 THEN coalesce(CAST(og AS VARCHAR), CAST(ot AS VARCHAR)) END AS target, CAST(h AS BIGINT) AS hits, CAST(CASE WHEN h > 0 THEN v ELSE all_v END AS BIGINT) AS votes,
    CAST(CASE WHEN h > 0 THEN n ELSE all_n END AS BIGINT) AS partners FROM top p JOIN tot t ON t.level = p.level AND t.tip = p.tip),
gpull AS (SELECT level, grp, coalesce(sum(hits) / nullif(sum(votes), 0), 0) AS pull FROM pull WHERE grp IS NOT NULL GROUP BY 1, 2),
unit AS (SELECT tip, coalesce(CAST(grp AS VARCHAR), 'lone:' || tip) AS unit FROM g),
uvote AS (SELECT least(a.unit, b.unit) AS i, greatest(a.unit, b.unit) AS j, v FROM vote JOIN unit a ON a.tip = i JOIN unit b ON b.tip = j WHERE a.unit <> b.unit),
upair AS (SELECT i, j, count(*) AS votes, list_sort(list(v)) AS vs FROM uvote GROUP BY 1, 2),
dist AS (SELECT m.i, m.j, m.med AS d, a.grp AS gi, b.grp AS gj FROM med m LEFT JOIN g a ON a.tip = m.i LEFT JOIN g b ON b.tip = m.j),
out_ AS (SELECT gi AS grp, gj AS og, j AS ot, d FROM dist WHERE gi IS NOT NULL AND gi IS DISTINCT FROM gj UNION ALL SELECT gj, gi, i, d FROM dist WHERE gj IS NOT NULL AND gi IS DISTINCT FROM gj),
closest AS (SELECT * FROM out_ WHERE og IS NOT NULL QUALIFY row_number() OVER (PARTITION BY grp, og ORDER BY d, ot) = 1),
near AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY d, ot) AS r FROM closest),
loose AS (SELECT grp, ot, d FROM out_ WHERE og IS NULL),
stray AS (SELECT o.grp, count(DISTINCT o.ot) AS n FROM loose o LEFT JOIN near n ON n.grp = o.grp AND r = 1 WHERE n.d IS NULL OR o.d < n.d GROUP BY 1),
first_stray AS (SELECT * FROM loose QUALIFY row_number() OVER (PARTITION BY grp ORDER BY d, ot) = 1)"""

# evidence at the levels of the cuts; ties by the smaller name, as in _VOTES
_BUILD_TAIL = """,
bhit AS (SELECT i, j, level, CAST(len(list_filter(vs, lambda x: x <= CAST(level AS FLOAT))) AS BIGINT) AS hits, votes FROM pair, cl),
bboth AS (SELECT h.*, a.grp AS gi, b.grp AS gj FROM bhit h JOIN cut_ a ON a.tip = i AND a.level = h.level JOIN cut_ b ON b.tip = j AND b.level = h.level),
bdist AS (SELECT b.*, m.med FROM bboth b JOIN med m ON m.i = b.i AND m.j = b.j),
bend AS (SELECT level, hits, votes, i AS tip, gi AS grp, j AS other, gj AS og FROM bboth UNION ALL SELECT level, hits, votes, j, gj, i, gi FROM bboth),
bpool AS (SELECT level, tip, grp, CASE WHEN og IS NULL THEN 1 ELSE 0 END AS kind, og, CASE WHEN og IS NULL THEN other END AS ot, sum(hits) AS h, sum(votes) AS v, count(*) AS n
    FROM bend WHERE grp IS NULL OR og IS NULL OR grp <> og GROUP BY ALL),
btot AS (SELECT level, tip, sum(v) AS all_v FROM bpool GROUP BY 1, 2),
btop AS (SELECT * FROM bpool QUALIFY row_number() OVER (PARTITION BY level, tip ORDER BY h / v DESC, v DESC, kind, og, ot) = 1),
bpull AS (SELECT p.level, p.tip, p.grp, CASE WHEN h > 0 THEN h / v ELSE 0.0::DOUBLE END AS pull, CASE WHEN h = 0 THEN 'nothing_joins' WHEN kind = 0 THEN 'group' ELSE 'tip' END AS target_kind,
    CASE WHEN h > 0 THEN coalesce(CAST(og AS VARCHAR), CAST(ot AS VARCHAR)) END AS target, CAST(h AS BIGINT) AS hits, CAST(CASE WHEN h > 0 THEN v ELSE all_v END AS BIGINT) AS votes
    FROM btop p JOIN btot t ON t.level = p.level AND t.tip = p.tip),
bgp AS (SELECT level, grp, sum(hits) / nullif(sum(votes), 0) AS pull FROM bpull WHERE grp IS NOT NULL GROUP BY 1, 2),
bsize AS (SELECT level, grp, count(*) AS n_tips, row_number() OVER (PARTITION BY level ORDER BY count(*) DESC, min(tip)) - 1 AS number FROM cut_ WHERE grp IS NOT NULL GROUP BY 1, 2),
bcoh AS (SELECT level, gi AS grp, sum(hits) / sum(votes) AS cohesion, sum(votes) AS votes, count(*) AS pairs FROM bboth WHERE gi = gj GROUP BY 1, 2),
bup AS (SELECT level, lead(level) OVER (ORDER BY level) AS above FROM cl),
blevel AS (SELECT s.level, s.grp, s.n_tips, s.number, CAST(printf('%.3f', cohesion) AS DOUBLE) AS cohesion, CAST(coalesce(votes, 0) AS BIGINT) AS votes, CAST(printf('%.3f', coalesce(g.pull, 0)) AS DOUBLE) AS pull,
    CAST(printf('%.3f', CAST(printf('%.3f', cohesion) AS DOUBLE) - coalesce(g.pull, 0)) AS DOUBLE) AS margin, CAST(printf('%.3f', coalesce(pairs, 0) / (n_tips * (n_tips - 1) / 2)) AS DOUBLE) AS held, p.grp AS parent
    FROM bsize s LEFT JOIN bcoh c ON c.level = s.level AND c.grp = s.grp LEFT JOIN bgp g ON g.level = s.level AND g.grp = s.grp JOIN bup u ON u.level = s.level
    LEFT JOIN cut_ p ON p.level = u.above AND p.tip = s.grp)"""
# one merge a step, of the pair of clusters with the least mean (the names break ties)
_MERGES = _VOTES + """,
st AS (SELECT 0 AS step, i AS a, j AS b, CAST(round(CAST(med AS DOUBLE) * 1099511627776) AS HUGEINT) AS s, CAST(1 AS HUGEINT) AS n, CAST(votes AS HUGEINT) AS w,
        CAST(1 AS BIGINT) AS sa, CAST(1 AS BIGINT) AS sb, CAST(NULL AS HUGEINT) AS wa, CAST(NULL AS HUGEINT) AS wb FROM med
    UNION ALL SELECT step + 1, least(x, y), greatest(x, y), sum(s), sum(n), sum(w), max(CASE WHEN x < y THEN nx ELSE ny END), max(CASE WHEN x < y THEN ny ELSE nx END),
        max(CASE WHEN x < y THEN kx ELSE ky END), max(CASE WHEN x < y THEN ky ELSE kx END)
    FROM (SELECT *, CASE WHEN a = mb THEN ma ELSE a END AS x, CASE WHEN b = mb THEN ma ELSE b END AS y, CASE WHEN a IN (ma, mb) THEN ms ELSE sa END AS nx,
            CASE WHEN b IN (ma, mb) THEN ms ELSE sb END AS ny, CASE WHEN a IN (ma, mb) THEN mw ELSE wa END AS kx, CASE WHEN b IN (ma, mb) THEN mw ELSE wb END AS ky
        FROM (SELECT *, first_value(a) OVER o AS ma, first_value(b) OVER o AS mb, first_value(sa + sb) OVER o AS ms, first_value(least(w, wa, wb)) OVER o AS mw
            FROM st WINDOW o AS (ORDER BY CAST(s AS DOUBLE) / CAST(n AS DOUBLE), a, b)))
    WHERE x <> y GROUP BY step, least(x, y), greatest(x, y)),
merges AS (SELECT step, a, b, CAST(s AS DOUBLE) / CAST(n AS DOUBLE) / 1099511627776 AS height, CAST(n AS BIGINT) AS observed, CAST(w AS BIGINT) AS votes, sa AS size_a, sb AS size_b,
    CAST(least(w, wa, wb) AS BIGINT) AS weakest FROM st QUALIFY row_number() OVER (PARTITION BY step ORDER BY CAST(s AS DOUBLE) / CAST(n AS DOUBLE), a, b) = 1)"""
_CUT = _MERGES + """,
cl AS (SELECT unnest(CAST([0.02, 0.03, 0.04] AS DOUBLE[])) AS level),
climb AS (SELECT level, s_suppkey AS tip, s_suppkey AS at_ FROM supplier, cl UNION ALL SELECT c.level, c.tip, m.a FROM climb c JOIN merges m ON m.b = c.at_ AND m.height <= c.level),
root AS (SELECT level, tip, min(at_) AS root FROM climb GROUP BY 1, 2),
cut_ AS (SELECT level, tip, CASE WHEN count(*) OVER (PARTITION BY level, root) > 1 THEN root END AS grp FROM root)"""
_BUILD = _CUT + _BUILD_TAIL
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(12288)"
_TIP = lambda x: f"nullif(nullif(trim(regexp_replace(lower(trim({x}, {_BLANK})), ';size=[0-9]+;?$', ''), {_BLANK}), ''), '*')"
_HITS = f"""named AS (SELECT {_TIP('query')} AS query, {_TIP('target')} AS target, CASE WHEN identity <= 1 THEN identity * 100 ELSE identity END AS identity FROM knn),
hits AS (SELECT query, target, max(identity) AS identity FROM named WHERE query <> target GROUP BY 1, 2)"""
_HOME = _HITS + """,
edge AS (SELECT query AS a, target AS b FROM hits WHERE identity >= 86 UNION SELECT target, query FROM hits WHERE identity >= 86),
tips AS (SELECT query AS id FROM named WHERE query IS NOT NULL UNION SELECT target FROM named WHERE target IS NOT NULL),
reach AS (SELECT id, id AS seen FROM tips UNION SELECT r.id, e.b FROM reach r JOIN edge e ON r.seen = e.a),
home AS (SELECT id AS tip, min(seen) AS component FROM reach GROUP BY id),
cand AS (SELECT h.query, h.target, h.identity, m.component FROM hits h JOIN home m ON m.tip = h.target WHERE h.identity IS NOT NULL),
best AS (SELECT query, identity, min(target) AS candidate, min(component) AS component, count(DISTINCT component) AS nc FROM cand
    QUALIFY true GROUP BY query, identity),
final AS (SELECT query, arg_max(candidate, identity) AS candidate, max(identity) AS identity, arg_max(component, identity) AS component, arg_max(nc, identity) AS nc FROM best GROUP BY query),
built AS (SELECT component FROM home GROUP BY 1 HAVING count(*) > 2),
state AS (SELECT q.query, f.candidate, f.identity, CASE WHEN nc = 1 THEN f.component END AS component, CASE WHEN f.candidate IS NULL THEN 'no_match' WHEN nc > 1 THEN 'spans_components'
    WHEN f.component NOT IN (SELECT component FROM built) THEN 'not_built' ELSE 'job' END AS status
    FROM (SELECT DISTINCT query FROM named WHERE query IS NOT NULL) q LEFT JOIN final f ON f.query = q.query)"""
_HOME = _HOME.replace("\n    QUALIFY true GROUP BY", "\n    GROUP BY")
_CLEAN = lambda c: f"list_filter(list_transform({c}, lambda x: {_TIP('x')}), lambda x: x IS NOT NULL)"
_SHARDS = f"""shards AS (SELECT plan_id, cover, shard, {_CLEAN('members')} AS members, coalesce({_CLEAN('context')}, CAST([] AS VARCHAR[])) AS context FROM manifest),
full_ AS (SELECT *, sha256(array_to_string(list_sort(list_distinct(members)), ',')) AS key, sha256(array_to_string(list_sort(list_distinct(members || context)), ',')) AS own FROM shards WHERE len(members) > 0)"""

_CENTRAL = """first_ AS (SELECT DISTINCT plan_id, own FROM full_ WHERE cover = 0), skip AS (SELECT DISTINCT f.plan_id, f.shard FROM full_ f JOIN first_ USING (plan_id, own) WHERE f.cover = 1),
        pos AS (SELECT plan_id, cover, shard, unnest(members) AS tip, unnest(range(len(members))) AS pos FROM full_ WHERE NOT (cover = 1 AND (plan_id, shard) IN (SELECT (plan_id, shard) FROM skip))),
        each AS (SELECT plan_id, cover, tip, shard, CAST(min(pos) AS INT) AS pos FROM pos GROUP BY 1, 2, 3, 4),
        central AS (SELECT * FROM each QUALIFY row_number() OVER (PARTITION BY plan_id, cover, tip ORDER BY pos, shard) <= 3)"""

ORACLE = {
    "input_summary": r"""WITH c AS (SELECT upper(regexp_replace(coalesce(text, ''), '[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\-.]', '', 'g')) AS s FROM documents),
        n AS (SELECT s, count(*) AS n FROM c GROUP BY 1) SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS records, CAST(coalesce(sum(n) FILTER (s = ''), 0) AS BIGINT) AS empty,
        count(*) FILTER (s <> '') AS sequences, count(*) FILTER (s <> '' AND n = 1) AS singletons, coalesce(max(n) FILTER (s <> ''), 0) AS largest FROM n""",
    "pair_consensus": f"WITH {_VOTES} SELECT i, j, med, votes FROM med",
    "votes_at_levels": f"WITH {_VOTES} SELECT i, j, votes, level, hits FROM hit",
    "membership": f"WITH {_VOTES} SELECT level, tip, grp, sum(hits) / sum(votes) AS membership, CAST(sum(votes) AS BIGINT) AS votes, count(*) AS partners FROM ends WHERE grp = og GROUP BY 1, 2, 3",
    "cohesion_held": f"WITH {_VOTES} SELECT * FROM inner_",
    "tip_pull": f"WITH {_VOTES} SELECT * FROM pull",
    "group_margin": f"WITH {_VOTES} SELECT i.level, i.grp, cohesion, coalesce(p.pull, 0) AS pull, CAST(printf('%.3f', CAST(printf('%.3f', cohesion) AS DOUBLE) - coalesce(p.pull, 0)) AS DOUBLE) AS margin FROM inner_ i LEFT JOIN gpull p ON p.level = i.level AND p.grp = i.grp",
    "level_summary": f"WITH {_VOTES} SELECT level, count(*) AS groups, CAST(sum(n_tips) AS BIGINT) AS tips_in_groups, max(n_tips) AS largest, quantile_cont(held, 0.1) AS held_10 FROM inner_ GROUP BY 1",
    "separation": f"""WITH {_VOTES} SELECT s.grp, i.spread, i.spread_median, coalesce(i.pairs, 0) AS pairs, a.og AS nearest, a.ot AS nearest_tip, a.d AS nearest_distance,
            b.og AS second, b.ot AS second_tip, b.d AS second_distance, f.ot AS stray, f.d AS stray_distance, coalesce(t.n, 0) AS strays_closer
        FROM (SELECT DISTINCT grp FROM g WHERE grp IS NOT NULL) s LEFT JOIN (SELECT gi AS grp, max(d) AS spread, median(CAST(d AS DOUBLE)) AS spread_median, count(*) AS pairs FROM dist WHERE gi = gj GROUP BY 1) i ON i.grp = s.grp
        LEFT JOIN near a ON a.grp = s.grp AND a.r = 1 LEFT JOIN near b ON b.grp = s.grp AND b.r = 2 LEFT JOIN stray t ON t.grp = s.grp LEFT JOIN first_stray f ON f.grp = s.grp""",
    "unit_pairs": f"WITH {_VOTES} SELECT i, j, CAST((vs[(votes - 1) // 2 + 1] + vs[votes // 2 + 1]) / CAST(2 AS FLOAT) AS FLOAT) AS med, votes FROM upair WHERE votes >= 3",
    "knn_top": f"WITH {_HITS} SELECT query, target, identity FROM hits WHERE identity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query ORDER BY identity DESC, target DESC) <= 5",
    "component_anchors": f"""WITH RECURSIVE {_HOME}, c AS (SELECT target, count(*) AS copies FROM hits GROUP BY 1)
        SELECT component, arg_min(tip, (-coalesce(copies, 0), tip)) AS anchor, count(*) AS n_tips FROM home LEFT JOIN c ON c.target = tip GROUP BY 1""",
    "outgroups_top8": f"""WITH RECURSIVE {_HOME} SELECT q.component, h.target, count(*) AS n_hits FROM hits h JOIN home q ON q.tip = h.query LEFT JOIN home t ON t.tip = h.target
        WHERE q.component IS DISTINCT FROM t.component GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY q.component ORDER BY count(*) DESC, h.target) <= 8""",
    "scaffold_top": "SELECT component, tip_id, copies FROM scaffold QUALIFY row_number() OVER (PARTITION BY component ORDER BY copies DESC, tip_id DESC) <= 30",
    "coverage_account": f"""WITH {_HITS}, {_SHARDS}, held AS (SELECT DISTINCT plan_id, key, unnest(members) AS tip FROM full_), seen AS (SELECT tip, count(*) AS n FROM held GROUP BY 1),
        near AS (SELECT query AS tip, count(DISTINCT target) AS m FROM hits GROUP BY 1),
        tip AS (SELECT query AS tip FROM named WHERE query IS NOT NULL UNION SELECT target FROM named WHERE target IS NOT NULL UNION SELECT tip FROM held)
        SELECT t.tip, coalesce(n, 0) AS n_shards, CASE WHEN coalesce(n, 0) >= 3 THEN 'covered' WHEN coalesce(n, 0) = 0 AND coalesce(m, 0) < 3 THEN 'isolated' ELSE 'under' END AS status
        FROM tip t LEFT JOIN seen s ON s.tip = t.tip LEFT JOIN near r ON r.tip = t.tip""",
    "twin_shards": f"WITH {_SHARDS} SELECT DISTINCT b.plan_id, b.shard, a.shard AS twin FROM full_ b JOIN (SELECT plan_id, own, min(shard) AS shard FROM full_ WHERE cover = 0 GROUP BY 1, 2) a ON a.plan_id = b.plan_id AND a.own = b.own WHERE b.cover = 1",
    "distinct_shards": f"WITH {_SHARDS} SELECT plan_id, key, min(shard) AS shard, CAST(max(len(list_distinct(members))) AS INT) AS n_members, count(DISTINCT shard) AS n_shards FROM full_ GROUP BY 1, 2",
    "central_shards": f"WITH {_SHARDS}, {_CENTRAL} SELECT * FROM central",
    "tied_targets": f"WITH {_HITS} SELECT query, target, identity FROM hits WHERE identity IS NOT NULL QUALIFY rank() OVER (PARTITION BY query ORDER BY identity DESC) = 1",
    "placement_jobs": f"""WITH RECURSIVE {_HOME}, {_SHARDS}, {_CENTRAL} SELECT DISTINCT s.query, s.component, c.plan_id || '/' || c.shard AS shard FROM state s JOIN central c ON c.tip = s.candidate WHERE s.status = 'job'""",
    "region_kinds": f"""WITH RECURSIVE {_HOME} SELECT component, count(*) AS n_tips, CASE WHEN count(*) >= 150 THEN 'large' WHEN count(*) >= 2 THEN 'small' ELSE 'lone' END AS kind FROM home GROUP BY 1""",
    "region_neighbours": f"""WITH RECURSIVE {_HOME}, kind AS (SELECT component, count(*) AS n FROM home GROUP BY 1),
        near AS (SELECT q.component, h.query, h.target, h.identity, coalesce(q.component = t.component, false) AS own, n FROM hits h JOIN home q ON q.tip = h.query LEFT JOIN home t ON t.tip = h.target
            JOIN kind k ON k.component = q.component WHERE n > 1 AND h.identity IS NOT NULL)
        SELECT component, query, target, identity, own FROM near WHERE n >= 150 AND own UNION ALL SELECT component, query, target, identity, own FROM near WHERE n < 150
            QUALIFY row_number() OVER (PARTITION BY query ORDER BY identity DESC, target DESC) <= 179""",
    "group_inputs": f"""WITH m AS (SELECT DISTINCT nullif(upper(trim(group_id, {_BLANK})), '') AS grp, {_TIP('tip_id')} AS tip FROM group_members),
        x AS (SELECT query AS input FROM knn UNION SELECT target FROM knn), n AS (SELECT input, {_TIP('input')} AS tip FROM x) SELECT DISTINCT grp, input FROM m JOIN n USING (tip)""",
    "vector_neighbours": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
        SELECT a.vec_id AS query, b.vec_id AS target, list_aggregate(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]), 'fsum') AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id
        WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, target) <= 10""",
    "lineage": """WITH old AS (SELECT p_brand || '/' || p_type AS grp, p_partkey AS input FROM part), new AS (SELECT p_brand || '/' || p_type || CASE WHEN p_size <= 15 THEN '/s' ELSE '/l' END AS grp, p_partkey AS input FROM part),
        n AS (SELECT grp, count(*) AS n FROM new GROUP BY 1), o AS (SELECT grp, count(*) AS n FROM old GROUP BY 1),
        s AS (SELECT new.grp AS n, old.grp AS o, count(*) AS shared FROM new JOIN old USING (input) GROUP BY 1, 2),
        j AS (SELECT s.*, shared / (n.n + o.n - shared) AS jaccard FROM s JOIN n ON n.grp = s.n JOIN o ON o.grp = s.o),
        fn AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY n ORDER BY jaccard DESC, o DESC) = 1), fo AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY o ORDER BY jaccard DESC, n DESC) = 1),
        h AS (SELECT fn.* FROM fn JOIN fo ON fn.n = fo.n AND fn.o = fo.o WHERE fn.jaccard > 0.5)
        SELECT 'continued' AS event, n AS grp, o AS previous, jaccard, shared FROM h UNION ALL SELECT 'born', n, o, jaccard, shared FROM fn WHERE n NOT IN (SELECT n FROM h)
        UNION ALL SELECT 'retired', n, o, jaccard, shared FROM fo WHERE o NOT IN (SELECT o FROM h)""",
    "adjusted_rand": """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), x AS (SELECT sum(n * (n - 1)) AS p, sum(n) AS n FROM c),
        pa AS (SELECT sum(n * (n - 1)) AS p FROM (SELECT sum(n) AS n FROM c GROUP BY a)), pb AS (SELECT sum(n * (n - 1)) AS p FROM (SELECT sum(n) AS n FROM c GROUP BY b))
        SELECT (CAST(x.p AS DOUBLE) - CAST(pa.p AS DOUBLE) * CAST(pb.p AS DOUBLE) / (CAST(x.n AS DOUBLE) * (CAST(x.n AS DOUBLE) - 1))) / ((CAST(pa.p AS DOUBLE) + CAST(pb.p AS DOUBLE)) / 2
            - CAST(pa.p AS DOUBLE) * CAST(pb.p AS DOUBLE) / (CAST(x.n AS DOUBLE) * (CAST(x.n AS DOUBLE) - 1))) AS adjusted_rand FROM x, pa, pb""",
    "group_identities": f"""WITH {_HITS}, m AS (SELECT DISTINCT nullif(upper(trim(group_id, {_BLANK})), '') AS grp, {_TIP('tip_id')} AS tip FROM group_members),
        p AS (SELECT least(query, target) AS i, greatest(query, target) AS j, max(identity) AS identity FROM hits WHERE identity IS NOT NULL GROUP BY 1, 2)
        SELECT a.grp, count(*) AS pairs, min(identity) AS identity_min, quantile_cont(identity, 0.5) AS identity_median FROM p JOIN m a ON a.tip = i JOIN m b ON b.tip = j AND b.grp = a.grp GROUP BY 1""",
    "unit_neighbours": f"""WITH {_HITS}, u AS (SELECT {_TIP('tip_id')} AS tip, min(nullif(upper(trim(group_id, {_BLANK})), '')) AS unit FROM group_members GROUP BY 1)
        SELECT a.unit AS ua, b.unit AS ub, max(identity) AS identity FROM hits JOIN u a ON a.tip = query JOIN u b ON b.tip = target WHERE a.unit <> b.unit AND identity IS NOT NULL
        GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY a.unit ORDER BY max(identity) DESC, b.unit) <= 30""",
    "candidate_status": f"WITH RECURSIVE {_HOME} SELECT * FROM state",
    "status_counts": f"WITH RECURSIVE {_HOME} SELECT status, count(*) AS n FROM state GROUP BY 1",
    "assigned": """WITH r AS (SELECT l_orderkey AS query, l_suppkey AS member, list_sort(list(l_discount)) AS vs, count(*) AS n FROM lineitem GROUP BY 1, 2),
        m AS (SELECT query, member, (vs[(n - 1) // 2 + 1] + vs[n // 2 + 1]) / 2 AS height FROM r),
        x AS (SELECT query, s_nationkey AS grp, CAST(sum(CAST(round(height * 1099511627776) AS HUGEINT)) AS DOUBLE) / count(*) / 1099511627776 AS mean, count(*) AS n
            FROM m JOIN supplier ON s_suppkey = member WHERE s_acctbal >= 0 GROUP BY 1, 2),
        b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY query ORDER BY mean, grp) = 1),
        f AS (SELECT b.*, lv.level FROM b JOIN (SELECT unnest(CAST([0.0, 0.01, 0.02, 0.05] AS DOUBLE[])) AS level) lv ON mean <= level QUALIFY row_number() OVER (PARTITION BY query ORDER BY lv.level) = 1)
        SELECT q.query, f.level, f.grp, f.mean, f.n FROM (SELECT DISTINCT query FROM m) q LEFT JOIN f ON f.query = q.query""",
    "chunk_contiguous": """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS place, count(*) OVER () AS total FROM orders)
        SELECT CAST(((place + 1) * 23 - 1) // total AS INT) AS chunk, arg_min(o_orderkey, place) AS first_order, arg_max(o_orderkey, place) AS last_order, count(*) AS n FROM p GROUP BY 1""",
    "content_dedup": r"""WITH t AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(text, 'ß', 'SS'), 'ﬀ', 'FF'), 'ﬁ', 'FI'), 'ﬂ', 'FL'), 'ﬃ', 'FFI'), 'ﬄ', 'FFL'), 'ﬅ', 'ST'), 'ﬆ', 'ST') AS text FROM documents WHERE text IS NOT NULL),
        c AS (SELECT doc_id, upper(regexp_replace(text, '[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\-.]', '', 'g')) AS s FROM t),
        d AS (SELECT doc_id, s, least(sha256(s), sha256(array_to_string(list_reverse(regexp_extract_all(translate(s, 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN'), '(?s).')), ''))) AS input_id FROM c WHERE s <> '')
        SELECT input_id, arg_min(s, (doc_id, s)) AS seq, count(*) AS n_records FROM d GROUP BY 1""",
    "minted_ids": f"""WITH m AS (SELECT DISTINCT nullif(upper(trim(group_id, {_BLANK})), '') AS grp, {_TIP('tip_id')} AS tip FROM group_members),
        h AS (SELECT grp, sha256(tip) AS x FROM m), c AS (SELECT grp, sha256('|' || concat_ws(':', sum(CAST('0x' || substr(x, 1, 12) AS HUGEINT)), sum(CAST('0x' || substr(x, 13, 12) AS HUGEINT)),
            sum(CAST('0x' || substr(x, 25, 12) AS HUGEINT)), count(*))) AS d FROM h GROUP BY 1), b AS (SELECT grp, CAST('0x' || right(d, 10) AS BIGINT) AS x FROM c),
        e AS (SELECT grp, array_to_string(list_transform(range(8), lambda k: substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST(((x >> (5 * k)::INT) & 31) + 1 AS INT), 1)), '') AS t FROM b)
        SELECT grp, left(t, 4) || '-' || right(t, 4) AS id FROM e""",
    "average_linkage": f"WITH RECURSIVE {_MERGES} SELECT a, b, height, observed, votes, size_a, size_b FROM merges",
    "weakest_links": f"WITH RECURSIVE {_MERGES} SELECT a, b, votes AS join_votes, weakest AS weakest_votes FROM merges",
    "merge_pairs": f"""WITH RECURSIVE {_MERGES}, up AS (SELECT s_suppkey AS tip, s_suppkey AS at_, -1 AS since FROM supplier UNION ALL SELECT u.tip, m.a, m.step FROM up u JOIN merges m ON m.b = u.at_),
        met AS (SELECT p.i, p.j, min(greatest(x.since, y.since)) AS step FROM med p JOIN up x ON x.tip = p.i JOIN up y ON y.tip = p.j AND y.at_ = x.at_ GROUP BY 1, 2)
        SELECT m.a, m.b, t.i, t.j FROM met t JOIN merges m USING (step)""",
    "forest_parts": f"""WITH RECURSIVE {_MERGES} SELECT s_suppkey AS part, CAST(coalesce((SELECT max(size_a + size_b) FROM merges m WHERE m.a = s_suppkey), 1) AS BIGINT) AS n
        FROM supplier WHERE s_suppkey NOT IN (SELECT b FROM merges)""",
    "build_levels": f"WITH RECURSIVE {_BUILD} SELECT * FROM blevel",
    "build_tips": f"""WITH RECURSIVE {_BUILD}, own AS (SELECT level, tip, CAST(printf('%.3f', sum(hits) / sum(votes)) AS DOUBLE) AS membership, sum(votes) AS votes, count(*) AS partners FROM bend WHERE grp = og GROUP BY 1, 2)
        SELECT c.level, c.tip, c.grp, o.membership, CAST(coalesce(o.votes, 0) AS BIGINT) AS votes, coalesce(o.partners, 0) AS partners, CAST(printf('%.3f', p.pull) AS DOUBLE) AS pull, p.target_kind, p.target, p.votes AS pull_votes
        FROM cut_ c LEFT JOIN own o ON o.level = c.level AND o.tip = c.tip LEFT JOIN bpull p ON p.level = c.level AND p.tip = c.tip""",
    "build_nodes": f"""WITH RECURSIVE {_BUILD}, nd AS (SELECT grp, n_tips, min(level) AS level_min, max(level) AS level_max FROM (SELECT level, grp, count(*) AS n_tips FROM cut_ WHERE grp IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2),
        e AS (SELECT level, i AS tip, gi AS grp, j AS ot, gj AS og, med AS d FROM bdist UNION ALL SELECT level, j, gj, i, gi, med FROM bdist),
        ins AS (SELECT level, grp, max(d) AS spread, median(CAST(d AS DOUBLE)) AS spread_median, count(*) // 2 AS pairs FROM e WHERE grp = og GROUP BY 1, 2),
        ext AS (SELECT * FROM e WHERE grp IS NOT NULL AND grp IS DISTINCT FROM og),
        cl1 AS (SELECT * FROM ext WHERE og IS NOT NULL QUALIFY row_number() OVER (PARTITION BY level, grp, og ORDER BY d, ot) = 1), cl2 AS (SELECT *, row_number() OVER (PARTITION BY level, grp ORDER BY d, ot) AS r FROM cl1),
        ls AS (SELECT * FROM ext WHERE og IS NULL), l1 AS (SELECT * FROM ls QUALIFY row_number() OVER (PARTITION BY level, grp ORDER BY d, ot) = 1),
        lc AS (SELECT l.level, l.grp, count(DISTINCT l.ot) AS n FROM ls l LEFT JOIN cl2 c ON c.level = l.level AND c.grp = l.grp AND c.r = 1 WHERE c.d IS NULL OR l.d < c.d GROUP BY 1, 2)
        SELECT n.*, i.spread, i.spread_median, coalesce(i.pairs, 0) AS pairs, a.og AS nearest, a.ot AS nearest_tip, a.d AS nearest_distance, b.og AS second, b.ot AS second_tip, b.d AS second_distance,
            f.ot AS stray, f.d AS stray_distance, coalesce(t.n, 0) AS strays_closer, CAST(a.d AS DOUBLE) / greatest(coalesce(CAST(i.spread AS DOUBLE), 0), 0.001) AS gap
        FROM nd n LEFT JOIN ins i ON i.level = level_max AND i.grp = n.grp LEFT JOIN cl2 a ON a.level = level_max AND a.grp = n.grp AND a.r = 1 LEFT JOIN cl2 b ON b.level = level_max AND b.grp = n.grp AND b.r = 2
        LEFT JOIN l1 f ON f.level = level_max AND f.grp = n.grp LEFT JOIN lc t ON t.level = level_max AND t.grp = n.grp""",
    "cut_groups": f"WITH RECURSIVE {_CUT} SELECT level, tip, grp FROM cut_",
    "numbered_groups": f"""WITH RECURSIVE {_CUT} SELECT level, grp, row_number() OVER (PARTITION BY level ORDER BY count(*) DESC, min(tip)) - 1 AS number FROM cut_ WHERE grp IS NOT NULL GROUP BY 1, 2""",
    "formed_nodes": f"""WITH RECURSIVE {_CUT} SELECT grp, n_tips, min(level) AS level_min, max(level) AS level_max
        FROM (SELECT level, grp, count(*) AS n_tips FROM cut_ WHERE grp IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2""",
    "enclosing_groups": f"""WITH RECURSIVE {_CUT}, up AS (SELECT level, lead(level) OVER (ORDER BY level) AS above FROM cl)
        SELECT DISTINCT c.level, c.grp, p.grp AS parent FROM cut_ c JOIN up ON up.level = c.level LEFT JOIN cut_ p ON p.level = up.above AND p.tip = c.grp WHERE c.grp IS NOT NULL""",
    "stem_nodes": f"""WITH RECURSIVE {_MERGES}, nd AS (SELECT m.a, m.b, m.height, (SELECT arg_min(u.height, u.step) FROM merges u WHERE u.step > m.step AND m.a IN (u.a, u.b)) AS height_top,
            m.size_a + m.size_b AS size FROM merges m)
        SELECT *, greatest(round((ceil(round(height_top, 6) / 0.0005 - 1e-9) - 1) * 0.0005, 6), height) AS measured_at FROM nd WHERE height <= 0.1 AND height_top - height >= 0.001
            AND NOT (0.03 >= height AND 0.03 < height_top) AND NOT (0.04 >= height AND 0.04 < height_top)""",
    "large_parts": "SELECT p_brand, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) <= 3",
}
