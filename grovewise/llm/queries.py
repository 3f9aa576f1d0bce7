"""Queries of problems 4 to 8, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewise.functions import ids
from grovewise.llm.abuse import labelled, scored, train
from grovewise.llm.bpe import decoded, token_counts, token_ids
from grovewise.llm.consolidate import sets_of
from grovewise.llm.cooccur import tips_together, votes_within
from grovewise.llm.packing import packed
from grovewise.storage import Scratch
from grovewise.plans.tables import table


def _together(spark: SparkSession, sf_dir: str, **thresholds) -> DataFrame:
    return tips_together(table(spark, sf_dir, "manifest"), "plan_id", "members", **thresholds)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tips of a plan in at least 4 distinct shards and at least 3 times as often as chance."""
    found = _together(spark, sf_dir, min_together=4, min_lift=3)
    return found.select("plan_id", F.col("item_a").alias("tip_a"), F.col("item_b").alias("tip_b"))


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and association of every pair of tips that shares a shard, without a threshold."""
    found = _together(spark, sf_dir)
    return found.select("plan_id", F.col("item_a").alias("tip_a"), F.col("item_b").alias("tip_b"), "n_ab", "n_a", "n_b", "n_baskets", "lift", "pmi")


def p4_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each group of the last release's tips, the counts of the pairs of its tips, added up."""
    members = table(spark, sf_dir, "group_members").select(ids.group_id(F.col("group_id")).alias("grp"), ids.tip_id(F.col("tip_id")).alias("tip"))
    return votes_within(table(spark, sf_dir, "manifest"), "plan_id", "members", members.dropna()).withColumnRenamed("grp", "group_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of every tip in ``knn``, by links of at least 86 percent."""
    knn = table(spark, sf_dir, "knn")
    named = knn.select(ids.tip_id(F.col("query")).alias("a"), ids.tip_id(F.col("target")).alias("b"), "identity")
    percent = F.when(F.col("identity") <= 1, F.col("identity") >= 0.86).otherwise(F.col("identity") >= 86)
    found = sets_of(named, "a", "b", percent & ~F.isnan("identity"))
    return found.select(F.col("id").alias("tip_id"), "set_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document by ``byte_bpe_50k``."""
    return token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that the ids of every document stand for."""
    return decoded(p6_ids(spark, sf_dir), "doc_id", "ids")


CAPACITY = 4096


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of every part of a document of more than 4,096 tokens."""
    counts = token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packed(counts, "doc_id", "n_tokens", CAPACITY)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers by the tokens they hold: ``used`` tokens, ``n_containers``, ``n_items``."""
    whole = Scratch(spark).keep(p7_containers(spark, sf_dir))
    each = whole.groupBy("container_id").agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("n"))
    return each.groupBy("used").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_items"))


#: A document from this score on is abusive. Scores lie near 0 or 1; few come between.
ABUSIVE = 0.3


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document for abusive, hateful or sexually explicit language, with its source."""
    documents = table(spark, sf_dir, "documents")
    texts, yes, votes = labelled(documents, table(spark, sf_dir, "review_labels"), "doc_id", "text", "abusive", "reviewer")
    terms = [r[0] for r in table(spark, sf_dir, "abuse_terms").select("term").orderBy("term").collect()]  # fixed, 34 rows
    return scored(documents, "doc_id", "text", train(texts, yes, votes, terms), keep=("source",))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold an abusive passage in the writer's own voice."""
    return p8_scores(spark, sf_dir).filter(F.col("score") >= ABUSIVE).select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, abusive documents and their rate for each source."""
    each = p8_scores(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("score") >= ABUSIVE).alias("n_abusive"))
    return each.withColumn("rate", F.col("n_abusive") / F.col("n_documents"))


_BLANK = r"E' \t\n\r\x0b\x0c  　'"
_TIP = lambda x: f"nullif(nullif(trim(regexp_replace(lower(trim({x}, {_BLANK})), ';size=[0-9]+;?$', ''), {_BLANK}), ''), '*')"
_PAIRS = f"""sets AS (SELECT DISTINCT plan_id, list_sort(list_distinct(list_filter(list_transform(members, lambda x: {_TIP('x')}), lambda x: x IS NOT NULL))) AS items
    FROM manifest WHERE plan_id IS NOT NULL),
basket AS (SELECT plan_id, items, row_number() OVER () AS k FROM sets WHERE len(items) > 0),
total AS (SELECT plan_id, count(*) AS n_baskets FROM basket GROUP BY 1),
item AS (SELECT plan_id, k, unnest(items) AS tip FROM basket),
one AS (SELECT plan_id, tip, count(*) AS n FROM item GROUP BY 1, 2),
two AS (SELECT a.plan_id, a.tip AS tip_a, b.tip AS tip_b, count(*) AS n_ab FROM item a JOIN item b ON a.k = b.k AND a.tip < b.tip GROUP BY 1, 2, 3),
scored AS (SELECT t.plan_id, tip_a, tip_b, n_ab, x.n AS n_a, y.n AS n_b, n_baskets FROM two t JOIN total USING (plan_id)
    JOIN one x ON x.plan_id = t.plan_id AND x.tip = tip_a JOIN one y ON y.plan_id = t.plan_id AND y.tip = tip_b)"""

QUERIES = {f.__name__: f for f in (p4_found, p4_scores, p4_votes, p5_found, p6_ids, p6_roundtrip, p7_containers, p7_fill, p8_found, p8_scores, p8_rates)}

ORACLE = {
    "p4_found": f"WITH {_PAIRS} SELECT plan_id, tip_a, tip_b FROM scored WHERE n_ab >= 4 AND n_ab * n_baskets >= 3 * n_a * n_b",
    "p4_scores": f"WITH {_PAIRS} SELECT plan_id, tip_a, tip_b, n_ab, n_a, n_b, n_baskets, n_ab * n_baskets / (n_a * n_b) AS lift, "
    "log2(n_ab * n_baskets / (n_a * n_b)) AS pmi FROM scored",
    "p4_votes": f"""WITH {_PAIRS}, m AS (SELECT DISTINCT nullif(upper(trim(group_id, {_BLANK})), '') AS group_id, {_TIP('tip_id')} AS tip FROM group_members)
        SELECT a.group_id, CAST(sum(n_ab) AS BIGINT) AS votes FROM scored JOIN m a ON a.tip = tip_a JOIN m b ON b.tip = tip_b AND a.group_id = b.group_id GROUP BY 1""",
    "p6_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p5_found": f"""WITH RECURSIVE named AS (SELECT {_TIP('query')} AS a, {_TIP('target')} AS b, CASE WHEN identity <= 1 THEN identity >= 0.86 ELSE identity >= 86 END AS ok FROM knn),
        tip AS (SELECT a AS id FROM named WHERE a IS NOT NULL UNION SELECT b FROM named WHERE b IS NOT NULL),
        edge AS (SELECT a, b FROM named WHERE ok AND a <> b UNION SELECT b, a FROM named WHERE ok AND a <> b),
        reach AS (SELECT id, id AS at_id FROM tip UNION SELECT r.id, e.b FROM reach r JOIN edge e ON r.at_id = e.a)
        SELECT id AS tip_id, min(at_id) AS set_id FROM reach GROUP BY id""",
}
