"""Queries of problems 1 to 3 over ``groups``, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewise.operators.forest import descendants, hierarchy
from grovewise.operators.hotkeys import top_per_key, totals_per_key
from grovewise.operators.snapshots import changes
from grovewise.plans.tables import current_groups, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three groups with the most tips, for each release and component."""
    rows = current_groups(spark, sf_dir, ["component", "n_tips"])
    counted = rows.filter(F.col("component").isNotNull() & F.col("n_tips").isNotNull())
    best = top_per_key(counted, ["release", "component"], [("n_tips", "descending"), ("group_id", "ascending")], 3)
    return best.select("release", "component", "group_id")


def p1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, counted groups, tips and largest group of each release and component."""
    rows = current_groups(spark, sf_dir, ["component", "n_tips"])
    return totals_per_key(
        rows, ["release", "component"], n_groups=F.count(F.lit(1)), n_counted=F.count("n_tips"),
        tips=F.sum(F.col("n_tips").cast("long")), largest=F.max("n_tips"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of every group of the last release."""
    return hierarchy(current_groups(spark, sf_dir, ["parent_id"], last_only=True), "group_id", "parent_id")


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path from the root of every group of the last release; null on and below a cycle."""
    whole = hierarchy(current_groups(spark, sf_dir, ["parent_id"], last_only=True), "group_id", "parent_id", with_path=True)
    return whole.select("group_id", "root_id", "depth", F.array_join("path", "/").alias("path"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group and each group below it."""
    whole = hierarchy(current_groups(spark, sf_dir, ["parent_id"], last_only=True), "group_id", "parent_id", with_path=True)
    return descendants(whole, "group_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups added, removed or changed in ``n_tips`` between consecutive releases."""
    releases = table(spark, sf_dir, "releases").select("release", "seq_no")
    span = releases.agg(F.min("seq_no"), F.max("seq_no")).first()
    rows = current_groups(spark, sf_dir, ["n_tips"]).join(releases, "release")
    found = changes(rows, "seq_no", span[1] or 0, "group_id", ["n_tips"], first=span[0] or 0)
    return found.join(releases, "seq_no").select("release", "group_id", "change")


_CURRENT = r"""
named AS (SELECT release, delivered_at, nullif(upper(trim(group_id, E' \t\n\r\x0b\x0c  　')), '') AS group_id,
    nullif(lower(trim(component, E' \t\n\r\x0b\x0c  　')), '') AS component, n_tips,
    nullif(upper(trim(parent_id, E' \t\n\r\x0b\x0c  　')), '') AS parent_id FROM groups),
cur AS (SELECT release, group_id, component, n_tips, parent_id FROM named WHERE group_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY release, group_id ORDER BY delivered_at DESC NULLS LAST) = 1)"""

_LAST = _CURRENT + """,
last AS (SELECT group_id, parent_id FROM cur WHERE release = (SELECT arg_max(release, seq_no) FROM releases)),
link AS (SELECT l.group_id, p.group_id AS parent_id FROM last l LEFT JOIN last p ON l.parent_id = p.group_id),
walk AS (SELECT group_id, group_id AS root_id, 0 AS depth, group_id AS path FROM link WHERE parent_id IS NULL
    UNION ALL SELECT l.group_id, w.root_id, w.depth + 1, w.path || '/' || l.group_id FROM link l JOIN walk w ON l.parent_id = w.group_id),
lost AS (SELECT group_id, parent_id FROM link WHERE group_id NOT IN (SELECT group_id FROM walk)),
loop AS (SELECT group_id, group_id AS here, 0 AS n FROM lost
    UNION SELECT o.group_id, l.parent_id, o.n + 1 FROM loop o JOIN lost l ON o.here = l.group_id WHERE o.n <= (SELECT count(*) FROM lost)),
ring AS (SELECT DISTINCT group_id FROM loop WHERE n > 0 AND here = group_id),
astray AS (SELECT group_id, min(here) AS root_id, -1 AS depth, CAST(NULL AS VARCHAR) AS path FROM loop WHERE here IN (SELECT group_id FROM ring) GROUP BY 1)"""

QUERIES = {f.__name__: f for f in (p1_found, p1_totals, p2_found, p2_paths, p2_descendants, p3_found)}

ORACLE = {
    "p1_found": f"WITH {_CURRENT} SELECT release, component, group_id FROM cur WHERE component IS NOT NULL AND n_tips IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY release, component ORDER BY n_tips DESC, group_id) <= 3",
    "p1_totals": f"WITH {_CURRENT} SELECT release, component, count(*) AS n_groups, count(n_tips) AS n_counted, "
    "CAST(sum(n_tips) AS BIGINT) AS tips, max(n_tips) AS largest FROM cur GROUP BY release, component",
    "p2_found": f"WITH RECURSIVE {_LAST} SELECT group_id, root_id, depth FROM walk UNION ALL SELECT group_id, root_id, depth FROM astray",
    "p2_paths": f"WITH RECURSIVE {_LAST} SELECT group_id, root_id, depth, path FROM walk UNION ALL SELECT * FROM astray",
    "p2_descendants": f"""WITH RECURSIVE {_LAST}, up AS (SELECT l.group_id AS descendant_id, l.parent_id AS group_id, 1 AS distance
        FROM link l JOIN walk w ON l.group_id = w.group_id WHERE l.parent_id IS NOT NULL
        UNION ALL SELECT u.descendant_id, l.parent_id, u.distance + 1 FROM up u JOIN link l ON u.group_id = l.group_id WHERE l.parent_id IS NOT NULL)
        SELECT group_id, descendant_id, distance FROM up
        UNION ALL SELECT here, group_id, min(n) FROM loop WHERE here <> group_id GROUP BY 1, 2""",
    "p3_found": f"""WITH {_CURRENT}, held AS (SELECT c.group_id, c.n_tips, r.seq_no FROM cur c JOIN releases r ON c.release = r.release),
        pair AS (SELECT seq_no, lag(seq_no) OVER (ORDER BY seq_no) AS old FROM releases)
        SELECT r.release, coalesce(n.group_id, o.group_id) AS group_id,
            CASE WHEN o.group_id IS NULL THEN 'added' WHEN n.group_id IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM (SELECT p.seq_no, a.group_id, a.n_tips FROM pair p JOIN held a ON a.seq_no = p.seq_no WHERE p.old IS NOT NULL) n
        FULL JOIN (SELECT p.seq_no, a.group_id, a.n_tips FROM pair p JOIN held a ON a.seq_no = p.old) o
            ON n.seq_no = o.seq_no AND n.group_id = o.group_id
        JOIN releases r ON r.seq_no = coalesce(n.seq_no, o.seq_no)
        WHERE o.group_id IS NULL OR n.group_id IS NULL OR n.n_tips IS DISTINCT FROM o.n_tips""",
}
