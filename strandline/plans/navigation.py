"""Queries on navigation maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maps, ranking, resolve
from . import base, graph


def _members(spark, sf_dir):
    n = graph._nodes(spark, sf_dir)
    role = F.element_at(F.array(*map(F.lit, maps.ROLES)), (F.length("canonical_key") % 5 + 1).cast("int"))
    g = n.select("node_id", F.explode(F.array(F.substring("canonical_key", 1, 1), F.substring("canonical_key", -1, 1))).alias("group_id"), role.alias("role"), (F.col("n_claims") > 1).alias("is_current"), F.col("n_claims").cast("double").alias("salience"))
    return n, g


def group_memberships(spark, sf_dir):
    n, g = _members(spark, sf_dir)
    seeds = n.where("n_documents > 2").select(F.substring("canonical_key", 1, 1).alias("group_id"), "node_id")
    return maps.assemble(g, seeds)


def recency_ranks(spark, sf_dir):
    n = graph._nodes(spark, sf_dir).select("node_id", "title", "first_seen", "last_seen")
    return ranking.global_rank(n, maps.recency_order(), "place").select("node_id", "place")


def latest_claims(spark, sf_dir):
    s = resolve.states(graph._claims(spark, sf_dir))
    last = s.groupBy("canonical_key").agg(F.max("state_no").alias("state_no"))
    return maps.latest_claims(s, s.join(last, ["canonical_key", "state_no"]))


def repaired_ids(spark, sf_dir):
    """Ids of edges' ends cut to their last part, or with a part too many, against the nodes'."""
    n = graph._nodes(spark, sf_dir).select(F.concat("node_id", F.lit(":v1")).alias("id"), "node_id", "n_claims")
    given = n.select(F.when(F.col("n_claims") > 1, F.concat("node_id", F.lit(":v2"))).otherwise(F.col("id")).alias("id"))
    return maps.repaired_ids(given, n)


def node_layout(spark, sf_dir):
    return maps.layout(_members(spark, sf_dir)[1].where("role = 'core'").dropDuplicates(["group_id", "node_id"]))


QUERIES = {f.__name__: f for f in (group_memberships, recency_ranks, latest_claims, repaired_ids, node_layout)}
base.CTES |= {
    "mem": (("node",), "SELECT node_id, unnest([substr(canonical_key, 1, 1), right(canonical_key, 1)]) AS group_id, length(canonical_key) % 5 AS k, n_claims > 1 AS c, n_claims::DOUBLE AS salience FROM node"),
}
_ROLE = "['core', 'current', 'supporting', 'tension', 'context']"
SQL = {
    "group_memberships": base.sql(f"""SELECT group_id, node_id, {_ROLE}[(CASE WHEN k = 0 AND cr > 12 THEN 2 ELSE k END) + 1] AS role, c AND ur <= 8 AS is_current FROM (SELECT *, row_number() OVER (PARTITION BY group_id, k = 0 ORDER BY salience DESC, node_id) AS cr, row_number() OVER (PARTITION BY group_id, c ORDER BY salience DESC, node_id) AS ur
FROM (SELECT m.group_id, m.node_id, CASE WHEN any_value(n.n_documents) > 2 AND m.group_id = substr(any_value(n.canonical_key), 1, 1) THEN 0 ELSE min(m.k) END AS k, bool_or(m.c) AS c, max(m.salience) AS salience FROM mem m JOIN node n USING (node_id) GROUP BY m.group_id, m.node_id))""", "mem", "node"),
    "recency_ranks": base.sql("SELECT node_id, row_number() OVER (ORDER BY last_seen DESC NULLS LAST, first_seen DESC NULLS LAST, title, node_id) AS place FROM node", "node"),
    "latest_claims": base.sql("SELECT canonical_key, claim_id, rank, cur FROM (SELECT *, row_number() OVER (PARTITION BY canonical_key ORDER BY cur DESC, time_unix DESC NULLS LAST, chronology_index DESC, claim_id) AS rank FROM (SELECT *, (state_no = max(state_no) OVER (PARTITION BY canonical_key))::INT AS cur FROM state)) WHERE rank <= 3", "state"),
    "repaired_ids": base.sql("SELECT node_id || CASE WHEN n_claims > 1 THEN ':v2' ELSE ':v1' END AS id, node_id || ':v1' AS valid_id FROM node", "node"),
    "node_layout": base.sql("""SELECT group_id, node_id, round(cos(g * 2.399963229728653) * sqrt(g) * 12 + cos(r * 2.399963229728653) * sqrt(r), 4) AS x, round(sin(g * 2.399963229728653) * sqrt(g) * 12 + sin(r * 2.399963229728653) * sqrt(r), 4) AS y FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY salience DESC, node_id) - 1 AS r FROM core)
JOIN (SELECT group_id, row_number() OVER (ORDER BY count(*) DESC, group_id) - 1 AS g FROM core GROUP BY group_id) USING (group_id)""", "mem").replace("\nSELECT group_id, node_id, round", ", core AS (SELECT DISTINCT group_id, node_id, salience FROM mem WHERE k = 0)\nSELECT group_id, node_id, round", 1),
}
