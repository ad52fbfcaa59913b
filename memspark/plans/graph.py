"""Registered queries: graph (GR)."""

from pyspark.sql import functions as F

from ..operators import graph as G, joins as J
from ..session import spread
from ..views import edges, knowledge, observations, table, ts
from .registry import query, sql


def dated(spark, sf):
    """Every line item as a write of a supplier - part edge."""
    li = table(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_linestatus").alias("type"),
                     F.col("l_quantity").alias("weight"), F.col("l_shipdate").alias("updated_at"))


@query("gr1_upsert_edges", """SELECT concat('s', l_suppkey) AS src, concat('p', l_partkey) AS dst, l_linestatus AS type, l_quantity AS weight FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_linestatus ORDER BY l_shipdate DESC, l_quantity DESC) = 1""")
def gr1(spark, sf):
    return G.upsert_edges(dated(spark, sf)).select("src", "dst", "type", "weight")


@query("gr1_upsert_entities", "SELECT concat('s', l_suppkey) AS name, l_linestatus AS type, CAST(epoch(min(l_shipdate)) AS BIGINT) AS created_s, CAST(epoch(max(l_shipdate)) AS BIGINT) AS updated_s FROM lineitem GROUP BY ALL")
def gr1e(spark, sf):
    e = G.upsert_entities(dated(spark, sf).select(F.col("src").alias("name"), "type", "updated_at"))
    return e.select("name", "type", F.unix_timestamp("created_at").alias("created_s"), F.unix_timestamp("updated_at").alias("updated_s"))


@query("gr2_remove_entities", sql("""SELECT src, count(*) AS n FROM v_edges WHERE src NOT IN (SELECT concat('s', s_suppkey) FROM supplier WHERE s_acctbal < 0) AND dst NOT IN (SELECT concat('p', p_partkey) FROM part WHERE p_size < 10) GROUP BY src""", "v_edges"))
def gr2(spark, sf):
    gone = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node")).unionByName(
        table(spark, sf, "part").where("p_size < 10").select(F.concat(F.lit("p"), "p_partkey").alias("node")))
    return G.remove_entities(edges(spark, sf), gone).groupBy("src").agg(F.count("*").alias("n"))


def entity_rows(spark, sf):
    """Suppliers and parts as entities; a part and a supplier may have one name."""
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), (F.col("s_suppkey") % 40).cast("string")).alias("name"), F.lit("person").alias("type"), F.col("s_nationkey").cast("string").alias("metadata"))
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(F.lit("n"), (F.col("p_partkey") % 60).cast("string")).alias("name"), F.lit("module").alias("type"), F.col("p_size").cast("string").alias("metadata"))
    return s.unionByName(p).withColumn("updated_at", ts("2024-01-01 00:00:00"))


_ENT = """en AS (SELECT concat('s', s_suppkey) AS id, concat('n', s_suppkey % 40) AS name, 'person' AS type, CAST(s_nationkey AS VARCHAR) AS metadata FROM supplier
 UNION ALL SELECT concat('p', p_partkey), concat('n', p_partkey % 60), 'module', CAST(p_size AS VARCHAR) FROM part)"""


@query("gr2_find_entities", f"""WITH {_ENT} SELECT n_nationkey AS query_id, id, name, type FROM nation JOIN en ON name = concat('n', n_nationkey * 3) AND (n_nationkey % 3 = 0 OR type = CASE n_nationkey % 3 WHEN 1 THEN 'person' ELSE 'module' END)""")
def gr2f(spark, sf):
    """Exact names, for a third of the questions of any type, else of one."""
    n = F.col("n_nationkey")
    q = table(spark, sf, "nation").select(n.alias("query_id"), F.concat(F.lit("n"), (n * 3).cast("string")).alias("name"), F.when(n % 3 == 1, "person").when(n % 3 == 2, "module").alias("type"))
    return G.find_entities(entity_rows(spark, sf), q).select("query_id", "id", "name", "type")


@query("gr2_update_entities", f"""WITH {_ENT}, up AS (SELECT concat('p', l_partkey) AS id, arg_max(CASE WHEN l_returnflag = 'R' THEN concat('r', l_suppkey) END, (epoch(l_shipdate) * 1000000 + l_orderkey) * 10 + l_linenumber) FILTER (l_returnflag = 'R') AS name,
 arg_max(l_linestatus, (epoch(l_shipdate) * 1000000 + l_orderkey) * 10 + l_linenumber) FILTER (l_linenumber = 2) AS metadata FROM lineitem WHERE l_partkey % 5 = 0 AND (l_returnflag = 'R' OR l_linenumber = 2) GROUP BY l_partkey)
SELECT id, coalesce(up.name, en.name) AS name, type, coalesce(up.metadata, en.metadata) AS metadata, up.id IS NOT NULL AS updated FROM en LEFT JOIN up USING (id)""")
def gr2u(spark, sf):
    """New names and metadata, the last write of each field counts."""
    li = table(spark, sf, "lineitem").where("l_partkey % 5 = 0 AND (l_returnflag = 'R' OR l_linenumber = 2)")
    up = li.select(F.concat(F.lit("p"), "l_partkey").alias("id"), ((F.unix_seconds(F.col("l_shipdate").cast("timestamp")) * 1000000 + F.col("l_orderkey")) * 10 + F.col("l_linenumber")).alias("at"),
                   F.when(F.col("l_returnflag") == "R", F.concat(F.lit("r"), "l_suppkey")).alias("name"), F.when(F.col("l_linenumber") == 2, F.col("l_linestatus")).alias("metadata"))
    r = G.update_entities(entity_rows(spark, sf), up, ts("2024-02-01 00:00:00"))
    return r.select("id", "name", "type", "metadata", (F.col("updated_at") > ts("2024-01-15 00:00:00")).alias("updated"))


_SEEDS = "sd AS (SELECT concat('s', min(s_suppkey)) AS node FROM supplier GROUP BY s_nationkey)"


def seeds(spark, sf):
    """The first supplier of every nation."""
    return table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("m")).select(F.concat(F.lit("s"), "m").alias("node"))


_BOTH = "bo AS (SELECT src AS a, dst AS b FROM v_edges UNION SELECT dst, src FROM v_edges)"
_WALK = f"{_SEEDS}, {_BOTH}, h1 AS (SELECT DISTINCT node AS seed, b AS node FROM sd JOIN bo ON a = node), h2 AS (SELECT DISTINCT seed, b AS node FROM h1 JOIN bo ON a = node)," \
        " al AS (SELECT node AS seed, node, 0 AS hops FROM sd UNION ALL SELECT seed, node, 1 FROM h1 UNION ALL SELECT seed, node, 2 FROM h2), re AS (SELECT seed, node, min(hops) AS hops FROM al GROUP BY ALL)"


@query("gr3_neighbours", sql("SELECT seed, hops, count(*) AS n FROM re WHERE hops > 0 GROUP BY ALL", "v_edges", ctes=_WALK + "\n"))
def gr3(spark, sf):
    return G.neighbourhood(edges(spark, sf), seeds(spark, sf), 2).where("hops > 0").groupBy("seed", "hops").agg(F.count("*").alias("n"))


@query("gr3_out_neighbours", sql("SELECT seed, dst AS node FROM (SELECT node AS seed FROM sd) JOIN v_edges ON src = seed", "v_edges", ctes=_SEEDS + "\n"))
def gr3o(spark, sf):
    return G.neighbourhood(edges(spark, sf), seeds(spark, sf), 1, "out").where("hops > 0").select("seed", "node")


@query("gr4_subgraph", sql("SELECT seed, count(*) AS edges FROM (SELECT DISTINCT seed, src, dst FROM re JOIN v_edges ON src = node OR dst = node WHERE hops < 2) GROUP BY seed", "v_edges", ctes=_WALK + "\n"))
def gr4(spark, sf):
    e = edges(spark, sf).select("src", "dst")
    reach = G.neighbourhood(e, seeds(spark, sf), 2)
    return G.subgraph_edges(e, reach, 2).groupBy("seed").agg(F.count("*").alias("edges"))


@query("gr5_neighbour_pairs", sql("SELECT a AS node, b AS other, weight FROM (SELECT src AS a, dst AS b, weight FROM v_edges UNION ALL SELECT dst, src, weight FROM v_edges) JOIN sd ON node = a QUALIFY row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) <= 5", "v_edges", ctes=_SEEDS + "\n"))
def gr5(spark, sf):
    return G.neighbour_pairs(edges(spark, sf), seeds(spark, sf), 5).select("node", "other", "weight")


_PATHRE = r"(?:^|\s|[''\"`(])([./]?(?:[\w-]+/)+[\w.-]+\.\w+)"
_GK = f"""gk AS (SELECT title, CASE category WHEN 'pattern' THEN 'pattern' WHEN 'decision' THEN 'decision' WHEN 'error' THEN 'bug' WHEN 'api' THEN 'service' ELSE 'module' END AS type,
 regexp_extract_all(concat(content, ' src/', project, '/', category, '.ts'), '{_PATHRE}', 1) AS ps FROM v_knowledge)"""


def with_paths(spark, sf):
    """Entries whose text also names a file of their project."""
    return spread(knowledge(spark, sf), "id").withColumn("content", F.concat("content", F.lit(" src/"), "project", F.lit("/"), "category", F.lit(".ts")))


@query("gr6_graph_edges", sql("SELECT DISTINCT title AS src, p AS dst FROM (SELECT title, unnest(ps) AS p FROM gk)", "v_knowledge", ctes=_GK + "\n"))
def gr6(spark, sf):
    return G.from_knowledge(with_paths(spark, sf))[1].select("src", "dst")


@query("gr6_graph_entities", sql("SELECT type, count(*) AS n FROM (SELECT DISTINCT title AS name, type FROM gk UNION SELECT unnest(ps), 'file' FROM gk) GROUP BY type", "v_knowledge", ctes=_GK + "\n"))
def gr6e(spark, sf):
    return G.from_knowledge(with_paths(spark, sf))[0].groupBy("type").agg(F.count("*").alias("n"))


@query("gr7_degree_ranking", sql("SELECT node, count(*) AS degree FROM (SELECT src AS node FROM v_edges UNION ALL SELECT dst FROM v_edges) GROUP BY node ORDER BY degree DESC, node LIMIT 20", "v_edges"))
def gr7(spark, sf):
    return J.degrees(edges(spark, sf)).orderBy(F.desc("degree"), "node").limit(20)
