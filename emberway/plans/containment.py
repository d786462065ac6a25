"""Queries on containment: region, nation, customer, order and line item as levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberway.functions import styles
from emberway.operators import containment as c
from emberway.plans._registry import query, r, rounded, table

LEVELS = ["region", "nation", "customer"]
PART = 7  #: children in a row, so that parents have several
CLOSURE = """closure AS (SELECT 'n' || n_nationkey AS uid, 'region' AS level, 'r' || n_regionkey AS ancestor FROM nation
UNION SELECT 'c' || c_custkey, 'nation', 'n' || c_nationkey FROM customer UNION SELECT 'c' || c_custkey, 'region', 'r' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION SELECT 'o' || o_orderkey, 'customer', 'c' || o_custkey FROM orders UNION SELECT 'o' || o_orderkey, 'nation', 'n' || c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey
UNION SELECT 'o' || o_orderkey, 'region', 'r' || n_regionkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _links(spark, sf):
    nation, customer, orders = (table(spark, sf, t) for t in ("nation", "customer", "orders"))
    return [
        ("region", nation.select(_id("r", "n_regionkey").alias("parent"), _id("n", "n_nationkey").alias("child"))),
        ("nation", customer.select(_id("n", "c_nationkey").alias("parent"), _id("c", "c_custkey").alias("child"))),
        ("customer", orders.select(_id("c", "o_custkey").alias("parent"), _id("o", "o_orderkey").alias("child"))),
    ]


@query("t1_level_uids", "SELECT 'c' || (row_number() OVER (ORDER BY c_custkey) - 1) AS uid, c_custkey FROM customer")
def uids(spark, sf):
    return c.uids(table(spark, sf, "customer").select("c_custkey"), "c", ["c_custkey"])


@query("t2_children", "SELECT 'n' || c_nationkey AS parent, count(DISTINCT c_custkey) AS n, min('c' || c_custkey) AS first_child FROM customer GROUP BY 1")
def children(spark, sf):
    parts = c.children(_links(spark, sf)[1][1], PART)
    return parts.groupBy("parent").agg(F.sum(F.size("children")).alias("n"), F.min(F.col("children")[0]).alias("first_child"))


@query("t2_child_rows", f"""WITH l AS (SELECT 'c' || o_custkey AS parent, 'o' || o_orderkey AS child FROM orders UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)
SELECT parent, pos, child, pos // {PART} AS part, (n + {PART} - 1) // {PART} AS parts FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY child) - 1 AS pos, count(*) OVER (PARTITION BY parent) AS n FROM l)""")
def child_rows(spark, sf):
    links = [rows for _, rows in _links(spark, sf)]
    return c.child_rows(links[1].unionByName(links[2]), PART)


@query("t3_ancestors", f"WITH {CLOSURE} SELECT uid, level, ancestor FROM closure")
def ancestors(spark, sf):
    return c.ancestors(_links(spark, sf))


@query("t3_parents_map", f"WITH {CLOSURE} SELECT uid, max(CASE WHEN level = 'region' THEN ancestor END) AS region, max(CASE WHEN level = 'nation' THEN ancestor END) AS nation, max(CASE WHEN level = 'customer' THEN ancestor END) AS customer FROM closure GROUP BY uid")
def parents(spark, sf):
    m = c.parents_map(c.ancestors(_links(spark, sf)))
    return m.select("uid", *(F.get(F.try_element_at("parents", F.lit(k)), 0).alias(k) for k in LEVELS))


@query("t3_level_rollup", "SELECT n_regionkey, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_regionkey, c_nationkey)")
def rollup(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.level_counts(rows, ["n_regionkey", "c_nationkey"], F.round(F.sum("c_acctbal"), 2)).drop("depth")


@query("t5_face_colors", "SELECT p_partkey, printf('#%02x%02x%02x', p_size * 5, p_partkey % 256, (p_partkey * 7) % 256) AS color, CAST(CASE WHEN p_size % 2 = 0 THEN 0.4 ELSE p_size / 50.0 END AS DOUBLE) AS opacity FROM part")
def face_colors(spark, sf):
    k = F.col("p_partkey")
    given = F.when(F.col("p_size") % 2 == 1, F.col("p_size") / 50)
    return table(spark, sf, "part").select("p_partkey", styles.hex_color(F.col("p_size") * 5, k % 256, (k * 7) % 256).alias("color"), styles.opacity(given, F.lit(0.4)).alias("opacity"))


@query("t6_raw_records", "SELECT 'region' AS level, 'r' || r_regionkey AS uid FROM region UNION ALL SELECT 'nation', 'n' || n_nationkey FROM nation UNION ALL SELECT 'customer', 'c' || c_custkey FROM customer")
def raw(spark, sf):
    parts = [table(spark, sf, t).select(F.lit(t).alias("level"), _id(t[0], k).alias("uid")) for t, k in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("t7_selection_chain", f"WITH {CLOSURE}, own AS (SELECT * FROM closure UNION SELECT DISTINCT uid, 'own', uid FROM closure) SELECT uid, CAST(row_number() OVER (PARTITION BY uid ORDER BY CASE level WHEN 'region' THEN 1 WHEN 'nation' THEN 2 WHEN 'customer' THEN 3 ELSE 4 END) - 1 AS INTEGER) AS pos, level, ancestor AS entity FROM own")
def chain(spark, sf):
    return c.selection_chain(c.ancestors(_links(spark, sf)), LEVELS, "own")


@query("t8_selection_cycle", "SELECT o_orderkey, ['r', 'n', 'c', 'o'][(o_orderkey + 1) % 4 + 1] AS next_entry FROM orders")
def cycle(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", c.cycled(F.array(*map(F.lit, "rnco")), F.col("o_orderkey")).alias("next_entry"))


@query("t8_next_in_chain", f"WITH {CLOSURE}, own AS (SELECT * FROM closure UNION SELECT DISTINCT uid, 'own', uid FROM closure), chain AS (SELECT uid, CAST(row_number() OVER (PARTITION BY uid ORDER BY CASE level WHEN 'region' THEN 1 WHEN 'nation' THEN 2 WHEN 'customer' THEN 3 ELSE 4 END) - 1 AS INTEGER) AS pos, ancestor AS entity FROM own) SELECT a.uid, a.pos, a.entity, b.entity AS next FROM chain a JOIN (SELECT uid, max(pos) + 1 AS n FROM chain GROUP BY uid) s ON s.uid = a.uid JOIN chain b ON b.uid = a.uid AND b.pos = (a.pos + 1) % n")
def chain_cycle(spark, sf):
    return c.next_in_chain(c.selection_chain(c.ancestors(_links(spark, sf)), LEVELS, "own")).drop("level")


@query("t9_entities_below", f"WITH {CLOSURE} SELECT DISTINCT uid FROM closure WHERE level = 'nation' AND ancestor = 'n3'")
def below(spark, sf):
    return c.below(c.nested(_links(spark, sf), "order"), F.col("uid") == "n3")


@query("t9_entities_below_many", f"WITH {CLOSURE} SELECT DISTINCT uid FROM closure WHERE (level = 'nation' AND CAST(substr(ancestor, 2) AS BIGINT) % 5 = 0) OR (level = 'customer' AND CAST(substr(ancestor, 2) AS BIGINT) % 2 = 1)")
def below_many(spark, sf):
    number = F.substring("uid", 2, 20).cast("long")
    nations, customers = (F.col("level") == "nation") & (number % 5 == 0), (F.col("level") == "customer") & (number % 2 == 1)
    return c.below(c.nested(_links(spark, sf), "order"), nations | customers)


@query("t9_nested_spans", f"""WITH {CLOSURE}, entity AS (SELECT uid FROM closure UNION SELECT ancestor FROM closure), link AS (SELECT uid, max(CASE level WHEN 'region' THEN ancestor END) AS r, max(CASE level WHEN 'nation' THEN ancestor END) AS n, max(CASE level WHEN 'customer' THEN ancestor END) AS c FROM closure GROUP BY uid),
path AS (SELECT entity.uid, list_filter([r, n, c, entity.uid], lambda x: x IS NOT NULL) AS path FROM entity LEFT JOIN link USING (uid)), below AS (SELECT ancestor AS uid, count(*) AS n FROM closure GROUP BY 1)
SELECT uid, CASE uid[1] WHEN 'r' THEN 'region' WHEN 'n' THEN 'nation' WHEN 'c' THEN 'customer' ELSE 'order' END AS level, lo, lo + coalesce(n, 0) AS hi FROM (SELECT uid, row_number() OVER (ORDER BY path) - 1 AS lo FROM path) LEFT JOIN below USING (uid)""")
def spans(spark, sf):
    return c.nested(_links(spark, sf), "order").drop("path")


@query("t10_color_components", f"SELECT p_partkey, {r('p_size / CASE WHEN p_size > 1 OR p_partkey % 256 > 1 THEN 255.0 ELSE 1 END')} AS red, {r('(p_partkey % 256) / CASE WHEN p_size > 1 OR p_partkey % 256 > 1 THEN 255.0 ELSE 1 END')} AS green FROM part")
def components(spark, sf):
    rgb = styles.unit_components(F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 256).cast("double")))
    return rounded(table(spark, sf, "part").select("p_partkey", rgb[0].alias("red"), rgb[1].alias("green")), "red", "green")


@query("t11_opacities", f"SELECT p_partkey, {r('least(greatest(coalesce(CASE WHEN p_size % 3 = 0 THEN p_size / 25.0 END, CASE WHEN p_size % 3 = 1 THEN 0.25 END, 0.6), 0), 1)')} AS opacity FROM part")
def opacities(spark, sf):
    s = F.col("p_size")
    return rounded(table(spark, sf, "part").select("p_partkey", styles.opacity(F.when(s % 3 == 0, s / 25), F.when(s % 3 == 1, 0.25)).alias("opacity")), "opacity")


@query("t12_translucent", "SELECT p_partkey, CAST(CASE WHEN p_size > 25 THEN 0.25 ELSE 0.6 END AS DOUBLE) AS opacity FROM part")
def translucent(spark, sf):
    return table(spark, sf, "part").select("p_partkey", styles.opacity(F.when(F.col("p_size") > 25, 0.25)).alias("opacity"))


@query("t13_sorted_entries", "SELECT event_id, 'k=' || CAST(props->>'k' AS VARCHAR) || ';type=' || event_type AS entries FROM events")
def entries(spark, sf):
    props = F.from_json("props", "map<string,string>")
    all_ = F.map_concat(props, F.create_map(F.lit("type"), F.col("event_type")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(all_)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return table(spark, sf, "events").select("event_id", text.alias("entries"))


@query("t14_value_opacity", "SELECT n_nationkey, CAST(round_even(n_nationkey + 1 / 25.0, 4) AS DOUBLE) AS opacity FROM nation")
def value_opacity(spark, sf):
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", F.bround(F.col("n_nationkey") + F.lit(1) / F.lit(25.0), 4).alias("opacity"))


@query("t15_display_nodes", "SELECT n_nationkey AS id, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS DOUBLE) END, (n_nationkey * 2 + n_nationkey * 4) / 2.0) AS x FROM nation")
def display(spark, sf):
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(k.alias("id"), F.coalesce(F.when(k % 2 == 0, k.cast("double")), (k * 2 + k * 4) / 2).alias("x"))
