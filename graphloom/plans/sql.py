"""SQL of the trade graph and of the fixed map, shared by the catalogue's SQL forms."""

#: types: type_id, node_type, n, off.
T = """WITH types AS (SELECT type_id, node_type, n::BIGINT AS n, (sum(n) OVER (ORDER BY type_id) - n)::BIGINT AS off FROM (
SELECT 0 AS type_id, 'customer' AS node_type, count(*) AS n FROM customer UNION ALL SELECT 1, 'order', count(*) FROM orders UNION ALL SELECT 2, 'part', count(*) FROM part
UNION ALL SELECT 3, 'supplier', count(*) FROM supplier UNION ALL SELECT 4, 'nation', count(*) FROM nation))
"""
#: rel: edges of all relations; g: the same with global ids.
REL = """, rel AS (SELECT 'customer' AS src_type, 'places' AS rel, 'order' AS dst_type, o_custkey AS src, o_orderkey AS dst FROM orders
UNION ALL SELECT 'order', 'placed_by', 'customer', o_orderkey, o_custkey FROM orders UNION ALL SELECT 'order', 'contains', 'part', l_orderkey, l_partkey FROM lineitem
UNION ALL SELECT 'part', 'supplied_by', 'supplier', l_partkey, l_suppkey FROM lineitem UNION ALL SELECT 'customer', 'in', 'nation', c_custkey, c_nationkey FROM customer
UNION ALL SELECT 'supplier', 'in', 'nation', s_suppkey, s_nationkey FROM supplier),
g AS (SELECT rel.*, a.off + src AS s, b.off + dst AS d, a.type_id AS st, b.type_id AS dt FROM rel JOIN types a ON src_type = a.node_type JOIN types b ON dst_type = b.node_type)
"""
#: e: distinct undirected edges; adj: both directions.
E = """, e AS (SELECT DISTINCT least(s, d) AS u, greatest(s, d) AS v FROM g WHERE s <> d), adj AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e)
"""
#: nodes with labels and flags; degs and caps where adj is there.
D = """, nodes AS (SELECT type_id, node_id, off + node_id AS gid, y, y IS NOT NULL AND node_id % 10 < 6 AS is_train, y IS NOT NULL AND node_id % 10 IN (6, 7) AS is_val, y IS NOT NULL AND node_id % 10 >= 8 AS is_test FROM (
SELECT 0 AS type_id, c_custkey AS node_id, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS y FROM customer UNION ALL SELECT 1, o_orderkey, NULL FROM orders UNION ALL SELECT 2, p_partkey, NULL FROM part
UNION ALL SELECT 3, s_suppkey, NULL FROM supplier UNION ALL SELECT 4, n_nationkey, NULL FROM nation) JOIN types USING (type_id)),
degs AS (SELECT nodes.gid, type_id, coalesce(n, 0) AS degree FROM nodes LEFT JOIN (SELECT gid, count(*) AS n FROM (SELECT least(s, d) AS a, greatest(s, d) AS b, unnest([least(s, d), greatest(s, d)]) AS gid FROM g WHERE s <> d GROUP BY least(s, d), greatest(s, d)) GROUP BY 1) USING (gid)),
caps AS (SELECT type_id, greatest(1, round(avg(degree) + 3 * stddev_pop(degree)))::BIGINT AS cap FROM degs GROUP BY 1)
"""
#: m: the map of four neighbours in id, with super ids.
MAP = """, m AS (SELECT type_id, node_id, gid, gid - node_id % 4 AS root, (dense_rank() OVER (PARTITION BY type_id ORDER BY gid - node_id % 4) - 1)::BIGINT AS super_id FROM nodes)
"""
#: q: quotient edges of m.
Q = """, q AS (SELECT src_type, rel, dst_type, a.super_id AS ssn, b.super_id AS dsn, count(*)::BIGINT AS cnt FROM g JOIN m a ON a.gid = s JOIN m b ON b.gid = d GROUP BY ALL)
"""
#: x: standardised features (gid, type_id, i, a).
M = """, raw AS (SELECT 0 AS type_id, c_custkey AS node_id, 0 AS i, c_acctbal AS a FROM customer
UNION ALL SELECT 0, c_custkey, 1, ln(1 + coalesce(k, 0)) FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey
UNION ALL SELECT 1, o_orderkey, 0, o_totalprice FROM orders UNION ALL SELECT 1, o_orderkey, 1, substr(o_orderpriority, 1, 1)::DOUBLE FROM orders
UNION ALL SELECT 2, p_partkey, 0, p_size::DOUBLE FROM part UNION ALL SELECT 2, p_partkey, 1, p_retailprice FROM part UNION ALL SELECT 3, s_suppkey, 0, s_acctbal FROM supplier),
stat AS (SELECT type_id, i, avg(a) AS mu, stddev_pop(a) AS sd FROM raw GROUP BY ALL),
x AS (SELECT off + node_id AS gid, raw.type_id, raw.i::BIGINT AS i, (a - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS a FROM raw JOIN stat USING (type_id, i) JOIN types USING (type_id))
"""
#: kx: normalised features, nations filled with their log in-degree (one dimension: 1 after normalising).
K = """, kx AS (SELECT gid, type_id, i, a / greatest(sqrt(sum(a * a) OVER (PARTITION BY gid)), 1e-8) AS a FROM x UNION ALL SELECT gid, type_id, 0, CASE WHEN gid IN (SELECT d FROM g) THEN 1.0 ELSE 0.0 END FROM nodes WHERE type_id = 4)
"""
#: lists: neighbours of mediators within their caps.
LISTS = """, near AS (SELECT a.u AS med, dm.type_id AS t_med, a.v AS u, du.type_id AS t_src FROM adj a JOIN degs dm ON dm.gid = a.u JOIN caps ON caps.type_id = dm.type_id AND dm.degree <= cap JOIN degs du ON du.gid = a.v),
lists AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY med, t_src) AS k FROM near) WHERE k >= 2)
"""
#: ordered: ranks along the projection; strided: thinned to 16.
ORDERED = """, proj AS (SELECT gid, round(sum(a * CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END), 6) AS p FROM kx GROUP BY 1),
ordered AS (SELECT lists.*, row_number() OVER (PARTITION BY med, t_src ORDER BY p, u) - 1 AS r FROM lists JOIN proj ON gid = u),
strided AS (SELECT med, t_med, u, t_src, k, row_number() OVER (PARTITION BY med, t_src ORDER BY r) - 1 AS r FROM ordered WHERE k <= 16 OR (ceil(r * 16 / k) < 16 AND floor(ceil(r * 16 / k) * k / 16) = r))
"""
#: pairs: ranks at most 4 apart, with cost.
PAIRS = """, band AS (SELECT a.med, a.t_src, a.u, b.u AS v, b.r - a.r AS gap FROM strided a JOIN strided b ON a.med = b.med AND a.t_src = b.t_src AND b.r - a.r BETWEEN 1 AND 4),
dup AS (SELECT u, v, 0.5 * sum((xu.a - xv.a) * (xu.a - xv.a)) AS cost FROM (SELECT DISTINCT u, v FROM band) JOIN kx xu ON xu.gid = u JOIN kx xv ON xv.gid = v AND xv.i = xu.i GROUP BY ALL),
pairs AS (SELECT band.*, cost FROM band JOIN dup USING (u, v))
"""
