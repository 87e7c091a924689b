"""The same results as SQL, by comparing pairs and following links one by one."""

from __future__ import annotations

import re

# Addresses and users

_LINES = """
lines AS (
  SELECT DISTINCT l_orderkey AS tx, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         l_partkey || '-' || l_suppkey AS address
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AND l_returnflag <> 'R'
    AND o_orderdate BETWEEN (SELECT min(o_orderdate) FROM orders) AND (SELECT max(o_orderdate) FROM orders)
),
pairs AS (
  SELECT address, lead(address) OVER (
    PARTITION BY tx ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS next_address
  FROM lines
),
links AS (
  SELECT DISTINCT least(address, next_address) AS src, greatest(address, next_address) AS dst
  FROM pairs WHERE next_address IS NOT NULL AND address <> next_address
),
addresses AS (
  SELECT address AS id FROM lines
  UNION
  SELECT l_partkey || '-' || l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AND l_returnflag = 'R'
    AND o_orderdate BETWEEN (SELECT min(o_orderdate) FROM orders) AND (SELECT max(o_orderdate) FROM orders)
)"""


def _components(nodes: str, links: str, name: str) -> str:
    """Smallest reachable node of every node."""
    return f"""
{name}_ends AS (
  SELECT src AS a, dst AS b FROM {links} UNION ALL SELECT dst, src FROM {links}
),
{name}(id, component) USING KEY (id) AS (
  SELECT id, id FROM {nodes}
  UNION
  SELECT e.b, min(c.component) FROM {name} c JOIN {name}_ends e ON e.a = c.id
  JOIN recurring.{name} r ON r.id = e.b
  WHERE c.component < r.component GROUP BY e.b
)"""


_USERS = f"""{_LINES},{_components('addresses', 'links', 'parts')},
users AS (
  SELECT id AS address, dense_rank() OVER (ORDER BY component) - 1 AS user_id FROM parts
)"""

_PAID = """
paid_orders AS (
  SELECT o_orderkey AS tx, o_orderdate FROM orders
  WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'
    AND o_orderdate > (SELECT min(o_orderdate) FROM orders)
    AND o_orderdate < (SELECT max(o_orderdate) FROM orders)
),
senders AS (
  SELECT tx, first(l_partkey || '-' || l_suppkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS address
  FROM lineitem JOIN paid_orders ON tx = l_orderkey WHERE l_returnflag <> 'R' GROUP BY tx
),
receivers AS (
  SELECT tx, l_partkey || '-' || l_suppkey AS address, l_extendedprice AS value
  FROM lineitem JOIN paid_orders ON tx = l_orderkey WHERE l_returnflag = 'R'
)"""

_USER_PAID = f"""{_USERS},{_PAID},
user_paid AS (
  SELECT f.user_id AS from_user, t.user_id AS to_user, r.value
  FROM senders s JOIN receivers r USING (tx)
  JOIN users f ON f.address = s.address JOIN users t ON t.address = r.address
)"""

_PAYMENT_EDGES = f"""WITH RECURSIVE {_USER_PAID}
SELECT least(from_user, to_user) AS src, greatest(from_user, to_user) AS dst,
       round(sum(CAST(value AS DECIMAL(18, 2)))::DOUBLE, 6) AS value, count(*) AS count
FROM user_paid WHERE from_user <> to_user GROUP BY 1, 2"""

# The same orders within a window: the addresses of its ends count, the payments there do not

_ENDS = ("TIMESTAMP '1996-03-01'", "TIMESTAMP '1999-10-01'")
_BOUNDS = "AND o_orderdate BETWEEN (SELECT min(o_orderdate) FROM orders) AND (SELECT max(o_orderdate) FROM orders)"
_INNER_USERS = _USERS.replace(_BOUNDS, f"AND o_orderdate BETWEEN {_ENDS[0]} AND {_ENDS[1]}")
_INNER_PAID = _PAID.replace("(SELECT min(o_orderdate) FROM orders)", _ENDS[0]).replace("(SELECT max(o_orderdate) FROM orders)", _ENDS[1])
_INNER_EDGES = f"""WITH RECURSIVE {_INNER_USERS},{_INNER_PAID}
SELECT least(f.user_id, t.user_id) AS src, greatest(f.user_id, t.user_id) AS dst,
       sum(round(r.value * 100)) AS value, count(*) AS count
FROM senders s JOIN receivers r USING (tx)
JOIN users f ON f.address = s.address JOIN users t ON t.address = r.address
WHERE f.user_id <> t.user_id GROUP BY 1, 2"""

# Customers, their orders' addresses and suppliers

_PURCHASES = """
purchases AS (
  SELECT 'c' || o_custkey AS customer, CASE WHEN l_linestatus <> 'O' THEN 'o' || o_orderkey END AS own,
         's' || l_suppkey AS supplier, round(l_extendedprice * 100) AS cents,
         o_orderstatus <> 'P' AS confirmed, o_orderpriority = '5-LOW' AS coinbase, o_orderdate
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
)"""

# The part graph

_PART_GRAPH = """
part_lines AS (
  SELECT DISTINCT l_orderkey AS tx, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') o ON o_orderkey = l_orderkey
),
part_pairs AS (
  SELECT l_partkey::VARCHAR AS a, (lead(l_partkey) OVER (
    PARTITION BY tx ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))::VARCHAR AS b
  FROM part_lines
),
edges AS (
  SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM part_pairs WHERE b IS NOT NULL AND a <> b
),
ends AS (SELECT src AS node, dst AS neighbor FROM edges UNION ALL SELECT dst, src FROM edges),
nodes AS (SELECT p_partkey::VARCHAR AS id, p_size, p_retailprice FROM part),
brands AS (
  SELECT p_partkey::VARCHAR AS node, regexp_extract(p_brand, '([0-9]+)$', 1)::BIGINT AS community FROM part
),
degrees AS (
  SELECT id, count(neighbor) AS degree FROM nodes LEFT JOIN ends ON node = id GROUP BY id
),
links AS (
  SELECT m.node, m.community, b.community AS other, count(neighbor) AS n
  FROM brands m LEFT JOIN ends e ON e.node = m.node LEFT JOIN brands b ON b.node = e.neighbor
  GROUP BY ALL
),
members AS (
  SELECT node, community, coalesce(sum(n) FILTER (other = community), 0)::BIGINT AS inside,
         coalesce(sum(n) FILTER (other <> community), 0)::BIGINT AS outside, max(n) AS largest
  FROM links GROUP BY node, community
)"""

_GEOGRAPHY = """
region_links AS (
  SELECT 'n' || n_nationkey AS one, 'r' || n_regionkey AS two FROM nation
  UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
)"""


def _shortest_paths(edges: str) -> str:
    """Distance and number of shortest paths of all connected pairs, and edge betweenness."""
    return f"""
ends AS (SELECT src AS a, dst AS b FROM {edges} UNION ALL SELECT dst, src FROM {edges}),
walks(s, v, d, paths) USING KEY (s, v) AS (
  SELECT DISTINCT a, a, 0, 1::DOUBLE FROM ends
  UNION
  SELECT w.s, e.b, w.d + 1, sum(w.paths) FROM walks w JOIN ends e ON e.a = w.v
  LEFT JOIN recurring.walks r ON r.s = w.s AND r.v = e.b
  WHERE r.s IS NULL GROUP BY w.s, e.b, w.d
),
betweenness AS (
  SELECT e.src, e.dst, coalesce(sum(x.paths * y.paths / z.paths), 0) AS betweenness
  FROM {edges} e JOIN walks x ON x.v = e.src JOIN walks y ON y.s = e.dst
  JOIN walks z ON z.s = x.s AND z.v = y.v AND z.d = x.d + 1 + y.d
  GROUP BY e.src, e.dst
)"""


_TRADE = """
ranked AS (
  SELECT 'n' || lpad(n_nationkey::VARCHAR, 2, '0') AS name, n_regionkey AS region,
         row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place
  FROM nation
),
edges_0 AS (
  SELECT least(one, two) AS src, greatest(one, two) AS dst FROM (
    SELECT a.name AS one, b.name AS two FROM ranked a JOIN ranked b ON a.region = b.region AND a.place < b.place
    UNION SELECT a.name, b.name FROM ranked a JOIN ranked b ON a.region + 1 = b.region AND a.place = b.place
    UNION SELECT 'n' || lpad(s_nationkey::VARCHAR, 2, '0'), 's' || s_suppkey FROM supplier)
),
places AS (SELECT src AS id FROM edges_0 UNION SELECT dst FROM edges_0)"""


def _removals(count: int) -> str:
    """Tables ``edges_1`` ... without the first, second, ... edge of highest betweenness."""
    steps = []
    for k in range(count):
        paths = _shortest_paths(f"edges_{k}")
        for name in ("ends", "walks", "betweenness"):
            paths = re.sub(rf"\b{name}\b(?!\s*DESC)", f"{name}_{k}", paths)
        paths = paths.replace(f"AS betweenness_{k}", "AS betweenness")
        top = f"SELECT src, dst FROM betweenness_{k} QUALIFY row_number() OVER (ORDER BY round(betweenness, 6) DESC, src, dst) > 1"
        steps.append(f"{paths},\nedges_{k + 1} AS ({top})")
    return ",".join(steps)


# Embeddings

_FEATURES = """
features AS (
  SELECT vec_id AS node, label::BIGINT AS community, 'embedding' AS attr, (i - 1)::INTEGER AS idx,
         embedding[i]::DOUBLE AS value
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i)
),
differences AS (
  SELECT a.community, a.attr, a.idx, sum(abs(a.value - b.value)) / count(*) AS mean_difference
  FROM features a JOIN features b USING (community, attr, idx) GROUP BY ALL
)"""

_GLANCE = f"""{_FEATURES},
shares AS (
  SELECT a.node, a.attr, a.idx,
         count(*) FILTER (abs(a.value - b.value) > d.mean_difference)::DOUBLE / count(*) AS share
  FROM features a JOIN features b USING (community, attr, idx) JOIN differences d USING (community, attr, idx)
  GROUP BY ALL
),
glance AS (SELECT node, max(share) AS score FROM shares GROUP BY node)"""


def _laplacian(features: str, affinity: str) -> str:
    """The matrix form: every linked pair is multiplied out."""
    return f"""
strength AS (SELECT i AS node, sum(weight) AS d FROM {affinity} GROUP BY i),
vertical AS (
  SELECT attr, idx, sum(d * value * value) AS fdf, sum(d * value) AS df, sum(d) AS total
  FROM {features} JOIN strength USING (node) GROUP BY ALL
),
linked AS (
  SELECT a.attr, a.idx, sum(w.weight * a.value * b.value) AS fwf
  FROM {affinity} w JOIN {features} a ON a.node = w.i
  JOIN {features} b ON b.node = w.j AND b.attr = a.attr AND b.idx = a.idx GROUP BY ALL
),
laplacian AS (
  SELECT attr, idx, 1 - (fwf - df * df / total) /
         CASE WHEN fdf - df * df / total < 1e-12 THEN 10000 ELSE fdf - df * df / total END AS score
  FROM vertical JOIN linked USING (attr, idx)
)"""


_LABEL_LINKS = f"""{_FEATURES},
affinity AS (
  SELECT a.vec_id AS i, b.vec_id AS j, 1::DOUBLE AS weight
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
),{_laplacian('features', 'affinity')},
ranked AS (SELECT *, row_number() OVER (ORDER BY score, attr, idx) - 1 AS rank FROM laplacian),
chosen AS (
  SELECT * FROM ranked WHERE rank < (SELECT greatest(1, floor(count(*) * 0.1)) FROM ranked)
)"""

_NEAREST = """
near AS (
  SELECT a.vec_id AS i, b.vec_id AS j, row_number() OVER (
    PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) DESC,
    b.vec_id) AS place
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
),
affinity AS (
  SELECT DISTINCT i, j, 1::DOUBLE AS weight FROM (
    SELECT i, j FROM near WHERE place <= 5 UNION ALL SELECT j, i FROM near WHERE place <= 5
    UNION ALL SELECT vec_id, vec_id FROM embeddings)
)"""

ORACLE = {
    "co_input_edges": f"WITH {_LINES} SELECT src, dst FROM links",
    "address_nodes": f"WITH {_LINES} SELECT id FROM addresses",
    "connected_components": (
        f"WITH RECURSIVE {_LINES},{_components('addresses', 'links', 'parts')} SELECT id, component FROM parts"
    ),
    "address_user_map": f"WITH RECURSIVE {_USERS} SELECT address, user_id FROM users",
    "payment_edges": _PAYMENT_EDGES,
    "payment_nodes": f"""WITH RECURSIVE {_USER_PAID}
SELECT u.user_id AS id FROM senders s JOIN users u ON u.address = s.address
UNION SELECT to_user FROM user_paid WHERE from_user <> to_user""",
    "payment_fold": _PAYMENT_EDGES,
    "missing_addresses": f"""WITH {_LINES},{_PAID},
named AS (
  SELECT address FROM senders UNION SELECT r.address FROM receivers r SEMI JOIN senders s ON s.tx = r.tx
)
SELECT address FROM named WHERE address NOT IN (SELECT src FROM links UNION SELECT dst FROM links)""",
    "block_scan": f"""WITH {_PURCHASES}
SELECT strftime(o_orderdate, '%Y-%m-%d') AS time, CASE WHEN confirmed THEN 1 ELSE 0 END::BIGINT AS confirmations,
       coinbase AS is_coinbase, count(*) AS transactions, (count(*) + count(own))::BIGINT AS usable_inputs,
       sum(cents) AS paid
FROM purchases GROUP BY ALL""",
    # An order's own address is only ever spent with its customer's, so each customer is a
    # user named by the customer's address, and so is each supplier.
    "stored_user_network": f"""WITH {_PURCHASES},
used AS (SELECT * FROM purchases WHERE confirmed AND NOT coinbase),
users AS (
  SELECT address, row_number() OVER (ORDER BY address) - 1 AS user_id
  FROM (SELECT customer AS address FROM used UNION SELECT supplier FROM used)
)
SELECT least(f.user_id, t.user_id) AS src, greatest(f.user_id, t.user_id) AS dst,
       sum(cents) AS value, count(*) AS count
FROM used JOIN users f ON f.address = customer JOIN users t ON t.address = supplier GROUP BY 1, 2""",
    "streamed_payments": f"""WITH {_PURCHASES}
SELECT customer AS src, supplier AS dst, sum(cents) AS value, count(*) AS count
FROM purchases WHERE confirmed AND NOT coinbase GROUP BY 1, 2""",
    "address_fold": _INNER_EDGES,
    "grown_users": f"WITH RECURSIVE {_INNER_USERS} SELECT address, user_id FROM users",
    "graphml_nodes": """SELECT p_partkey::VARCHAR AS id, p_name, p_size::BIGINT AS p_size,
       round(p_retailprice, 6) AS p_retailprice FROM part""",
    "stored_graph": f"WITH {_PART_GRAPH} SELECT src, dst FROM edges",
    "cached_communities": f"WITH {_PART_GRAPH} SELECT node, community FROM brands",
    "neighbor_metrics": f"""WITH {_PART_GRAPH}
SELECT id, degree, inside AS "innerCommunityEdgesAmount", outside AS "outerCommunityEdgesAmount", community
FROM degrees JOIN members ON node = id""",
    "neighbor_vector": f"""WITH {_PART_GRAPH}
SELECT node, other AS community, sum(n)::BIGINT AS count FROM links WHERE other IS NOT NULL GROUP BY ALL""",
    "degree_anomalies": f"""WITH {_PART_GRAPH}
SELECT id AS node, degree FROM degrees
WHERE abs(degree - (SELECT avg(degree) FROM degrees)) > 2 * (SELECT stddev_pop(degree) FROM degrees)""",
    # Multiplied by the number of members, which leaves no rounding at the limit.
    "within_community_anomalies": f"""WITH {_PART_GRAPH},
spread AS (
  SELECT community, count(*) AS n, sum(inside) AS total, sum(inside * inside) AS squares
  FROM members GROUP BY community
)
SELECT community, node FROM members JOIN spread USING (community)
WHERE abs(n * inside - total) > 2 * sqrt(n * squares - total * total)""",
    "cada": f"""WITH {_PART_GRAPH}
SELECT node, CASE WHEN largest > 0 THEN round((inside + outside) / largest, 6) ELSE 0 END::DOUBLE AS score
FROM members""",
    "pseudo_cada": f"""WITH {_PART_GRAPH}
SELECT node, CASE WHEN inside > 0 THEN round(outside / inside, 6) ELSE 'inf'::DOUBLE END AS score FROM members""",
    "modularity": f"""WITH {_PART_GRAPH},
total AS (SELECT count(*)::DOUBLE AS m FROM edges),
per AS (
  SELECT community, sum(degree)::DOUBLE AS tot, sum(inside)::DOUBLE AS inside
  FROM members JOIN degrees ON id = node GROUP BY community
)
SELECT round(sum(inside / (2 * m) - (tot / (2 * m)) * (tot / (2 * m))), 6) AS modularity FROM per, total""",
    "glance_of_parts": f"""WITH {_PART_GRAPH},
features AS (
  SELECT id AS node, community, 'p_size' AS attr, p_size::DOUBLE AS value FROM nodes JOIN brands ON node = id
  UNION ALL SELECT id, community, 'p_retailprice', p_retailprice FROM nodes JOIN brands ON node = id
),
differences AS (
  SELECT a.community, a.attr, sum(abs(a.value - b.value)) / count(*) AS mean_difference
  FROM features a JOIN features b USING (community, attr) GROUP BY ALL
),
shares AS (
  SELECT a.node, a.attr, count(*) FILTER (abs(a.value - b.value) > mean_difference)::DOUBLE / count(*) AS share
  FROM features a JOIN features b USING (community, attr) JOIN differences d USING (community, attr) GROUP BY ALL
)
SELECT node, round(max(share), 6) AS score FROM shares GROUP BY node""",
    "louvain_invariants": f"""WITH {_LINES}
SELECT count(*) AS nodes, true AS one_each, true AS connected, true AS modular FROM addresses""",
    "edge_betweenness": f"""WITH RECURSIVE {_GEOGRAPHY},
all_links AS (
  SELECT one, two FROM region_links UNION SELECT 'n' || c_nationkey, 'm' || c_mktsegment FROM customer
),
edges AS (SELECT DISTINCT least(one, two) AS src, greatest(one, two) AS dst FROM all_links),
{_shortest_paths('edges')}
SELECT src, dst, round(betweenness, 6) AS betweenness FROM betweenness""",
    # Every link of a forest is the only way between its ends, so one removal splits it.
    "girvan_newman_split": f"""WITH RECURSIVE {_GEOGRAPHY},
edges AS (SELECT DISTINCT least(one, two) AS src, greatest(one, two) AS dst FROM region_links),
{_shortest_paths('edges')},
rest AS (
  SELECT src, dst FROM betweenness
  QUALIFY row_number() OVER (ORDER BY round(betweenness, 6) DESC, src, dst) > 1
),
places AS (SELECT one AS id FROM region_links UNION SELECT two FROM region_links),
{_components('places', 'rest', 'parts')}
SELECT id AS node, dense_rank() OVER (ORDER BY component) - 1 AS community FROM parts""",
    # The fifth removal splits; four leave one component.
    "girvan_newman_removals": f"""WITH RECURSIVE {_TRADE},{_removals(5)},
{_components('places', 'edges_4', 'before')},{_components('places', 'edges_5', 'parts')}
SELECT id AS node, dense_rank() OVER (ORDER BY component) - 1 AS community FROM parts
WHERE (SELECT count(DISTINCT component) FROM before) = 1""",
    "feature_table": f"""WITH {_FEATURES}
SELECT node, attr, idx, round(value, 6) AS value FROM features
UNION ALL SELECT vec_id, 'class', -1, label::DOUBLE FROM embeddings""",
    "avg_difference": f"""WITH {_FEATURES}
SELECT community, attr, idx, round(mean_difference, 6) AS mean_difference FROM differences""",
    "glance_scores": f"WITH {_GLANCE} SELECT node, round(score, 6) AS score FROM glance",
    "glance_anomalies": f"WITH {_GLANCE} SELECT node, round(score, 6) AS score FROM glance WHERE score > 0.95",
    "laplacian_scores": f"WITH {_LABEL_LINKS} SELECT attr, idx, round(score, 6) AS score FROM laplacian",
    "laplacian_top": f"WITH {_LABEL_LINKS} SELECT attr, idx, rank FROM chosen",
    "laplacian_affinity": f"""WITH {_PART_GRAPH},
part_features AS (
  SELECT id AS node, 'p_size' AS attr, -1 AS idx, p_size::DOUBLE AS value FROM nodes
  UNION ALL SELECT id, 'p_retailprice', -1, p_retailprice FROM nodes
),
affinity AS (
  SELECT node AS i, neighbor AS j, 1.0::DOUBLE / (1 + abs(node::BIGINT - neighbor::BIGINT)) AS weight FROM ends
),{_laplacian('part_features', 'affinity')}
SELECT attr, idx, round(score, 6) AS score FROM laplacian""",
    "nearest_affinity": f"WITH {_NEAREST} SELECT i, j, weight FROM affinity",
    "laplacian_nearest": f"""WITH {_FEATURES},{_NEAREST},{_laplacian('features', 'affinity')}
SELECT attr, idx, round(score, 6) AS score FROM laplacian""",
    "spec_scores": f"""WITH {_FEATURES},
alike AS (
  SELECT a.vec_id AS i, b.vec_id AS j,
         exp(-pow(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2)) AS w
  FROM embeddings a, embeddings b
),
strength AS (SELECT i AS node, sum(w) AS d FROM alike GROUP BY i),
horizontal AS (
  SELECT a.attr, a.idx, sum(w * pow(a.value - b.value, 2)) / 2 AS cut
  FROM alike JOIN features a ON a.node = i JOIN features b ON b.node = j AND b.attr = a.attr AND b.idx = a.idx
  GROUP BY ALL
),
vertical AS (
  SELECT attr, idx, sum(d * value * value) - sum(d * value) * sum(d * value) / sum(d) AS spread
  FROM features JOIN strength USING (node) GROUP BY ALL
)
SELECT attr, idx, round(cut / spread, 6) AS score FROM horizontal JOIN vertical USING (attr, idx)""",
    "run_glance": f"""WITH {_LABEL_LINKS},
best AS (SELECT f.* FROM features f JOIN chosen USING (attr, idx)),
shares AS (
  SELECT a.node, a.attr, a.idx,
         count(*) FILTER (abs(a.value - b.value) > d.mean_difference)::DOUBLE / count(*) AS share
  FROM best a JOIN best b USING (community, attr, idx) JOIN differences d USING (community, attr, idx)
  GROUP BY ALL
)
SELECT node, round(max(share), 6) AS score FROM shares GROUP BY node HAVING max(share) > 0.6""",
    "graphml_edges": """WITH links AS (
  SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, min(c_acctbal) AS balance FROM customer GROUP BY ALL
),
sizes AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM links UNION ALL SELECT dst FROM links) GROUP BY id)
SELECT id, degree, dst, round(balance, 6) AS balance FROM sizes LEFT JOIN links ON src = id""",
    "louvain_stars": """SELECT s_suppkey AS node, dense_rank() OVER (ORDER BY first) - 1 AS community
FROM (SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS first FROM supplier)""",
    "nearest_ties": """WITH v AS (
  SELECT s_suppkey AS id, [(s_nationkey + 1)::DOUBLE * (s_suppkey + 1), (s_suppkey + 1)::DOUBLE] AS v FROM supplier
),
near AS (
  SELECT a.id AS i, b.id AS j, row_number() OVER (
    PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.id) AS place
  FROM v a JOIN v b ON a.id <> b.id
)
SELECT DISTINCT i, j, 1::DOUBLE AS weight FROM (
  SELECT i, j FROM near WHERE place <= 5 UNION ALL SELECT j, i FROM near WHERE place <= 5
  UNION ALL SELECT id, id FROM v)""",
    "spec_scores_sparse": """WITH v AS (SELECT p_partkey AS id, p_retailprice / 10 AS price, p_size * 3.0::DOUBLE AS size FROM part),
alike AS (
  SELECT a.id AS i, a.price AS ap, b.price AS bp, a.size AS az, b.size AS bz,
         exp(greatest(-(pow(a.price - b.price, 2) + pow(a.size - b.size, 2)), -800)) AS w
  FROM v a, v b
),
strength AS (SELECT i AS id, sum(w) AS d FROM alike GROUP BY i),
cuts AS (SELECT sum(w * pow(ap - bp, 2)) / 2 AS price, sum(w * pow(az - bz, 2)) / 2 AS size FROM alike),
spreads AS (
  SELECT sum(d * pow(price - (SELECT avg(price) FROM v), 2)) - pow(sum(d * (price - (SELECT avg(price) FROM v))), 2) / sum(d) AS price,
         sum(d * pow(size - (SELECT avg(size) FROM v), 2)) - pow(sum(d * (size - (SELECT avg(size) FROM v))), 2) / sum(d) AS size
  FROM v JOIN strength USING (id)
)
SELECT 'price' AS attr, -1 AS idx, round(c.price / s.price, 6) AS score FROM cuts c, spreads s
UNION ALL SELECT 'size', -1, round(c.size / s.size, 6) FROM cuts c, spreads s""",
    "glance_large_whole": """WITH v AS (SELECT p_partkey::VARCHAR AS node, p_brand, (p_size + 100)::HUGEINT * 9007199254740992 AS x FROM part),
means AS (SELECT a.p_brand, sum(abs(a.x - b.x)) AS total, count(*) AS pairs FROM v a JOIN v b USING (p_brand) GROUP BY a.p_brand)
SELECT a.node, round(count(*) FILTER (abs(a.x - b.x) * pairs > total)::DOUBLE / count(*), 6) AS score
FROM v a JOIN v b USING (p_brand) JOIN means USING (p_brand) GROUP BY a.node""",
}
ORACLE["glance_next_to_2_53"] = ORACLE["glance_large_whole"].replace(
    "(p_size + 100)::HUGEINT * 9007199254740992", "9007199254740992 + p_size::HUGEINT"
)
ORACLE["stored_anomalies"] = ORACLE["pseudo_cada"]
