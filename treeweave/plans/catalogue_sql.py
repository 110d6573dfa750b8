"""SQL twins of the catalogue's queries, written apart from the operators: for DuckDB, over the same tables."""

from __future__ import annotations

#: Bell numbers from 0 on, for the pairs of up to 25 nations.
BELL = [1]
_row = [1]
for _ in range(60):
    _next = [_row[-1]]
    for _x in _row:
        _next.append(_next[-1] + _x)
    _row = _next
    BELL.append(_row[0])

TRADE = """trade AS (
  SELECT CAST(least(c_nationkey, s_nationkey) AS BIGINT) AS u, CAST(greatest(c_nationkey, s_nationkey) AS BIGINT) AS v, count(*) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)"""

ORDERS = """ln AS (SELECT CAST(l_orderkey AS VARCHAR) AS graph_id, CAST(l_linenumber AS BIGINT) AS n, min(l_returnflag || l_linestatus) AS f FROM lineitem GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY n) AS r FROM ln),
e AS (SELECT a.graph_id, CAST(a.n * 10 + b.n AS INTEGER) AS name, a.n AS u, b.n AS v FROM rk a JOIN rk b ON a.graph_id = b.graph_id AND (b.r = a.r + 1 OR (b.r = a.r + 2 AND a.f = b.f)))"""

#: ``ch``: each line of the graphs ``e`` with its degree d, its rank k of m, and p, the edges between the lines up to it and the later ones.
CHAIN = """ch AS (
  SELECT t.*, (SELECT count(*) FROM e WHERE e.graph_id = t.graph_id AND (e.u <= t.n) <> (e.v <= t.n)) AS p
  FROM (SELECT graph_id, n, count(*) AS d, row_number() OVER (PARTITION BY graph_id ORDER BY n) AS k, count(*) OVER (PARTITION BY graph_id) AS m
        FROM (SELECT graph_id, u AS n FROM e UNION ALL SELECT graph_id, v FROM e) GROUP BY graph_id, n) t)"""

CUSTOMER = """seen AS (
  SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS graph_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS p, CAST(n_regionkey AS BIGINT) AS r
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
ce AS (SELECT DISTINCT graph_id, p AS name, 0 AS u, p AS v FROM seen UNION ALL SELECT graph_id, p * 10 + r, p, r + 6 FROM seen),
ends AS (SELECT graph_id, name, u AS vertex FROM ce UNION ALL SELECT graph_id, name, v FROM ce)"""


#: ``c``: graph_id, vertex, root, es, lab (block of each edge), mx, mask (incoming), cost and code of every directed candidate of the graphs ``e``; ``root`` is each graph's smallest vertex.
CANDIDATES = """
rt AS (SELECT graph_id, min(least(u, v)) AS root FROM e GROUP BY graph_id),
inc AS (SELECT graph_id, vertex, root, list_sort(list(name)) AS es FROM (SELECT graph_id, u AS vertex, name FROM e UNION ALL SELECT graph_id, v, name FROM e) JOIN rt USING (graph_id) GROUP BY ALL),
shape AS (
  SELECT n, 0 AS i, CAST([] AS INTEGER[]) AS lab, -1 AS mx FROM (SELECT DISTINCT len(es) AS n FROM inc)
  UNION ALL
  SELECT n, i + 1, list_append(lab, CAST(l AS INTEGER)), greatest(mx, CAST(l AS INTEGER)) FROM shape, range(9) t(l) WHERE i < n AND l <= mx + 1),
way AS (
  SELECT n, lab, mx, mask, len([k for k in range(mx + 1) if len([j for j in range(1, n + 1) if lab[j] = k AND (mask >> (j - 1)) & 1 = 1]) <> 1]) = 0 AS each
  FROM shape, range(512) m(mask) WHERE i = n AND mask < (1 << n)),
c AS (
  SELECT graph_id, vertex, root, es, lab, mx, mask,
         (31 * list_sum([CAST(lab[j] AS BIGINT) * es[j] for j in range(1, len(es) + 1)])
          + 17 * coalesce(list_sum([es[j] for j in range(1, len(es) + 1) if (mask >> (j - 1)) & 1 = 1]), 0) + 7 * vertex) % 1000 AS cost,
         array_to_string(list_transform(range(mx + 1), lambda k: array_to_string([es[j] for j in range(1, len(es) + 1) if lab[j] = k], ',')), '|') || ':'
         || array_to_string([es[j] for j in range(1, len(es) + 1) if (mask >> (j - 1)) & 1 = 1], ',') AS code
  FROM inc JOIN way ON len(es) = n WHERE CASE WHEN vertex = root THEN mx = 0 AND mask = 0 ELSE each END)"""


def brute(graph: str) -> str:
    """``f``: graph_id, combo, cost of every feasible combination.

    Candidates are crossed vertex by vertex in order of id, as long as each edge
    enters just one of its ends; a combination is a tree if every copy reaches
    the root upwards, since each copy but the root's has one edge that enters it.
    """
    return f"""WITH RECURSIVE {graph},{CANDIDATES},
o AS (SELECT graph_id, vertex, row_number() OVER (PARTITION BY graph_id ORDER BY vertex) AS i FROM inc),
ci AS (SELECT o.i, c.graph_id, c.vertex, c.cost, [es[j] for j in range(1, len(es) + 1) if (mask >> (j - 1)) & 1 = 1] AS ins, [es[j] for j in range(1, len(es) + 1) if (mask >> (j - 1)) & 1 = 0] AS outs, es, lab, mask
       FROM c JOIN o ON c.graph_id = o.graph_id AND c.vertex = o.vertex),
x AS (
  SELECT graph_id, i, cost, ins, outs, [struct_pack(vertex := vertex, es := es, lab := lab, mask := mask)] AS st FROM ci WHERE i = 1
  UNION ALL
  SELECT x.graph_id, ci.i, x.cost + ci.cost, list_concat(x.ins, ci.ins), list_concat(x.outs, ci.outs), list_append(x.st, struct_pack(vertex := ci.vertex, es := ci.es, lab := ci.lab, mask := ci.mask))
  FROM x JOIN ci ON x.graph_id = ci.graph_id AND ci.i = x.i + 1 WHERE NOT list_has_any(x.ins, ci.ins) AND NOT list_has_any(x.outs, ci.outs)),
whole AS (SELECT row_number() OVER () AS combo, x.* FROM x JOIN (SELECT graph_id, max(i) AS n FROM o GROUP BY graph_id) m ON x.graph_id = m.graph_id AND x.i = m.n),
half AS (SELECT combo, s.vertex AS vertex, s.es[j] AS name, s.lab[j] AS blk, (s.mask >> (j - 1)) & 1 AS inward FROM (SELECT combo, unnest(st) AS s FROM whole), range(1, 20) t(j) WHERE j <= len(s.es)),
up AS (SELECT a.combo, a.vertex, a.blk, b.vertex AS pv, b.blk AS pb FROM half a JOIN half b ON a.combo = b.combo AND a.name = b.name AND a.vertex <> b.vertex WHERE a.inward = 1 AND b.inward = 0),
walk AS (
  SELECT combo, vertex AS sv, blk AS sb, pv, pb, 1 AS d FROM up
  UNION ALL
  SELECT walk.combo, sv, sb, up.pv, up.pb, d + 1 FROM walk JOIN up ON walk.combo = up.combo AND walk.pv = up.vertex AND walk.pb = up.blk WHERE d < 24),
ends AS (SELECT combo, sv, sb, max(d) AS d FROM walk GROUP BY ALL),
bad AS (SELECT DISTINCT combo FROM ends WHERE d >= 24),
f AS (SELECT graph_id, combo, cost FROM whole WHERE combo NOT IN (SELECT combo FROM bad))
"""


DIST = f"""WITH RECURSIVE {TRADE},
e AS (SELECT u, v, (SELECT max(w) FROM trade) + 1 - w AS len FROM trade),
b AS (SELECT u, v, len FROM e UNION ALL SELECT v, u, len FROM e),
r AS (
  SELECT min(u) AS v, CAST(0 AS BIGINT) AS d, 0 AS h FROM trade
  UNION ALL
  SELECT b.v, CAST(min(r.d + b.len) AS BIGINT), r.h + 1 FROM r JOIN b ON r.v = b.u WHERE r.h < 24 GROUP BY b.v, r.h),
dist AS (SELECT v AS vertex_id, min(d) AS dist FROM r GROUP BY v)
"""

#: Every order's graph drawn together to its root and its second line.
TWO = ORDERS.replace("e AS (", "whole_e AS (") + """,
e AS (SELECT graph_id, name, u, min(v) OVER (PARTITION BY graph_id) AS v FROM whole_e w WHERE u = (SELECT min(u) FROM whole_e o WHERE o.graph_id = w.graph_id))"""

#: ``ways``: the directed partitions of n edges, counted; ``d``: each vertex's degree n.
WAYS = """ways AS (SELECT n, CAST(sum(factorial(CAST(n AS INTEGER)) // (factorial(CAST(k AS INTEGER)) * factorial(CAST(n - k AS INTEGER))) * CAST(pow(k, n - k) AS BIGINT)) AS BIGINT) AS c
  FROM range(1, 10) a(n), range(1, 10) b(k) WHERE k <= n GROUP BY n)"""
DEGREE = "d AS (SELECT graph_id, x, count(*) AS n FROM (SELECT graph_id, u AS x FROM e UNION ALL SELECT graph_id, v FROM e) GROUP BY ALL)"

#: ``dist``: least distance and hops from the root of each order's graph, by walks of up to six steps (orders have at most seven lines).
ORDER_DIST = f"""WITH RECURSIVE {ORDERS}, h AS (SELECT graph_id, u AS x, v AS y, name % 7 + 1 AS w FROM e UNION ALL SELECT graph_id, v, u, name % 7 + 1 FROM e),
  s AS (SELECT graph_id, min(u) AS vertex_id, CAST(0 AS BIGINT) AS d, CAST(0 AS BIGINT) AS hop FROM e GROUP BY graph_id
    UNION SELECT s.graph_id, y, d + w, hop + 1 FROM s JOIN h ON s.graph_id = h.graph_id AND x = vertex_id WHERE hop < 6),
  dist AS (SELECT graph_id, vertex_id, min(d) AS dist, min(hop) AS level FROM s GROUP BY graph_id, vertex_id)"""

#: Triangles of a customer's orders with no order inside their circle, by trying all, in whole numbers.
TRIANGLES = """o AS (SELECT CAST(o_custkey AS VARCHAR) AS g, o_orderkey AS id, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 10000 AS HUGEINT) AS x, CAST(round(o_totalprice * 100) AS HUGEINT) AS y FROM orders),
  abc AS (SELECT a.g, a.id AS p, b.id AS q, c.id AS r, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS area
    FROM o a JOIN o b ON a.g = b.g AND a.id < b.id JOIN o c ON a.g = c.g AND b.id < c.id),
  tri AS (SELECT g AS graph_id, p, q, r FROM abc WHERE area <> 0 AND NOT EXISTS (SELECT 1 FROM o d WHERE d.g = abc.g AND sign(area) * (
      ((ax - d.x) * (ax - d.x) + (ay - d.y) * (ay - d.y)) * ((bx - d.x) * (cy - d.y) - (by_ - d.y) * (cx - d.x))
    - ((bx - d.x) * (bx - d.x) + (by_ - d.y) * (by_ - d.y)) * ((ax - d.x) * (cy - d.y) - (ay - d.y) * (cx - d.x))
    + ((cx - d.x) * (cx - d.x) + (cy - d.y) * (cy - d.y)) * ((ax - d.x) * (by_ - d.y) - (ay - d.y) * (bx - d.x))) > 0))"""

SQL: dict[str, str] = {
    "degree_part_supp": "SELECT vertex_id, count(*) AS degree FROM (SELECT DISTINCT l_partkey AS vertex_id, l_suppkey AS o, 0 AS k FROM lineitem UNION ALL SELECT DISTINCT -l_suppkey - 1, l_partkey, 1 FROM lineitem) GROUP BY vertex_id",
    "degree_trade": f"WITH {TRADE} SELECT vertex_id, count(*) AS degree FROM (SELECT u AS vertex_id FROM trade UNION ALL SELECT v FROM trade) GROUP BY vertex_id",
    "pair_multiplicity": f"WITH {TRADE} SELECT u, v, w AS m FROM trade",
    "node_filter_induced": """SELECT DISTINCT l_partkey AS u, -l_suppkey - 1 AS v FROM lineitem
      WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""",
    "edge_filter_out": f"WITH {TRADE} SELECT u, v, w FROM trade WHERE NOT w * 300 > (SELECT sum(w) FROM trade)",
    "edge_filter_out_vertices": f"""WITH {TRADE}, ok AS (SELECT * FROM trade WHERE NOT w * 200 < (SELECT sum(w) FROM trade)), n AS (SELECT u AS x FROM ok UNION SELECT v FROM ok)
      SELECT u, v, w FROM trade WHERE EXISTS (SELECT 1 FROM n WHERE x = u) AND EXISTS (SELECT 1 FROM n WHERE x = v)""",
    "graph_defects": """WITH r AS (SELECT CAST(l_orderkey AS VARCHAR) AS graph_id, CAST(s_nationkey AS INTEGER) AS edge_name, c_nationkey AS u, s_nationkey AS v
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
      SELECT graph_id, 'self_loop' AS kind, edge_name FROM r WHERE u = v UNION ALL SELECT graph_id, 'duplicate_name', edge_name FROM r GROUP BY graph_id, edge_name HAVING count(*) > 1""",
    "joint_min_max_scale": """WITH m AS (SELECT least(min(p_size), min(p_retailprice)) AS lo, greatest(max(p_size), max(p_retailprice)) AS hi FROM part)
      SELECT p_partkey, (CAST(p_size AS DOUBLE) - lo) / (hi - lo) AS p_size, (p_retailprice - lo) / (hi - lo) AS p_retailprice FROM part, m""",
    "contract_pair": f"""WITH {TRADE}, m AS (SELECT min(u) AS a, min(v) AS b FROM trade),
      x AS (SELECT CASE WHEN u = b THEN a ELSE u END AS u, CASE WHEN v = b THEN a ELSE v END AS v FROM trade, m)
      SELECT least(u, v) AS u, greatest(u, v) AS v, count(*) AS m FROM x WHERE u <> v GROUP BY 1, 2""",
    "cluster_boundary": f"""WITH {TRADE}, x AS (SELECT a.n_regionkey AS ca, b.n_regionkey AS cb FROM trade JOIN nation a ON u = a.n_nationkey JOIN nation b ON v = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey)
      SELECT r.r_regionkey AS cluster, (SELECT count(*) FROM x WHERE ca = r.r_regionkey OR cb = r.r_regionkey) AS outdegree FROM (SELECT DISTINCT n_regionkey AS r_regionkey FROM nation) r""",
    "chain_compaction": f"""WITH RECURSIVE {CUSTOMER},
      d AS (SELECT graph_id, vertex, count(*) AS n FROM ends GROUP BY ALL),
      lk AS (SELECT a.graph_id, a.name AS x, b.name AS y FROM ends a JOIN ends b ON a.graph_id = b.graph_id AND a.vertex = b.vertex AND a.name <> b.name JOIN d ON d.graph_id = a.graph_id AND d.vertex = a.vertex WHERE d.n = 2),
      w AS (SELECT graph_id, name AS s, name AS x FROM ce UNION SELECT w.graph_id, w.s, lk.y FROM w JOIN lk ON w.graph_id = lk.graph_id AND w.x = lk.x),
      ch AS (SELECT graph_id, s AS name, min(x) AS chain FROM w GROUP BY ALL),
      tip AS (SELECT ch.graph_id, chain, min(ends.vertex) AS a, max(ends.vertex) AS b FROM ch JOIN ends ON ch.graph_id = ends.graph_id AND ch.name = ends.name JOIN d ON d.graph_id = ends.graph_id AND d.vertex = ends.vertex WHERE d.n <> 2 GROUP BY ALL)
      SELECT c.graph_id, CAST(c.chain AS INTEGER) AS chain_id, c.n AS n_edges, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM (SELECT graph_id, chain, count(*) AS n FROM ch GROUP BY ALL) c LEFT JOIN tip ON c.graph_id = tip.graph_id AND c.chain = tip.chain""",
    "components": f"""WITH RECURSIVE {TRADE}, k AS (SELECT * FROM trade WHERE w * 250 >= (SELECT sum(w) FROM trade)),
      b AS (SELECT u, v FROM k UNION SELECT v, u FROM k),
      r AS (SELECT u AS s, u AS x FROM b UNION SELECT r.s, b.v FROM r JOIN b ON r.x = b.u)
      SELECT s AS vertex_id, min(x) AS component FROM r GROUP BY s""",
    "shortest_paths": f"{DIST} SELECT vertex_id, dist FROM dist",
    "orient_edges": f"""{DIST} SELECT CAST(u * 100 + v AS INTEGER) AS edge_name, CASE WHEN (a.dist, u) < (b.dist, v) THEN u ELSE v END AS parent, CASE WHEN (a.dist, u) < (b.dist, v) THEN v ELSE u END AS child
      FROM e JOIN dist a ON e.u = a.vertex_id JOIN dist b ON e.v = b.vertex_id""",
    "hop_levels": f"""WITH RECURSIVE {TRADE}, k AS (SELECT * FROM trade WHERE w * 300 >= (SELECT sum(w) FROM trade)), b AS (SELECT u, v FROM k UNION SELECT v, u FROM k),
      r AS (SELECT min(u) AS x, CAST(0 AS BIGINT) AS h FROM k UNION SELECT b.v, r.h + 1 FROM r JOIN b ON r.x = b.u WHERE r.h < 24)
      SELECT x AS vertex_id, min(h) AS level FROM r GROUP BY x""",
    "set_partitions": """WITH RECURSIVE s AS (SELECT DISTINCT n FROM (SELECT count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_orderkey)),
      p AS (
        SELECT n, 0 AS i, CAST([] AS INTEGER[]) AS lab, -1 AS mx FROM s
        UNION ALL SELECT n, i + 1, list_append(lab, CAST(l AS INTEGER)), greatest(mx, CAST(l AS INTEGER)) FROM p, range(12) t(l) WHERE i < n AND l <= mx + 1)
      SELECT n, array_to_string(list_transform(range(mx + 1), lambda k: array_to_string([j for j in range(1, n + 1) if lab[j] = k], ',')), '|') AS code FROM p WHERE i = n""",
    "directed_partition_count": f"""WITH {ORDERS}, {WAYS}, {DEGREE}
      SELECT graph_id, x AS vertex_id, c AS cnt FROM d JOIN ways ON d.n = ways.n""",
    "default_candidates": f"""WITH {CUSTOMER}, i AS (SELECT graph_id, vertex, list_sort(list(name)) AS es FROM ends GROUP BY ALL)
      SELECT graph_id, vertex AS vertex_id, array_to_string(es, ',') || ':' || x AS code, CAST(0 AS BIGINT) AS cost FROM (SELECT *, unnest(es) AS x FROM i WHERE len(es) <= 2 AND vertex <> 0)""",
    "directed_candidates": f"WITH RECURSIVE {ORDERS},{CANDIDATES} SELECT graph_id, vertex AS vertex_id, code, CAST(cost AS BIGINT) AS cost FROM c",
    "fixed_direction_candidates": f"""WITH RECURSIVE {ORDERS},{CANDIDATES},
      g AS (SELECT graph_id, v AS vertex, list_sort(list(name)) AS given FROM e GROUP BY ALL)
      SELECT c.graph_id, c.vertex AS vertex_id, code FROM c LEFT JOIN g ON c.vertex = g.vertex AND c.graph_id = g.graph_id WHERE [es[j] for j in range(1, len(es) + 1) if (mask >> (j - 1)) & 1 = 1] = coalesce(given, [])""",
    "triangle_filter": f"""WITH RECURSIVE {ORDERS},{CANDIDATES},
      two AS (SELECT graph_id, vertex FROM inc WHERE len(es) = 2),
      way2 AS (SELECT graph_id, name, u AS x, v AS y FROM e UNION ALL SELECT graph_id, name, v, u FROM e),
      tri AS (SELECT b.graph_id, l.y AS vertex, l.name AS n1, r.name AS n2 FROM e b JOIN two p ON b.graph_id = p.graph_id AND b.u = p.vertex JOIN two q ON b.graph_id = q.graph_id AND b.v = q.vertex
        JOIN way2 l ON l.graph_id = b.graph_id AND l.x = b.u JOIN way2 r ON r.graph_id = b.graph_id AND r.x = b.v AND r.y = l.y),
      bad AS (SELECT c.graph_id, c.vertex, c.code FROM c JOIN tri ON c.graph_id = tri.graph_id AND c.vertex = tri.vertex WHERE len(es) > 2 AND lab[list_position(es, n1)] = lab[list_position(es, n2)])
      SELECT graph_id, vertex AS vertex_id, code FROM c WHERE (graph_id, vertex, code) NOT IN (SELECT (graph_id, vertex, code) FROM bad)""",
    "block_join": f"""WITH RECURSIVE {ORDERS},{CANDIDATES},
      h AS (SELECT c.*, e.name, e.u, e.v, list_position(es, e.name) AS s, [j for j in range(1, len(es) + 1) if es[j] <> e.name] AS js FROM c JOIN e ON c.graph_id = e.graph_id AND (c.vertex = e.u OR c.vertex = e.v)),
      j AS (SELECT l.graph_id, l.name, len(l.es) + len(r.es) AS size,
        list_sort(list_concat(
          [[l.es[i] for i in l.js if l.lab[i] = k] for k in range(l.mx + 1) if k <> l.lab[l.s]], [[r.es[i] for i in r.js if r.lab[i] = k] for k in range(r.mx + 1) if k <> r.lab[r.s]],
          [list_sort(list_concat([l.es[i] for i in l.js if l.lab[i] = l.lab[l.s]], [r.es[i] for i in r.js if r.lab[i] = r.lab[r.s]]))])) AS bl,
        list_sort(list_concat([l.es[i] for i in l.js if (l.mask >> (i - 1)) & 1 = 1], [r.es[i] for i in r.js if (r.mask >> (i - 1)) & 1 = 1])) AS inw
        FROM h l JOIN h r ON l.graph_id = r.graph_id AND l.name = r.name WHERE l.vertex = l.u AND r.vertex = r.v AND ((l.mask >> (l.s - 1)) & 1) + ((r.mask >> (r.s - 1)) & 1) = 1),
      k AS (SELECT graph_id, name, array_to_string([array_to_string(b, ',') for b in bl], '|') || ':' || array_to_string(inw, ',') AS code FROM j WHERE size = 2 OR len([b for b in bl if len(b) = 0]) = 0)
      SELECT graph_id, name AS edge_name, count(*) AS n_fits, min(code) AS first_code, max(code) AS last_code FROM k GROUP BY ALL""",
    "final_pair_min": f"{brute(TWO)} SELECT rt.graph_id, CAST(min(cost) AS BIGINT) AS best_cost, count(cost) AS n_feasible FROM rt LEFT JOIN f ON rt.graph_id = f.graph_id GROUP BY rt.graph_id",
    "brute_force_min": f"{brute(ORDERS)} SELECT rt.graph_id, CAST(min(cost) AS BIGINT) AS best_cost, count(cost) AS n_feasible FROM rt LEFT JOIN f ON rt.graph_id = f.graph_id GROUP BY rt.graph_id",
    "dp_min_cost": f"{brute(ORDERS)} SELECT rt.graph_id, CASE WHEN count(cost) > 0 THEN 'solved' ELSE 'infeasible' END AS status, CAST(min(cost) AS BIGINT) AS cost FROM rt LEFT JOIN f ON rt.graph_id = f.graph_id GROUP BY rt.graph_id",
    "tree_invariants": f"{brute(ORDERS)} SELECT graph_id, count(*) + 1 AS n_vertices, count(*) AS n_edges, CAST(1 AS BIGINT) AS n_components FROM e WHERE graph_id IN (SELECT graph_id FROM f) GROUP BY graph_id",
    "backtrack_total_cost": f"{brute(ORDERS)} SELECT graph_id, CAST(min(cost) AS BIGINT) AS cost FROM f GROUP BY graph_id",
    "merge_priorities": f"""WITH {TRADE}, k AS (SELECT * FROM trade WHERE w * 300 >= (SELECT sum(w) FROM trade)),
      d AS (SELECT x, count(*) AS d FROM (SELECT u AS x FROM k UNION ALL SELECT v FROM k) GROUP BY x),
      bt AS (SELECT * FROM (VALUES {", ".join(f"({n}, CAST({bell} AS DOUBLE))" for n, bell in enumerate(BELL))}) t(n, b)),
      m AS (SELECT u, v, a.d + b.d - 2 AS outdegree, (a.d - 1) * (b.d - 1) AS product, CAST(1 AS BIGINT) AS indegree, greatest(a.d, b.d) AS maxdegree, a.d * b.d AS degrees FROM k JOIN d a ON u = a.x JOIN d b ON v = b.x)
      SELECT m.*, round(degrees - ln(b), 6) AS diff, round(ln(b) - degrees, 6) AS diffinv FROM m JOIN bt ON outdegree = n""",
    "merge_cost": f"""WITH {ORDERS}, {WAYS}, {DEGREE}
      SELECT e.graph_id, e.name AS edge_name, a.c * b.c * (a.n + b.n) AS cost FROM e JOIN d p ON e.graph_id = p.graph_id AND e.u = p.x JOIN d q ON e.graph_id = q.graph_id AND e.v = q.x
      JOIN ways a ON p.n = a.n JOIN ways b ON q.n = b.n""",
    "queue_priorities": f"""WITH RECURSIVE {ORDERS},{CANDIDATES}, k AS (SELECT graph_id, vertex, root, count(*) AS n, any_value(len(es)) AS d FROM c GROUP BY ALL),
      bt AS (SELECT * FROM (VALUES {", ".join(f"({n}, CAST({bell} AS DOUBLE))" for n, bell in enumerate(BELL[:20]))}) t(o, b)),
      m AS (SELECT e.graph_id, e.u, e.v, a.d + b.d - 2 AS o, a.n * b.n AS product, ln(a.n) + ln(b.n) AS size, CASE WHEN a.root IN (e.u, e.v) THEN 0 ELSE 100 END AS alike
            FROM e JOIN k a ON e.graph_id = a.graph_id AND e.u = a.vertex JOIN k b ON e.graph_id = b.graph_id AND e.v = b.vertex)
      SELECT graph_id, u, v, m.o + alike AS boundary, product, round(size - ln(b), 6) AS diff, round(ln(b) - size, 6) AS diffinv FROM m JOIN bt ON m.o = bt.o""",
    "region_costs": f"""WITH {ORDERS}, {CHAIN}
      SELECT graph_id, n AS node, d AS outdegree, d AS cost FROM ch
      UNION ALL SELECT b.graph_id, 10 + b.k, b.p, a.p * b.d FROM ch a JOIN ch b ON a.graph_id = b.graph_id AND b.k = a.k + 1""",
    "sequence_costs": f"""WITH {ORDERS}, {CHAIN}, bt AS (SELECT * FROM (VALUES {", ".join(f"({n}, CAST({bell} AS DOUBLE))" for n, bell in enumerate(BELL[:20]))}) t(o, b)),
      r AS (SELECT graph_id, b AS cost, d AS wide FROM ch JOIN bt ON d = o
            UNION ALL SELECT y.graph_id, f.b * g.b, y.p FROM ch x JOIN ch y ON x.graph_id = y.graph_id AND y.k = x.k + 1 JOIN bt f ON x.p = f.o JOIN bt g ON y.d = g.o)
      SELECT graph_id, sum(cost) AS cost, max(wide) AS widest FROM r GROUP BY graph_id""",
    "merge_tree_order": f"""WITH {ORDERS}, {CHAIN}
      SELECT graph_id, n AS node, 10 + greatest(k, 2) AS parent, m - greatest(k, 2) + 1 AS level, 2 * m - 2 * (m - greatest(k, 2) + 1) - CASE WHEN k > 1 THEN 1 ELSE 0 END AS place FROM ch
      UNION ALL SELECT graph_id, 10 + k, CASE WHEN k < m THEN 11 + k END, m - k, 2 * k - CASE WHEN k < m THEN 0 ELSE 1 END FROM ch WHERE k > 1""",
    "trigraph_round_trip": f"""WITH {ORDERS}, {CHAIN}
      SELECT b.graph_id, least(CASE WHEN a.k = 1 THEN a.n ELSE 10 + a.k END, b.n) AS left_id, greatest(CASE WHEN a.k = 1 THEN a.n ELSE 10 + a.k END, b.n) AS right_id, CASE WHEN b.k = b.m THEN 100 ELSE 10 + b.k END AS new_id
      FROM ch a JOIN ch b ON a.graph_id = b.graph_id AND b.k = a.k + 1""",
    "best_roots": f"""WITH {ORDERS}, {CHAIN},
      s AS (SELECT b.graph_id, b.k, b.m, a.p AS l, b.d AS d, CASE WHEN b.k = b.m - 1 THEN z.d ELSE b.p END AS r FROM ch a JOIN ch b ON a.graph_id = b.graph_id AND b.k = a.k + 1 JOIN ch z ON z.graph_id = b.graph_id AND z.k = z.m WHERE b.k < b.m),
      spine AS (SELECT graph_id, 2 * k AS at, k, m, p AS c FROM ch WHERE k < m UNION ALL SELECT graph_id, 2 * k + 1, k, m, d FROM ch WHERE k > 1 AND k < m),
      t AS (SELECT x.graph_id, x.at, any_value(2 * x.c * x.c * x.c) + coalesce(sum(CASE WHEN 2 * s.k + 1 = x.at THEN s.l * s.r * (s.l + s.r) WHEN 2 * s.k <= x.at THEN s.l * s.d * (s.l + s.d) ELSE s.d * s.r * (s.d + s.r) END), 0) AS price
            FROM spine x LEFT JOIN s ON s.graph_id = x.graph_id GROUP BY x.graph_id, x.at)
      SELECT graph_id, CAST(min(price) AS BIGINT) AS price FROM t GROUP BY graph_id""",
    "core_graphs": f"""WITH {ORDERS}, top AS (SELECT e.graph_id, max(e.v) AS hi FROM e JOIN rk a ON a.graph_id = e.graph_id AND a.n = e.u JOIN rk b ON b.graph_id = e.graph_id AND b.n = e.v WHERE b.r = a.r + 2 GROUP BY e.graph_id)
      SELECT e.graph_id, count(*) AS n_edges, CAST(sum(v - u) AS BIGINT) AS len FROM e JOIN top ON e.graph_id = top.graph_id WHERE e.v <= top.hi GROUP BY e.graph_id""",
    "minimum_cuts": f"""WITH {ORDERS}, {CHAIN}, mk AS (SELECT DISTINCT graph_id, m FROM ch),
      w AS (SELECT graph_id, m, unnest(range(1 << (m - 2))) * 2 + 1 AS mask FROM mk)
      SELECT graph_id, min(cut) AS cut FROM (
        SELECT w.graph_id, w.mask, count(*) FILTER (((w.mask >> (a.k - 1)) & 1) <> ((w.mask >> (b.k - 1)) & 1)) AS cut
        FROM w JOIN e ON e.graph_id = w.graph_id JOIN ch a ON a.graph_id = e.graph_id AND a.n = e.u JOIN ch b ON b.graph_id = e.graph_id AND b.n = e.v GROUP BY ALL) GROUP BY graph_id""",
    "split_order_min_cost": f"{brute(ORDERS)} SELECT rt.graph_id, CASE WHEN count(cost) > 0 THEN 'solved' ELSE 'infeasible' END AS status, CAST(min(cost) AS BIGINT) AS cost FROM rt LEFT JOIN f ON rt.graph_id = f.graph_id GROUP BY rt.graph_id",
    "greedy_argmin": f"""WITH RECURSIVE {ORDERS},{CANDIDATES},
      g AS (SELECT graph_id, v AS vertex, list_sort(list(name)) AS given FROM e GROUP BY ALL)
      SELECT c.graph_id, c.vertex AS vertex_id, CAST(min(cost) AS BIGINT) AS cost FROM c LEFT JOIN g ON c.vertex = g.vertex AND c.graph_id = g.graph_id WHERE [es[j] for j in range(1, len(es) + 1) if (mask >> (j - 1)) & 1 = 1] = coalesce(given, []) GROUP BY ALL""",
    "beam_fixed": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value NULLS LAST, event_id) <= 5",
    "beam_percent": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value NULLS LAST, event_id) <= greatest(3, CAST(floor(0.1 * count(*) OVER (PARTITION BY user_id)) AS BIGINT))",
    "beam_probability": """WITH x AS (SELECT user_id, event_id, row_number() OVER w AS r, 1.0 + sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY CAST(round(value * 100) AS BIGINT), event_id ROWS UNBOUNDED PRECEDING) AS s
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY CAST(round(value * 100) AS BIGINT), event_id)),
      y AS (SELECT user_id, min(CASE WHEN s > 10000 THEN r - 1 END) AS cut FROM x GROUP BY user_id)
      SELECT x.user_id, event_id FROM x JOIN y ON x.user_id = y.user_id WHERE cut IS NULL OR r <= greatest(2, cut)""",
    "beam_delta_minmax": "SELECT user_id, event_id FROM (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id)) WHERE (value - lo) / (hi - lo + 0.00001) <= 0.05",
    "beam_delta_division": "SELECT user_id, event_id FROM (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id)) WHERE (value - lo) / (hi + 0.00001) <= 0.05",
    "beam_protected": """WITH x AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events),
      p AS (SELECT user_id, r AS pr FROM x WHERE f = 1)
      SELECT x.user_id, event_id FROM x JOIN p ON x.user_id = p.user_id WHERE CASE WHEN pr > 4 THEN r <= 3 OR r = pr ELSE r <= 4 END""",
    "voxelise": """WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS x1, CAST(l_linenumber AS DOUBLE) AS y1, l_discount * 100 AS z1, l_quantity / 2 AS x2, l_linenumber * 3.0 AS y2, l_tax * 100 AS z2, l_discount AS value FROM lineitem),
      p AS (SELECT id, CAST(trunc(x1 + (i / 5.0) * (x2 - x1)) AS BIGINT) AS x, CAST(trunc(y1 + (i / 5.0) * (y2 - y1)) AS BIGINT) AS y, CAST(trunc(z1 + (i / 5.0) * (z2 - z1)) AS BIGINT) AS z, CAST(trunc(value * 255) AS INTEGER) AS value FROM s, range(6) t(i))
      SELECT x, y, z, max(struct_pack(id := id, value := value)).value AS value FROM p GROUP BY x, y, z""",
    "id_map_join": f"WITH {TRADE}, m AS (SELECT x, row_number() OVER (ORDER BY x) AS y FROM (SELECT u AS x FROM trade UNION SELECT v FROM trade)) SELECT x AS vertex_id, y AS new_id FROM m",
    "merge_sequence_sizes": f"WITH {CUSTOMER} SELECT graph_id, count(DISTINCT vertex) - 1 AS n_steps FROM ends GROUP BY graph_id",
    "ply_round_trip": f"WITH {TRADE}, m AS (SELECT x, row_number() OVER (ORDER BY x) AS y FROM (SELECT u AS x FROM trade UNION SELECT v FROM trade)) SELECT CAST(u * 100 + v AS INTEGER) AS edge_name, a.y AS u, b.y AS v, CAST(w AS DOUBLE) AS len FROM trade JOIN m a ON u = a.x JOIN m b ON v = b.x",
    "cost_text_round_trip": f"WITH RECURSIVE {ORDERS},{CANDIDATES} SELECT graph_id, vertex AS vertex_id, code, CAST(cost AS DOUBLE) AS cost FROM c",
    "candidate_statistics": f"WITH RECURSIVE {ORDERS},{CANDIDATES} SELECT graph_id, max(n) AS most, CAST(sum(n) AS BIGINT) AS total, round(sum(ln(n)), 6) AS logs FROM (SELECT graph_id, vertex, count(*) AS n FROM c GROUP BY ALL) GROUP BY graph_id",
    "root_cost_zeroing": f"WITH RECURSIVE {ORDERS},{CANDIDATES} SELECT graph_id, vertex AS vertex_id, code, CAST(CASE WHEN vertex = root OR len(es) <= 2 THEN 0 ELSE cost END AS BIGINT) AS cost FROM c",
    "candidate_problems": f"""WITH {CUSTOMER}, i AS (SELECT graph_id, vertex, count(*) AS n FROM ends GROUP BY ALL)
      SELECT graph_id, vertex AS vertex_id, 'no_candidate' AS kind FROM i WHERE n > 2 OR vertex = 0
      UNION ALL SELECT graph_id, NULL, 'no_root' FROM (SELECT DISTINCT graph_id FROM i WHERE n <= 2 AND vertex <> 0)""",
    "solve_many": f"{brute(ORDERS)}, n AS (SELECT graph_id, count(*) AS n FROM e GROUP BY graph_id), b AS (SELECT graph_id, min(cost) AS cost FROM f GROUP BY graph_id) SELECT n.graph_id, CASE WHEN b.cost IS NULL THEN 'infeasible' ELSE 'solved' END AS status, CAST(b.cost AS BIGINT) AS cost, CASE WHEN b.cost IS NOT NULL THEN n + 1 END AS n_vertices, CASE WHEN b.cost IS NOT NULL THEN n END AS n_edges FROM n LEFT JOIN b ON n.graph_id = b.graph_id",
    "candidate_running_max": f"WITH RECURSIVE {ORDERS},{CANDIDATES} SELECT graph_id, vertex AS vertex_id, max(n) OVER (PARTITION BY graph_id ORDER BY vertex) AS most FROM (SELECT graph_id, vertex, count(*) AS n FROM c GROUP BY ALL)",
    "recover_trees": f"""{brute(ORDERS)}, q AS (SELECT graph_id, sum(x) AS x FROM (SELECT CAST(l_orderkey AS VARCHAR) AS graph_id, l_linenumber, CAST(max(l_quantity) AS DOUBLE) AS x FROM lineitem GROUP BY ALL) GROUP BY graph_id)
      SELECT e.graph_id, count(*) + 1 AS n_vertices, any_value(q.x) AS least_x, any_value(q.x) AS most_x, count(*) AS n_edges, CAST(sum(v - u) AS DOUBLE) AS len FROM e JOIN q ON e.graph_id = q.graph_id WHERE e.graph_id IN (SELECT graph_id FROM f) GROUP BY e.graph_id""",
    "up_converted_candidates": f"""WITH RECURSIVE {ORDERS},{CANDIDATES}
      SELECT graph_id, vertex AS vertex_id, code, CAST(cost AS BIGINT) AS cost FROM c WHERE vertex = root OR len(es) > 2
      UNION ALL SELECT graph_id, vertex, array_to_string(es, ',') || ':' || x, 0 FROM (SELECT *, unnest(es) AS x FROM inc WHERE len(es) <= 2 AND vertex <> root)""",
    "undirected_join": f"""WITH RECURSIVE {ORDERS},{CANDIDATES},
      p AS (SELECT e.graph_id, u, min(v) AS v FROM e JOIN rt ON e.graph_id = rt.graph_id AND u = root GROUP BY ALL),
      un AS (SELECT graph_id, vertex, es, lab, mx, min(cost) AS cost FROM c GROUP BY ALL),
      h AS (SELECT un.*, p.u, p.v, p.u * 10 + p.v AS name, list_position(es, p.u * 10 + p.v) AS s, [j for j in range(1, len(es) + 1) if es[j] <> p.u * 10 + p.v] AS js FROM un JOIN p ON un.graph_id = p.graph_id AND (vertex = u OR vertex = v)),
      j AS (SELECT l.graph_id, l.cost + r.cost AS cost, len(l.es) + len(r.es) AS size,
        list_sort(list_concat(
          [[l.es[i] for i in l.js if l.lab[i] = k] for k in range(l.mx + 1) if k <> l.lab[l.s]], [[r.es[i] for i in r.js if r.lab[i] = k] for k in range(r.mx + 1) if k <> r.lab[r.s]],
          [list_sort(list_concat([l.es[i] for i in l.js if l.lab[i] = l.lab[l.s]], [r.es[i] for i in r.js if r.lab[i] = r.lab[r.s]]))])) AS bl
        FROM h l JOIN h r ON l.graph_id = r.graph_id WHERE l.vertex = l.u AND r.vertex = r.v)
      SELECT graph_id, count(DISTINCT CAST(bl AS VARCHAR)) AS n_states, CAST(min(cost) AS BIGINT) AS best_cost FROM j WHERE size = 2 OR len([b for b in bl if len(b) = 0]) = 0 GROUP BY graph_id""",
    "beam_histogram": """SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS events, round(sum(round(value, 2)), 2) AS total
      FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value NULLS LAST, event_id) <= 3) GROUP BY user_id""",
    "planar_triangles": f"WITH {TRIANGLES} SELECT * FROM tri",
    "planar_dual": f"""WITH {TRIANGLES}, n AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY p, q, r) AS k FROM tri),
      s AS (SELECT graph_id, k, p AS s, q AS t FROM n UNION ALL SELECT graph_id, k, p, r FROM n UNION ALL SELECT graph_id, k, q, r FROM n),
      e AS (SELECT graph_id, min(k) AS u, max(k) AS v FROM s GROUP BY graph_id, s, t HAVING count(*) = 2)
      SELECT graph_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY u, v) AS INTEGER) AS edge_name, u, v FROM e""",
    "order_paths": f"{ORDER_DIST} SELECT * FROM dist",
    "order_directions": f"""{ORDER_DIST} SELECT e.graph_id, name AS edge_name, CASE WHEN (a.dist, u) < (b.dist, v) THEN u ELSE v END AS parent, CASE WHEN (a.dist, u) < (b.dist, v) THEN v ELSE u END AS child
      FROM e JOIN dist a ON e.graph_id = a.graph_id AND u = a.vertex_id JOIN dist b ON e.graph_id = b.graph_id AND v = b.vertex_id""",
}
