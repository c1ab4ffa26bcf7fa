"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from graphspark.operators.encode import NAMES
from graphspark.plans.study import MARKED, NODE_REFERENCE, NOT_A_NO, STRIPPED

#: The graph collection of the order tables.
GRAPHS = """
bought AS (
  SELECT o_custkey AS graph_id, o_orderkey, CAST(l_partkey % 40 AS INTEGER) AS node FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), sets AS (SELECT DISTINCT graph_id, o_orderkey, node FROM bought),
nodes AS (SELECT DISTINCT graph_id, node FROM sets),
edges AS (
  SELECT DISTINCT a.graph_id, a.node AS u, b.node AS v FROM sets a JOIN sets b ON a.graph_id = b.graph_id AND a.o_orderkey = b.o_orderkey AND a.node < b.node
), arcs AS (
  SELECT graph_id, u AS node, v AS nbr FROM edges UNION ALL SELECT graph_id, v, u FROM edges
), deg AS (
  SELECT n.graph_id, n.node, CAST(count(a.nbr) AS INTEGER) AS degree FROM nodes n LEFT JOIN arcs a ON n.graph_id = a.graph_id AND n.node = a.node GROUP BY ALL
), tri AS (
  SELECT x.graph_id, x.u AS a, x.v AS b, y.v AS c FROM edges x JOIN edges y ON x.graph_id = y.graph_id AND x.v = y.u
  JOIN edges z ON z.graph_id = x.graph_id AND z.u = x.u AND z.v = y.v
), tnode AS (
  SELECT graph_id, node, count(*) AS t FROM (
    SELECT graph_id, a AS node FROM tri UNION ALL SELECT graph_id, b FROM tri UNION ALL SELECT graph_id, c FROM tri) GROUP BY ALL
), clus AS (
  SELECT d.graph_id, d.node, d.degree, CASE WHEN d.degree < 2 THEN 0.0 ELSE 2.0 * coalesce(t.t, 0) / (d.degree * (d.degree - 1)) END::DOUBLE AS clustering
  FROM deg d LEFT JOIN tnode t USING (graph_id, node)
), w2 AS (
  SELECT a.graph_id, a.node, sum(1.0 / dn.degree)::DOUBLE / any_value(d.degree) AS p
  FROM arcs a JOIN deg d ON d.graph_id = a.graph_id AND d.node = a.node JOIN deg dn ON dn.graph_id = a.graph_id AND dn.node = a.nbr GROUP BY a.graph_id, a.node
), w3 AS (
  SELECT a.graph_id, a.node, sum((1.0::DOUBLE / dj.degree) / dk.degree) / any_value(d.degree) AS p
  FROM arcs a JOIN arcs b ON b.graph_id = a.graph_id AND b.node = a.nbr JOIN arcs c ON c.graph_id = a.graph_id AND c.node = b.nbr AND c.nbr = a.node
  JOIN deg d ON d.graph_id = a.graph_id AND d.node = a.node JOIN deg dj ON dj.graph_id = a.graph_id AND dj.node = a.nbr
  JOIN deg dk ON dk.graph_id = a.graph_id AND dk.node = b.nbr GROUP BY a.graph_id, a.node
), rw AS (
  SELECT n.graph_id, n.node, coalesce(w2.p, 0.0) AS rwse2, coalesce(w3.p, 0.0) AS rwse3
  FROM nodes n LEFT JOIN w2 USING (graph_id, node) LEFT JOIN w3 USING (graph_id, node)
), ordered AS (
  SELECT graph_id, node, row_number() OVER (PARTITION BY graph_id ORDER BY (7919 * node + 104729 * graph_id) % 1009, node) AS r FROM nodes
), tg AS (
  SELECT x.graph_id, x.node AS a, y.node AS b FROM ordered x LEFT JOIN ordered y ON x.graph_id = y.graph_id AND y.r = 2 WHERE x.r = 1
)
"""

REACH = """
, reach(graph_id, node, other) AS (
  SELECT graph_id, node, node FROM nodes UNION SELECT r.graph_id, r.node, a.nbr FROM reach r JOIN arcs a ON a.graph_id = r.graph_id AND a.node = r.other
), labels AS (SELECT graph_id, node, min(other) AS component FROM reach GROUP BY ALL)
"""


def _on_graphs(body: str, reach: bool = False) -> str:
    return f"WITH {'RECURSIVE' if reach else ''} {GRAPHS} {REACH if reach else ''} {body}"


#: Two decimals of a double as text; rounded to six places first.
TWO = "printf('%.2f', round({0}, 6))"
_FILLER = "'Node ' || node || ' is simply present within the graph G.'"
_RWSE = "'return probability ' || " + TWO.format("rwse2") + " || ' after 2 steps and ' || " + TWO.format("rwse3") + " || ' after 3 steps'"
_CLUS = "'clustering coefficient ' || " + TWO.format("clustering")
_NAMES = "names AS (SELECT graph_id, list(CAST(node AS VARCHAR) ORDER BY node) AS ns FROM nodes GROUP BY graph_id)"
_JOINED = """CASE WHEN len(ns) = 1 THEN ns[1] WHEN len(ns) = 2 THEN ns[1] || ' and ' || ns[2]
  ELSE array_to_string(ns[1:len(ns) - 1], ', ') || ', and ' || ns[len(ns)] END"""


def _primer(sentence: str, source: str) -> str:
    return f"SELECT graph_id, string_agg({sentence}, ' ' ORDER BY node) AS primer FROM {source} GROUP BY graph_id"


_INCIDENT = f"""
  SELECT n.graph_id, 'G describes a graph among nodes ' || {_JOINED} || '.' || chr(10)
    || CASE WHEN l.t IS NULL THEN '' ELSE 'In this graph:' || chr(10) || l.t END AS text
  FROM names n LEFT JOIN (
    SELECT graph_id, string_agg('Node ' || node || ' is connected to ' || CASE WHEN k > 1 THEN 'nodes ' ELSE 'node ' END || s || '.' || chr(10), '' ORDER BY node) AS t
    FROM (SELECT graph_id, node, count(*) AS k, string_agg(CAST(nbr AS VARCHAR), ', ' ORDER BY nbr) AS s FROM arcs GROUP BY ALL) GROUP BY graph_id
  ) l USING (graph_id)
"""

#: Responses of the event table and the frame of scored ones.
FRAME = """
resp AS (
  SELECT event_id, 'm' || (event_id % 4) AS arm, CASE WHEN event_type = 'view' THEN 'none' ELSE event_type END AS condition, user_id AS unit,
    CAST(user_id % 20 AS VARCHAR) AS gold, event_id % 40 AS node, CAST(floor(value) AS BIGINT) AS v,
    event_id % 13 = 0 AS hit_cap, CAST(floor(value * 10) AS BIGINT) AS n_tokens
  FROM events
), meant AS (
  SELECT *, CASE WHEN v % 10 < 6 THEN CAST(gold AS BIGINT) ELSE CAST(gold AS BIGINT) + 1 + v % 3 END AS meant FROM resp
), texts AS (
  SELECT *, CASE event_id % 5 WHEN 0 THEN concat('The degree of node ', node, ' is **', meant, '**.')
    WHEN 1 THEN concat('Node ', node, ' is connected to node 3.', chr(10), 'The answer is ', meant, '. This is because node 99 is far.')
    WHEN 2 THEN concat('Final answer: ', meant) WHEN 3 THEN concat('I count ', meant, ' edges at node ', node, '.') ELSE concat('Answer: it is ', meant, '. Not ', meant + 7, '.') END AS response FROM meant
), marks AS (
  SELECT *, regexp_extract_all(response, '@MARK', 1) AS ms, regexp_extract_all(regexp_replace(response, '@NODE', ' ', 'g'), '-?[0-9]+') AS masked, regexp_extract_all(response, '-?[0-9]+') AS ints FROM texts
), tails AS (SELECT *, @LAST AS tail, @FIRST AS head FROM marks), near AS (
  SELECT *, regexp_extract_all(regexp_replace(regexp_extract(tail, '^[^.]*\\.?'), '@NODE', ' ', 'g'), '-?[0-9]+') AS nl, regexp_extract_all(regexp_replace(regexp_extract(head, '^[^.]*\\.?'), '@NODE', ' ', 'g'), '-?[0-9]+') AS nf FROM tails
), said AS (
  SELECT *, coalesce(CASE WHEN NOT ends_with(tail, ':') THEN nl[-1] END, masked[-1], ints[-1]) AS pred, coalesce(CASE WHEN NOT ends_with(head, ':') THEN nf[1] END, ints[1]) AS pred_first FROM near
), first AS (
  SELECT * FROM said QUALIFY row_number() OVER (PARTITION BY arm, unit, condition ORDER BY event_id) = 1
), frame AS (
  SELECT *, CAST(pred = gold AS INTEGER) AS exact, CAST(abs(CAST(pred AS BIGINT) - CAST(gold AS BIGINT)) AS INTEGER) AS abs_error,
    CASE WHEN hit_cap THEN 'truncated' WHEN pred = gold THEN 'correct' ELSE 'wrong' END AS outcome,
    CAST(NOT hit_cap AND pred = gold AS INTEGER) AS correct, CAST(hit_cap AS INTEGER) AS truncated FROM first
), pairs AS (
  SELECT a.arm, a.unit, b.condition, a.correct AS correct_a, b.correct AS correct_b, a.truncated AS truncated_a, b.truncated AS truncated_b
  FROM frame a JOIN frame b ON a.arm = b.arm AND a.unit = b.unit WHERE a.condition = 'none' AND b.condition <> 'none'
)
"""

FRAME = FRAME.replace("@MARK", MARKED).replace("@NODE", NODE_REFERENCE).replace("@LAST", STRIPPED.format("ms[-1]")).replace("@FIRST", STRIPPED.format("ms[1]"))

_COUNTS = """count(*) AS n, avg(correct_a) AS share_a, avg(correct_b) AS share_b, 100 * (avg(correct_b) - avg(correct_a)) AS delta,
  CAST(sum(CASE WHEN correct_a = 1 AND correct_b = 0 THEN 1 ELSE 0 END) AS BIGINT) AS broke, CAST(sum(CASE WHEN correct_a = 0 AND correct_b = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fixed,
  100 * (avg(truncated_b) - avg(truncated_a)) AS d_truncated"""

_P = """CASE WHEN broke = fixed THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(broke, fixed) + 1),
  lambda i: exp(lgamma(broke + fixed + 1) - lgamma(i + 1) - lgamma(broke + fixed - i + 1) - (broke + fixed) * ln(2.0))))) END"""


def _tested(group: str) -> str:
    return f"counts AS (SELECT {group}, {_COUNTS} FROM pairs GROUP BY {group}), tested AS (SELECT *, {_P} AS p FROM counts)"


def _q(part: str) -> str:
    return f"""ranked AS (SELECT *, row_number() OVER ({part} ORDER BY p) AS rk, count(*) OVER ({part}) AS m FROM tested),
    adjusted AS (SELECT *, least(1.0, min(p * m / rk) OVER ({part} ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM ranked)"""


def _on_frame(body: str) -> str:
    return f"WITH {FRAME}{body}"


SQL: dict[str, str] = {
    "node_degree": _on_graphs("SELECT graph_id, node, degree FROM deg"),
    "edge_count": _on_graphs("SELECT g.graph_id, count(e.u) AS n_edges FROM (SELECT DISTINCT graph_id FROM nodes) g LEFT JOIN edges e USING (graph_id) GROUP BY ALL"),
    "node_count": _on_graphs("SELECT graph_id, count(*) AS n_nodes FROM nodes GROUP BY ALL"),
    "neighbor_list": _on_graphs("SELECT graph_id, node, string_agg(CAST(nbr AS VARCHAR), ', ' ORDER BY nbr) AS answer FROM arcs GROUP BY ALL"),
    "triangle_count": _on_graphs("SELECT g.graph_id, count(t.a) AS n_triangles FROM (SELECT DISTINCT graph_id FROM nodes) g LEFT JOIN tri t USING (graph_id) GROUP BY ALL"),
    "clustering_coeff": _on_graphs("SELECT graph_id, node, degree, round(clustering, 9) AS clustering FROM clus"),
    "rwse2": _on_graphs("SELECT graph_id, node, round(rwse2, 9) AS rwse2 FROM rw"),
    "rwse3": _on_graphs("SELECT graph_id, node, round(rwse3, 9) AS rwse3 FROM rw"),
    "component_count": _on_graphs("SELECT graph_id, count(*) AS n_components FROM labels WHERE node = component GROUP BY ALL", True),
    "modal_degree_share": _on_graphs("SELECT graph_id, round(max(k) / sum(k), 9) AS share FROM (SELECT graph_id, degree, count(*) AS k FROM deg GROUP BY ALL) GROUP BY ALL"),
    "rendered_clustering_sd": _on_graphs(f"SELECT graph_id, round(stddev_pop(CAST({TWO.format('clustering')} AS DOUBLE)), 6) AS sd FROM clus GROUP BY ALL"),
    "rwse_degree_corr": _on_graphs(
        "SELECT graph_id, round(CASE WHEN stddev_pop(degree) = 0 OR stddev_pop(rwse2) = 0 THEN NULL ELSE corr(degree, rwse2) END, 6) AS r FROM deg JOIN rw USING (graph_id, node) GROUP BY ALL"
    ),
    "topology_row": _on_graphs(
        """, cc AS (SELECT graph_id, component, count(*) AS k FROM labels GROUP BY ALL), big AS (SELECT graph_id, count(*) AS n_components, max(k) AS largest_cc FROM cc GROUP BY ALL),
        tc AS (SELECT graph_id, count(*) AS t FROM tri GROUP BY ALL)
        SELECT c.graph_id, count(*) AS n_nodes, CAST(sum(degree) / 2 AS BIGINT) AS n_edges,
          round(CASE WHEN count(*) > 1 THEN sum(degree) / (count(*) * (count(*) - 1)) ELSE 0 END, 9) AS density_real, round(avg(degree), 9) AS mean_degree,
          any_value(n_components) AS n_components, any_value(largest_cc) AS largest_cc, coalesce(any_value(t), 0) AS n_triangles, round(avg(clustering), 9) AS mean_clustering
        FROM clus c JOIN big USING (graph_id) LEFT JOIN tc USING (graph_id) GROUP BY c.graph_id""",
        True,
    ),
    "shortest_path": _on_graphs(
        """, bfs(graph_id, src, node, dist) AS (
          SELECT graph_id, node, node, 0 FROM nodes
          UNION SELECT b.graph_id, b.src, a.nbr, b.dist + 1 FROM bfs b JOIN arcs a ON a.graph_id = b.graph_id AND a.node = b.node WHERE b.dist < 40
        ), best AS (SELECT graph_id, src, node, min(dist) AS dist FROM bfs GROUP BY ALL)
        SELECT graph_id, CAST(dist AS INTEGER) AS dist, count(*) AS pairs FROM best WHERE src < node GROUP BY ALL""",
        True,
    ).replace("b.dist < 40", "b.dist < 12"),
    "gold_edge_existence": _on_graphs("SELECT t.graph_id, a, b, CASE WHEN e.u IS NULL THEN 'No' ELSE 'Yes' END AS gold FROM tg t LEFT JOIN edges e ON e.graph_id = t.graph_id AND e.u = least(a, b) AND e.v = greatest(a, b) WHERE b IS NOT NULL"),
    "gold_reachability": _on_graphs(
        "SELECT t.graph_id, a, b, CASE WHEN x.component = y.component THEN 'Yes' ELSE 'No' END AS gold FROM tg t JOIN labels x ON x.graph_id = t.graph_id AND x.node = a JOIN labels y ON y.graph_id = t.graph_id AND y.node = b", True
    ),
    "gold_cycle_check": _on_graphs(
        """, n AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY ALL), m AS (SELECT graph_id, count(*) AS m FROM edges GROUP BY ALL),
        c AS (SELECT graph_id, count(*) AS c FROM labels WHERE node = component GROUP BY ALL)
        SELECT t.graph_id, a, b, CASE WHEN coalesce(m, 0) - n + c > 0 THEN 'Yes, there is a cycle' ELSE 'No, there is no cycle' END AS gold FROM tg t JOIN n USING (graph_id) JOIN c USING (graph_id) LEFT JOIN m USING (graph_id)""",
        True,
    ),
    "gold_connected_nodes": _on_graphs("SELECT t.graph_id, a, b, coalesce(string_agg(CAST(nbr AS VARCHAR), ', ' ORDER BY nbr), 'No nodes') AS gold FROM tg t LEFT JOIN arcs x ON x.graph_id = t.graph_id AND x.node = a GROUP BY t.graph_id, a, b"),
    "gold_disconnected_nodes": _on_graphs(
        """SELECT t.graph_id, a, b, coalesce(string_agg(CAST(n.node AS VARCHAR), ', ' ORDER BY CAST(n.node AS VARCHAR)), 'No nodes') AS gold
        FROM tg t LEFT JOIN (SELECT n.graph_id, n.node FROM nodes n JOIN tg ON tg.graph_id = n.graph_id AND n.node <> tg.a
          WHERE NOT EXISTS (SELECT 1 FROM arcs x WHERE x.graph_id = n.graph_id AND x.node = tg.a AND x.nbr = n.node)) n ON n.graph_id = t.graph_id GROUP BY t.graph_id, a, b"""
    ),
    "common_neighbors": _on_graphs(
        "SELECT e.graph_id, e.u AS a, e.v AS b, CAST(count(y.nbr) AS INTEGER) AS shared FROM edges e JOIN arcs x ON x.graph_id = e.graph_id AND x.node = e.u LEFT JOIN arcs y ON y.graph_id = e.graph_id AND y.node = e.v AND y.nbr = x.nbr GROUP BY ALL"
    ),
    "corpus_report": _on_graphs(
        """, c AS (SELECT graph_id, count(*) AS c FROM labels WHERE node = component GROUP BY ALL), g AS (SELECT graph_id, avg(clustering) AS mc, sum(degree) AS s FROM clus GROUP BY ALL),
        t AS (SELECT DISTINCT graph_id, 1 AS t FROM tri)
        SELECT count(*) AS graphs, round(avg(CAST(c = 1 AS INTEGER)), 9) AS connected, round(avg(CAST(s = 0 AS INTEGER)), 9) AS edgeless, round(avg(CASE WHEN t IS NULL THEN 1 ELSE 0 END), 9) AS triangle_free, round(avg(mc), 9) AS mean_clustering
        FROM g JOIN c USING (graph_id) LEFT JOIN t USING (graph_id)""",
        True,
    ),
    "multiset_diff": _on_graphs(
        """, keys AS (SELECT n.graph_id, count(DISTINCT n.node) || ':' || coalesce((SELECT string_agg(u || '-' || v, ' ' ORDER BY u, v) FROM edges e WHERE e.graph_id = n.graph_id), '') AS key FROM nodes n GROUP BY n.graph_id)
        SELECT key FROM keys WHERE graph_id % 2 = 0 EXCEPT ALL SELECT key FROM keys WHERE graph_id % 2 = 1"""
    ),
    "arithmetic_density": """
        WITH k AS (SELECT g, i AS level, p FROM range(50) t(g), (VALUES (0, 100), (1, 200), (2, 350), (3, 500)) l(i, p)),
        e AS (SELECT level FROM k, range(40) a(u), range(40) b(v) WHERE u < v AND (7919 * u * u + 104729 * v + 1299709 * u * v + 15485863 * (g + 1) * (u + 3 * v + p)) % 1000 < p)
        SELECT CAST(level AS BIGINT) AS level, round(count(*) / (50 * 780), 9) AS density FROM e GROUP BY level""",
    "exact_island": """
        WITH p AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS i, a, b FROM range(5) x(a), range(5) y(b) WHERE a < b),
        d AS (SELECT mask, n, count(p.i) AS deg FROM range(1024) m(mask) CROSS JOIN range(5) q(n) LEFT JOIN p ON (p.a = n OR p.b = n) AND (mask >> p.i) & 1 = 1 GROUP BY ALL),
        g AS (SELECT mask, list(deg ORDER BY n) AS ds FROM d GROUP BY mask), c AS (SELECT ds, count(*) AS k FROM g GROUP BY ds)
        SELECT CAST(sum(k) AS BIGINT) AS graphs, count(*) AS classes, CAST(sum(CAST(k = 1 AS INTEGER)) AS BIGINT) AS determined FROM c""",
    "incident_text": _on_graphs(f", {_NAMES} {_INCIDENT}"),
    "adjacency_text": _on_graphs(
        f""", {_NAMES} SELECT n.graph_id, 'In an undirected graph, (i,j) means that node i and node j are connected with an undirected edge. G describes a graph among nodes ' || {_JOINED} || '.' || chr(10)
        || CASE WHEN e.t IS NULL THEN '' ELSE 'The edges in G are: ' || e.t END || '.' || chr(10) AS text
        FROM names n LEFT JOIN (SELECT graph_id, string_agg('(' || u || ', ' || v || ')', ' ' ORDER BY u, v) AS t FROM edges GROUP BY graph_id) e USING (graph_id)"""
    ),
    "triples_text": _on_graphs(
        "SELECT g.graph_id, coalesce(string_agg('(' || u || ', linked, ' || v || ')', ' ' ORDER BY u, v), '') || '.' || chr(10) AS text FROM (SELECT DISTINCT graph_id FROM nodes) g LEFT JOIN edges e USING (graph_id) GROUP BY g.graph_id"
    ),
    "primer_components": _on_graphs("SELECT graph_id, 'This graph has ' || count(*) || ' connected component' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || '.' AS primer FROM labels WHERE node = component GROUP BY graph_id", True),
    "primer_degree": _on_graphs(_primer("'Node ' || node || ' has degree ' || degree || '.'", "deg")),
    "primer_filler": _on_graphs(_primer(_FILLER, "nodes")),
    "primer_clustering": _on_graphs(_primer(f"'Node ' || node || ' has ' || {_CLUS} || '.'", "clus")),
    "primer_rwse": _on_graphs(_primer(f"'Node ' || node || ' has ' || {_RWSE} || '.'", "rw")),
    "primer_all": _on_graphs(_primer(f"'Node ' || node || ' has degree ' || degree || ', ' || {_CLUS} || ', and ' || {_RWSE} || '.'", "(SELECT * FROM clus JOIN rw USING (graph_id, node))")),
    "primer_roundtrip_check": _on_graphs(
        f""", p AS ({_primer("'Node ' || node || ' has degree ' || degree || '.'", "deg")}), r AS (SELECT graph_id, CAST(unnest(regexp_extract_all(primer, 'Node ([0-9]+) has degree ([0-9]+)', 1)) AS INTEGER) AS node, CAST(unnest(regexp_extract_all(primer, 'Node ([0-9]+) has degree ([0-9]+)', 2)) AS INTEGER) AS said FROM p)
        SELECT coalesce(d.graph_id, r.graph_id) AS graph_id, coalesce(d.node, r.node) AS node, degree, said FROM deg d FULL JOIN r ON r.graph_id = d.graph_id AND r.node = d.node WHERE said IS NULL OR degree IS NULL OR said <> degree"""
    ),
    "primer_parse_degree": _on_graphs("SELECT graph_id, CAST(count(*) AS INTEGER) AS n, CAST(sum(degree) AS INTEGER) AS degree_sum FROM deg GROUP BY ALL"),
    "prompt_stats": _on_graphs(
        f""", t AS (SELECT 'components' AS condition, length('This graph has ' || count(*) || ' connected component' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || '.') AS chars FROM labels WHERE node = component GROUP BY graph_id
        UNION ALL SELECT 'degree', length(string_agg('Node ' || node || ' has degree ' || degree || '.', ' ')) FROM deg GROUP BY graph_id
        UNION ALL SELECT 'filler', length(string_agg({_FILLER}, ' ')) FROM nodes GROUP BY graph_id)
        SELECT condition, median(chars) AS median_chars, count(*) AS prompts FROM t GROUP BY ALL""",
        True,
    ),
    "prompt_build": _on_graphs(
        f""", {_NAMES}, inc AS ({_INCIDENT}), pr AS ({_primer("'Node ' || node || ' has degree ' || degree || '.'", "deg")})
        SELECT graph_id, primer || chr(10) || chr(10) || text || 'Q: What is the degree of node ' || a || '?' || chr(10) || 'A: ' AS prompt FROM pr JOIN inc USING (graph_id) JOIN tg USING (graph_id)"""
    ),
    "solver_lookup_fit": """
        WITH r AS (SELECT d.doc_id % 2 AS fold, lang, CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS gold FROM documents d JOIN labels l USING (doc_id)),
        c AS (SELECT lang, gold, count(*) AS k FROM r WHERE fold = 0 GROUP BY ALL),
        t AS (SELECT lang, gold AS answer FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY k DESC, gold DESC) = 1)
        SELECT r.lang, count(*) AS n, round(avg(CAST(answer = r.gold AS INTEGER)), 9) AS accuracy FROM r LEFT JOIN t USING (lang) WHERE fold = 1 GROUP BY r.lang""",
    "solver_threshold_fit": """
        WITH r AS (SELECT n_chars AS x, CAST(quality = 1 AS INTEGER) AS y FROM documents JOIN labels USING (doc_id) WHERE doc_id % 2 = 0),
        v AS (SELECT DISTINCT x FROM r),
        s AS (SELECT v.x, sum(CASE WHEN (r.x >= v.x) = (r.y = 1) THEN 1 ELSE 0 END) AS up, count(*) AS n FROM v CROSS JOIN r GROUP BY v.x),
        o AS (SELECT x, true AS above, up AS hits, n FROM s UNION ALL SELECT x, false, n - up, n FROM s)
        SELECT x AS threshold, above, CAST(hits AS BIGINT) AS hits, n FROM o ORDER BY hits DESC, x, above DESC LIMIT 1""",
    "solver_line_fit": _on_graphs(
        """, n AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY ALL), m AS (SELECT graph_id, count(*) AS m FROM edges GROUP BY ALL)
        SELECT round(regr_slope(coalesce(m, 0), n), 6) AS slope, round(regr_intercept(coalesce(m, 0), n), 6) AS intercept, count(*) AS n FROM n LEFT JOIN m USING (graph_id)"""
    ),
    "solver_bars": _on_graphs(
        """, nn AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY ALL),
        ee AS (SELECT t.graph_id, CASE WHEN x.degree = 0 OR y.degree = 0 THEN 'No' WHEN x.degree = n - 1 OR y.degree = n - 1 THEN 'Yes' END AS said, CASE WHEN e.u IS NULL THEN 'No' ELSE 'Yes' END AS gold
          FROM tg t JOIN nn USING (graph_id) JOIN deg x ON x.graph_id = t.graph_id AND x.node = a JOIN deg y ON y.graph_id = t.graph_id AND y.node = b
          LEFT JOIN edges e ON e.graph_id = t.graph_id AND e.u = least(a, b) AND e.v = greatest(a, b)),
        maj AS (SELECT gold FROM ee GROUP BY gold ORDER BY count(*) DESC, gold DESC LIMIT 1)
        SELECT 'edge_existence' AS task, round(avg(CAST(coalesce(said, (SELECT gold FROM maj)) = gold AS INTEGER)), 9) AS bar, count(*) AS n FROM ee
        UNION ALL SELECT 'edge_count', round(avg(CAST(h = m AS INTEGER)), 9), count(*) FROM (SELECT graph_id, CAST(sum(degree) / 2 AS BIGINT) AS h FROM deg JOIN tg USING (graph_id) WHERE b IS NOT NULL GROUP BY graph_id) JOIN (SELECT n.graph_id, count(e.u) AS m FROM nn n LEFT JOIN edges e USING (graph_id) GROUP BY n.graph_id) USING (graph_id)
        UNION ALL SELECT 'node_degree', round(avg(CAST(degree = k AS INTEGER)), 9), count(*) FROM (SELECT * FROM tg WHERE b IS NOT NULL) tg JOIN deg ON deg.graph_id = tg.graph_id AND deg.node = tg.a JOIN (SELECT t.graph_id AS g, count(x.nbr) AS k FROM tg t LEFT JOIN arcs x ON x.graph_id = t.graph_id AND x.node = t.a GROUP BY t.graph_id) ON g = tg.graph_id"""
    ),
    "extract_integer": _on_frame("SELECT event_id, pred, pred_first FROM said"),
    "extract_boolean": rf"""
        WITH t AS (SELECT conv_id, turn, concat(text, CASE turn % 3 WHEN 0 THEN ' Answer: Yes.' WHEN 1 THEN ' There are no nodes. So no' ELSE '' END) AS x FROM conversations),
        m AS (SELECT *, {STRIPPED.format(f"regexp_extract_all(x, '{MARKED}', 1)[-1]")} AS tail FROM t),
        w AS (SELECT *, coalesce(regexp_extract_all(regexp_replace(tail, '{NOT_A_NO}', ' ', 'g'), '(?i)\b(yes|no)\b', 1)[-1], regexp_extract_all(regexp_replace(x, '{NOT_A_NO}', ' ', 'g'), '(?i)\b(yes|no)\b', 1)[-1]) AS a FROM m)
        SELECT conv_id, turn, upper(a[1]) || lower(a[2:]) AS answer FROM w""",
    "extract_node_list": _on_graphs("SELECT t.graph_id, coalesce(string_agg(CAST(nbr AS VARCHAR), ', ' ORDER BY nbr), 'No nodes') AS answer FROM tg t LEFT JOIN arcs x ON x.graph_id = t.graph_id AND x.node = a GROUP BY t.graph_id"),
    "score_set_f1": _on_graphs(
        """, na AS (SELECT t.graph_id, a, b, (SELECT count(*) FROM arcs x WHERE x.graph_id = t.graph_id AND x.node = a) AS p, (SELECT count(*) FROM arcs x WHERE x.graph_id = t.graph_id AND x.node = b) AS q,
          (SELECT count(*) FROM arcs x JOIN arcs y ON x.graph_id = y.graph_id AND x.nbr = y.nbr WHERE x.graph_id = t.graph_id AND x.node = a AND y.node = b) AS h FROM tg t)
        SELECT graph_id, round(CASE WHEN p + q = 0 THEN 1.0 ELSE 2.0 * h / (p + q) END::DOUBLE, 9) AS f1 FROM na"""
    ),
    "score_rows": _on_frame("SELECT event_id, pred, exact, abs_error, outcome FROM frame"),
    "majority_baseline": _on_frame(
        ", c AS (SELECT arm, gold, count(*) AS k FROM resp GROUP BY ALL), s AS (SELECT arm, max(k) / sum(k) AS share FROM c GROUP BY ALL) SELECT arm, gold AS answer, round(share, 9) AS share FROM c JOIN s USING (arm) QUALIFY row_number() OVER (PARTITION BY arm ORDER BY k DESC, gold) = 1"
    ),
    "outcome_shares": _on_frame(
        "SELECT arm, condition, count(*) AS n, round(avg(CAST(outcome = 'correct' AS INTEGER)), 9) AS correct, round(avg(CAST(outcome = 'wrong' AS INTEGER)), 9) AS wrong, round(avg(truncated), 9) AS truncated, avg(truncated) >= 0.15 AS flagged FROM frame GROUP BY ALL"
    ),
    "pairs_inner": _on_frame("SELECT * FROM pairs"),
    "effect_main": _on_frame(
        f", {_tested('arm, condition')}, {_q('')} SELECT arm, condition, n, round(share_a, 9) AS share_a, round(share_b, 9) AS share_b, round(delta, 9) AS delta, broke, fixed, round(p, 9) AS p, round(q, 9) AS q, round(d_truncated, 9) AS d_truncated FROM adjusted"
    ),
    "mcnemar": _on_frame(f", {_tested('condition')} SELECT condition, broke, fixed, round(p, 9) AS p FROM tested"),
    "bh_qvalues": _on_frame(f", {_tested('arm, condition')}, {_q('PARTITION BY arm')} SELECT arm, condition, round(p, 9) AS p, round(q, 9) AS q FROM adjusted"),
    "holm": _on_frame(
        f", {_tested('arm, condition')}, r AS (SELECT *, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS m FROM tested) SELECT arm, condition, round(least(1.0, max(p * (m - rk + 1)) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS holm FROM r"
    ),
    "mde_closed_form": _on_frame(f", {_tested('condition')} SELECT condition, round(100 * (1.959964 + 0.841621) * sqrt((broke + fixed) / n / n), 6) AS mde FROM tested"),
    "baseline_bands": _on_frame(
        """, base AS (SELECT unit, avg(correct) AS base FROM frame WHERE condition = 'none' GROUP BY unit)
        SELECT CASE WHEN base < 0.25 THEN '[0,0.25)' WHEN base < 0.5 THEN '[0.25,0.5)' WHEN base < 0.75 THEN '[0.5,0.75)' WHEN base < 0.9 THEN '[0.75,0.9)' ELSE '[0.9,1.01)' END AS band, count(*) AS n,
          round(100 * (avg(correct_b) - avg(correct_a)), 9) AS delta, CAST(sum(CASE WHEN correct_a = 1 AND correct_b = 0 THEN 1 ELSE 0 END) AS BIGINT) AS broke, CAST(sum(CASE WHEN correct_a = 0 AND correct_b = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fixed
        FROM pairs JOIN base USING (unit) GROUP BY ALL"""
    ),
    "joint_tasks": _on_frame("SELECT a.condition, count(*) AS n, round(avg(a.correct * b.correct), 9) AS joint FROM frame a JOIN frame b ON a.unit = b.unit AND a.condition = b.condition WHERE a.arm = 'm0' AND b.arm = 'm1' GROUP BY ALL"),
    "balanced_accuracy": _on_frame(
        ", y AS (SELECT *, CAST(gold AS INTEGER) >= 10 AS yes FROM frame) SELECT arm, condition, round(avg(CASE WHEN yes THEN correct ELSE 1 - correct END), 9) AS yes_rate, round((avg(correct) FILTER (yes) + avg(correct) FILTER (NOT yes)) / 2, 9) AS balanced FROM y GROUP BY ALL"
    ),
    "pivot_churn": _on_frame(
        ", w AS (SELECT unit, max(outcome) FILTER (condition = 'none') AS \"none\", max(outcome) FILTER (condition = 'click') AS click, max(outcome) FILTER (condition = 'purchase') AS purchase FROM frame WHERE arm = 'm0' GROUP BY unit) SELECT \"none\", click, purchase, count(*) AS units FROM w GROUP BY ALL"
    ),
    "kappa": _on_frame(
        ", s AS (SELECT condition, count(*) AS n, avg(correct_a) AS pa, avg(correct_b) AS pb, avg(CAST(correct_a = correct_b AS INTEGER)) AS o FROM pairs GROUP BY ALL), t AS (SELECT sum(n * o) / sum(n) AS ob, sum(n * (pa * pb + (1 - pa) * (1 - pb))) / sum(n) AS ex FROM s) SELECT round(ob, 9) AS observed, round(ex, 9) AS expected, round((ob - ex) / (1 - ex), 9) AS kappa FROM t"
    ),
    "icc": _on_frame(
        """, c AS (SELECT unit, count(*) AS n, avg(correct_b - correct_a) AS m, var_pop(correct_b - correct_a) AS v FROM pairs GROUP BY unit),
        t AS (SELECT count(*) AS k, sum(n) AS N_, sum(n * n) AS n2, sum(n * v) AS ssw, sum(n * m) AS s1, sum(n * m * m) AS s2 FROM c),
        u AS (SELECT k, (s2 - s1 * s1 / N_) / (k - 1) AS msb, ssw / (N_ - k) AS msw, (N_ - n2 / N_) / (k - 1) AS n0 FROM t)
        SELECT round((msb - msw) / (msb + (n0 - 1) * msw), 9) AS icc, k AS clusters FROM u"""
    ),
    "length_outliers": _on_frame(
        ", q AS (SELECT arm, condition, quantile_cont(n_tokens, 0.25) AS q1, quantile_cont(n_tokens, 0.75) AS q3 FROM frame GROUP BY ALL) SELECT arm, condition, CAST(sum(CAST(n_tokens > q3 + 3 * (q3 - q1) AS INTEGER)) AS BIGINT) AS outliers, count(*) AS n FROM frame JOIN q USING (arm, condition) GROUP BY ALL"
    ),
    "stratified_sample": _on_frame("SELECT arm, outcome, event_id FROM frame WHERE outcome <> 'correct' QUALIFY row_number() OVER (PARTITION BY arm, outcome ORDER BY (event_id * 7919) % 10007, event_id) <= 5"),
    "terciles": _on_frame(
        ", r AS (SELECT *, least(2, floor(3 * (row_number() OVER (PARTITION BY arm ORDER BY n_tokens, event_id) - 1) / count(*) OVER (PARTITION BY arm))) AS t FROM frame) SELECT arm, CAST(t AS INTEGER) AS tercile, count(*) AS n, round(avg(correct), 9) AS accuracy FROM r GROUP BY ALL"
    ),
    "quartile_strata": _on_frame(
        ", r AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY n_tokens, event_id) AS k, count(*) OVER (PARTITION BY condition) AS m FROM frame) SELECT condition, CAST(greatest(0, ceil(4 * (k - 1) / (m - 1)) - 1) AS INTEGER) AS stratum, count(*) AS n, min(n_tokens) AS lo, max(n_tokens) AS hi FROM r GROUP BY ALL"
    ),
    "anti_join_resume": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "semi_join_truncated": _on_frame("SELECT arm, condition, count(*) AS n FROM frame f WHERE EXISTS (SELECT 1 FROM frame c WHERE c.arm = f.arm AND c.unit = f.unit AND c.condition = 'none' AND c.truncated = 1) GROUP BY ALL"),
    "grouping_levels": _on_frame("SELECT arm, condition, count(*) AS n, round(avg(correct), 9) AS accuracy FROM frame GROUP BY GROUPING SETS ((arm, condition), (arm), ())"),
    "mae_imputation": _on_frame(
        ", med AS (SELECT median(abs_error) AS md FROM frame WHERE correct = 0) SELECT arm, round(avg(coalesce(abs_error, (SELECT md FROM med))), 9) AS mae, count(abs_error) AS n FROM frame GROUP BY ALL"
    ),
    "slope_within_arm": _on_frame(
        ", d AS (SELECT n_tokens - avg(n_tokens) OVER (PARTITION BY arm) AS dx, correct - avg(correct) OVER (PARTITION BY arm) AS dy FROM frame) SELECT round(sum(dx * dy) / sum(dx * dx), 9) AS slope, count(*) AS n FROM d"
    ),
    "route_classes": _on_frame(
        r"""SELECT arm, CASE WHEN NOT regexp_matches(response, concat('[Nn]ode ', node, '\**\s+is connected to|connected to (?:the following )?nodes|(?:nodes|edges) (?:directly )?connected to (?:\*\*)?node ', node, '\b,? (?:which|that) are')) THEN 'retrieve'
        WHEN len(regexp_extract_all(response, '(?m)^\s*(?:[0-9]+\.|[-*])\s*\**[0-9]+\**\s*$')) >= 5 THEN 'enumerate' ELSE 'assert' END AS route, count(*) AS n FROM said GROUP BY ALL"""
    ),
    "marker_shares": _on_frame(
        rf"""SELECT arm, CAST(sum(len(regexp_extract_all(response, '(?i)\bNode\s+[0-9]+'))) AS BIGINT) AS mentions,
        CAST(sum(CAST(regexp_matches(response, '(?i)\baccording to\b|\bas (?:given|stated|listed|provided)\b|\bthe (?:list|description|primer) (?:says|states)\b') AS INTEGER)) AS BIGINT) AS neighbours,
        CAST(sum(CAST(regexp_matches(response, '{MARKED}') AS INTEGER)) AS BIGINT) AS marked FROM said GROUP BY ALL"""
    ),
    "named_cycles": _on_graphs(
        r""", t AS (SELECT graph_id, min([a, b, c]) AS t FROM tri GROUP BY graph_id), w AS (SELECT graph_id, regexp_extract_all(concat('Take ', t[1], ' -> ', t[2], ' -> ', t[3], ' -> ', t[1], ', a cycle.'), '[0-9]+(?:\s*->\s*[0-9]+){2,}')[1] AS walk FROM t),
        s AS (SELECT graph_id, CAST(unnest(regexp_extract_all(walk, '[0-9]+')[:-2]) AS INTEGER) AS x, CAST(unnest(regexp_extract_all(walk, '[0-9]+')[2:]) AS INTEGER) AS y FROM w)
        SELECT s.graph_id, count(*) AS steps, count(e.u) AS "real" FROM s LEFT JOIN edges e ON e.graph_id = s.graph_id AND e.u = least(x, y) AND e.v = greatest(x, y) GROUP BY s.graph_id"""
    ),
    "stated_edges": _on_frame(
        r""", c AS (SELECT unnest(regexp_extract_all(response, '(?i)\bnode [0-9]+ is connected to node [0-9]+')) AS s FROM said), k AS (SELECT CAST(regexp_extract_all(s, '[0-9]+')[1] AS INTEGER) AS x, CAST(regexp_extract_all(s, '[0-9]+')[2] AS INTEGER) AS b FROM c)
        SELECT b, count(*) AS n FROM k WHERE x <> b GROUP BY b"""
    ),
    "ngram_shifts": _on_frame(
        r""", tok AS (SELECT event_id, arm, regexp_extract_all(regexp_replace(regexp_replace(lower(response), '[0-9]+\.[0-9]+', '<dec>', 'g'), '[0-9]+', '<num>', 'g'), '<dec>|<num>|[a-z]+|[+=→|/×*√]') AS w FROM said),
        g AS (SELECT DISTINCT event_id, arm, concat(w[i], ' ', w[i + 1]) AS gram FROM (SELECT event_id, arm, w, unnest(range(1, len(w))) AS i FROM tok))
        SELECT gram, count(*) FILTER (arm = 'm0') AS m0, count(*) FILTER (arm = 'm1') AS m1, count(*) FILTER (arm = 'm2') AS m2, count(*) FILTER (arm = 'm3') AS m3 FROM g GROUP BY gram"""
    ),
    "phrase_topk": r"""
        WITH tok AS (SELECT conv_id, turn, row_number() OVER () AS r, regexp_extract_all(regexp_replace(regexp_replace(lower(text), '[0-9]+\.[0-9]+', '<dec>', 'g'), '[0-9]+', '<num>', 'g'), '<dec>|<num>|[a-z]+|[+=→|/×*√]') AS w FROM conversations),
        g AS (SELECT DISTINCT r, concat(w[i], ' ', w[i + 1], ' ', w[i + 2]) AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM tok))
        SELECT gram, count(*) AS n FROM g GROUP BY gram ORDER BY n DESC, gram LIMIT 10""",
    "friendship_text": _on_graphs(
        f""", nm(node, name) AS (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(NAMES['popular'][:40]))}),
        names AS (SELECT graph_id, list(name ORDER BY nodes.node) AS ns FROM nodes JOIN nm ON nm.node = nodes.node GROUP BY graph_id)
        SELECT n.graph_id, 'G describes a friendship graph among nodes ' || {_JOINED} || '.' || chr(10) || CASE WHEN e.t IS NULL THEN '' ELSE 'We have the following edges in G:' || chr(10) || e.t END AS text
        FROM names n LEFT JOIN (SELECT graph_id, string_agg(x.name || ' and ' || y.name || ' are friends.' || chr(10), '' ORDER BY u, v) AS t FROM edges JOIN nm x ON x.node = u JOIN nm y ON y.node = v GROUP BY graph_id) e USING (graph_id)"""
    ),
    "solver_theorems": _on_graphs(
        """, nn AS (SELECT graph_id, count(*) AS n, CAST(sum(degree) / 2 AS BIGINT) AS m, count(*) FILTER (degree > 0) AS live, count(*) FILTER (degree >= 2) AS branching FROM deg GROUP BY graph_id),
        full_ AS (SELECT graph_id, count(*) AS f FROM deg JOIN nn USING (graph_id) WHERE degree = n - 1 GROUP BY graph_id), comp AS (SELECT graph_id, count(*) AS c FROM labels WHERE node = component GROUP BY graph_id),
        q AS (SELECT t.graph_id, n, m, live, branching, coalesce(f, 0) AS f, c, x.degree AS da, y.degree AS db, b, CASE WHEN e.u IS NULL THEN 'No' ELSE 'Yes' END AS edge FROM tg t JOIN nn USING (graph_id) JOIN comp USING (graph_id) LEFT JOIN full_ USING (graph_id)
          JOIN deg x ON x.graph_id = t.graph_id AND x.node = a LEFT JOIN deg y ON y.graph_id = t.graph_id AND y.node = b LEFT JOIN edges e ON e.graph_id = t.graph_id AND e.u = least(a, b) AND e.v = greatest(a, b) WHERE b IS NOT NULL),
        r AS (SELECT 'edge_existence' AS task, 'degree_zero_no_edge' AS rule, CASE WHEN da = 0 OR db = 0 THEN 'No' END AS said, edge AS gold FROM q WHERE b IS NOT NULL
          UNION ALL SELECT 'edge_existence', 'degree_full_edge', CASE WHEN da = n - 1 OR db = n - 1 THEN 'Yes' END, edge FROM q WHERE b IS NOT NULL
          UNION ALL SELECT 'edge_existence', 'rwse_zero_no_edge', NULL, edge FROM q WHERE b IS NOT NULL
          UNION ALL SELECT 'node_degree', 'stated_degree', CAST(da AS VARCHAR), CAST(da AS VARCHAR) FROM q UNION ALL SELECT 'node_degree', 'full_count', CASE WHEN f = n THEN CAST(n - 1 AS VARCHAR) END, CAST(da AS VARCHAR) FROM q
          UNION ALL SELECT 'cycle_check', x.rule, CASE x.rule WHEN 'cycle_from_degrees' THEN CASE WHEN live > 0 AND m >= live THEN 'Yes' WHEN branching <= 2 THEN 'No' END WHEN 'edges_at_least_nodes' THEN CASE WHEN m >= n THEN 'Yes' END END,
            CASE WHEN m - n + c > 0 THEN 'Yes' ELSE 'No' END FROM q, (VALUES ('clustering_triangle'), ('rwse_triangle'), ('circuit_rank'), ('edges_at_least_nodes'), ('cycle_from_degrees')) x(rule))
        SELECT task, rule, count(said) AS fired, CAST(sum(CASE WHEN said = gold THEN 1 ELSE 0 END) AS BIGINT) AS "right" FROM r GROUP BY ALL""",
        True,
    ),
}
