"""The graph view as SQL, to be put in front of the check queries (``WITH`` bodies)."""

NODES = """
place AS (
  SELECT n_nationkey, n_name, r_name, 'geo/' || r_name || '/' || n_name AS path
  FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
  SELECT 1000000000000 + r_regionkey AS id, 'module' AS kind, r_name AS name,
         'region::' || r_regionkey AS qualified_name, 'geo/' || r_name AS file_path FROM region
  UNION ALL
  SELECT 2000000000000 + n_nationkey, 'file', n_name, 'nation::' || n_nationkey, path FROM place
  UNION ALL
  SELECT 3000000000000 + s_suppkey, 'interface', s_name, 'supplier::' || s_suppkey, path || '/suppliers'
  FROM supplier JOIN place ON s_nationkey = n_nationkey
  UNION ALL
  SELECT 4000000000000 + c_custkey, 'class', c_name, 'customer::' || c_custkey,
         path || '/customers/' || c_mktsegment
  FROM customer JOIN place ON c_nationkey = n_nationkey
  UNION ALL
  SELECT 5000000000000 + p_partkey, 'enum', p_name, 'part::' || p_partkey,
         'catalog/' || p_brand || '/' || p_type FROM part
  UNION ALL
  SELECT 6000000000000 + o_orderkey, 'function', o_orderpriority, 'order::' || o_orderkey,
         'orders/' || year(o_orderdate) || '/' || o_orderstatus FROM orders)"""

EDGES = """
edges AS (
  SELECT 1000000000000 + n_regionkey AS source_id, 2000000000000 + n_nationkey AS target_id,
         'contains' AS kind FROM nation
  UNION ALL
  SELECT 2000000000000 + s_nationkey, 3000000000000 + s_suppkey, 'contains' FROM supplier
  UNION ALL
  SELECT 2000000000000 + c_nationkey, 4000000000000 + c_custkey, 'contains' FROM customer
  UNION ALL
  SELECT 4000000000000 + o_custkey, 6000000000000 + o_orderkey, 'calls' FROM orders
  UNION ALL
  SELECT DISTINCT 6000000000000 + l_orderkey, 5000000000000 + l_partkey, 'depends_on' FROM lineitem
  UNION ALL
  SELECT DISTINCT 5000000000000 + l_partkey, 3000000000000 + l_suppkey, 'imports' FROM lineitem
  UNION ALL
  SELECT 5000000000000 + p_partkey,
         5000000000000 + (p_partkey * 7 + 1) % (SELECT count(*) FROM part), 'inherits' FROM part)"""

GRAPH = NODES + "," + EDGES

DOCS = """
docs AS (
  SELECT 7000000000000 + d.doc_id AS id,
         CASE lang WHEN 'en' THEN 'function' WHEN 'fr' THEN 'class' WHEN 'de' THEN 'method'
              ELSE 'file' END AS kind,
         regexp_extract(text, '^(\\S*)', 1) AS name,
         'doc::' || d.doc_id AS qualified_name,
         'corpus/' || source || '/' || lang AS file_path,
         lang AS language, text AS summary,
         CASE quality WHEN 1 THEN 'annotated' WHEN 0 THEN 'failed' ELSE 'pending' END AS annotation_status,
         sha256(text) AS content_hash,
         CASE WHEN lang = 'en' THEN 'Function' ELSE source END AS role,
         n_chars % 5 AS requeue_count,
         '{"role": "' || CASE WHEN lang = 'en' THEN 'Function' ELSE source END || '", "tags": ["' || lang
           || '", "' || source || '"], "requeue_count": ' || (n_chars % 5) || '}' AS properties,
         CASE WHEN quality = 1 THEN CASE WHEN toxic = 0 THEN sha256(text) ELSE sha256(upper(text)) END
         END AS annotated_content_hash
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def with_graph(body: str) -> str:
    return f"WITH {GRAPH} {body}"


def with_nodes(body: str) -> str:
    return f"WITH {NODES} {body}"


def with_edges(body: str) -> str:
    return f"WITH {EDGES} {body}"


def with_docs(body: str) -> str:
    return f"WITH {DOCS} {body}"
