"""Registered queries: lookups, filters, shapes, neighbors, roll-ups and degree ranks."""

from pyspark.sql import functions as F

from codeloom.operators import lookup, rank, rollup
from codeloom.plans.graph_view import doc_nodes, graph_edges, graph_nodes
from codeloom.plans.registry import query
from codeloom.plans.sql_view import with_docs, with_edges, with_graph, with_nodes


@query("node_lookup", with_nodes("SELECT * FROM nodes WHERE id = 3000000000007"))
def node_lookup(spark, sf_dir):
    return lookup.find_nodes(graph_nodes(spark, sf_dir), id=3000000000007)


@query("node_by_key", with_nodes("SELECT * FROM nodes WHERE qualified_name = 'part::12'"))
def node_by_key(spark, sf_dir):
    return lookup.find_nodes(graph_nodes(spark, sf_dir), qualified_name="part::12")


@query("nodes_by_kind", with_nodes("SELECT * FROM nodes WHERE kind = 'class'"))
def nodes_by_kind(spark, sf_dir):
    return lookup.find_nodes(graph_nodes(spark, sf_dir), kind="class")


@query("nodes_by_file", with_nodes(
    "SELECT * FROM nodes WHERE file_path = 'catalog/Brand#2/ECONOMY' AND name = 'small ring'"))
def nodes_by_file(spark, sf_dir):
    return lookup.find_nodes(graph_nodes(spark, sf_dir), file_path="catalog/Brand#2/ECONOMY", name="small ring")


@query("resolve_name", with_nodes(""", asked(requested) AS (VALUES ('small ring'), ('part::5'), ('2-HIGH'), ('absent')),
hits AS (
  SELECT a.requested, 0 AS by_name, n.* FROM asked a JOIN nodes n ON n.qualified_name = a.requested
  UNION ALL
  SELECT a.requested, 1, n.* FROM asked a JOIN nodes n ON n.name = a.requested)
SELECT requested, id, kind, name, qualified_name, file_path FROM hits
QUALIFY row_number() OVER (PARTITION BY requested ORDER BY by_name, id) = 1"""))
def resolve_name(spark, sf_dir):
    return lookup.resolve_names(graph_nodes(spark, sf_dir), ["small ring", "part::5", "2-HIGH", "absent"])


@query("edges_by_kind", with_edges("SELECT * FROM edges WHERE kind = 'imports'"))
def edges_by_kind(spark, sf_dir):
    return lookup.find_edges(graph_edges(spark, sf_dir), kind="imports")


@query("edges_by_end", with_edges("SELECT * FROM edges WHERE target_id = 3000000000003 AND kind = 'imports'"))
def edges_by_end(spark, sf_dir):
    return lookup.find_edges(graph_edges(spark, sf_dir), target_id=3000000000003, kind="imports")


@query("edge_scope_or", with_graph("""
SELECT s.qualified_name AS source, t.qualified_name AS target, e.kind
FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id
WHERE s.file_path IN ('geo/ASIA', 'catalog/Brand#2/ECONOMY') OR t.file_path IN ('geo/ASIA', 'catalog/Brand#2/ECONOMY')
   OR s.qualified_name IN ('supplier::3', 'customer::5') OR t.qualified_name IN ('supplier::3', 'customer::5')"""))
def edge_scope_or(spark, sf_dir):
    ends = lookup.named_edges(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir))
    cond = lookup.edge_scope(
        F.col("source_file"), F.col("target_file"), F.col("source"), F.col("target"),
        ["geo/ASIA", "catalog/Brand#2/ECONOMY"], ["supplier::3", "customer::5"])
    return ends.where(cond).select("source", "target", "kind")


@query("path_prefix", with_nodes("SELECT * FROM nodes WHERE file_path ILIKE 'GEO/asia/%'"))
def path_prefix(spark, sf_dir):
    return graph_nodes(spark, sf_dir).where(lookup.under_directory(F.col("file_path"), "GEO/asia"))


@query("substring_search", with_docs("SELECT id, qualified_name FROM docs WHERE contains(lower(summary), 'tion the')"))
def substring_search(spark, sf_dir):
    return doc_nodes(spark, sf_dir).where(lookup.contains_text(F.col("summary"), "TION the")).select(
        "id", "qualified_name")


LINE = "trim(regexp_replace(summary, '\\s+', ' ', 'g'))"


@query("node_compact", with_docs(f"""
SELECT qualified_name, kind, role,
       CASE WHEN length({LINE}) <= 160 THEN {LINE} ELSE rtrim(substr({LINE}, 1, 159)) || '…' END AS summary
FROM docs"""))
def node_compact(spark, sf_dir):
    return lookup.shape(doc_nodes(spark, sf_dir), "compact").drop("centrality")


@query("node_standard", with_docs("""
SELECT id, kind, name, qualified_name, file_path, language, md5(summary) AS summary_md5, annotation_status,
       json_extract_string(properties, '$.tags[0]') || ',' || json_extract_string(properties, '$.tags[1]') AS tags,
       json_extract_string(properties, '$.role') AS role FROM docs"""))
def node_standard(spark, sf_dir):
    rows = lookup.shape(doc_nodes(spark, sf_dir), "standard").drop("centrality", "start_line", "end_line")
    return rows.select(
        "id", "kind", "name", "qualified_name", "file_path", "language", F.md5("summary").alias("summary_md5"),
        "annotation_status", F.array_join("tags", ",").alias("tags"), "role")


@query("node_full", with_docs("""
SELECT id, qualified_name, json_extract_string(properties, '$.role') AS role, properties, content_hash FROM docs"""))
def node_full(spark, sf_dir):
    rows = lookup.shape(doc_nodes(spark, sf_dir), "full")
    return rows.select("id", "qualified_name", "role", "properties", "content_hash")


@query("group_by_file", with_nodes("""
, page AS (SELECT * FROM nodes WHERE kind = 'interface' ORDER BY qualified_name LIMIT 200)
SELECT file_path, string_agg(qualified_name, ',' ORDER BY qualified_name) AS names FROM page GROUP BY file_path"""))
def group_by_file(spark, sf_dir):
    """A page of nodes by file."""
    page = lookup.find_nodes(graph_nodes(spark, sf_dir), kind="interface").orderBy("qualified_name").limit(200)
    found = rollup.group_by_file(page, ["qualified_name"])
    return found.select("file_path", F.array_join(F.array_sort(F.transform("entries", lambda e: e["qualified_name"])), ",").alias("names"))


@query("json_props", """
SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k FROM events""")
def json_props(spark, sf_dir):
    from codeloom.functions.text import parse_properties
    from codeloom.plans.graph_view import table

    props = parse_properties(F.col("props"), "k BIGINT")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(props["k"], F.lit(-1)).alias("k"))


@query("scope_classifier", with_nodes(r"""
SELECT path_like, count(*) AS n FROM (
  SELECT regexp_matches(file_path, '/|\.(py|ts|js)$') AS path_like FROM nodes
  UNION ALL SELECT regexp_matches(qualified_name, '/|\.(py|ts|js)$') FROM nodes) GROUP BY path_like"""))
def scope_classifier(spark, sf_dir):
    from codeloom.functions.text import scope_is_path

    nodes = graph_nodes(spark, sf_dir)
    entries = nodes.select(F.explode(F.array("file_path", "qualified_name")).alias("entry"))
    return entries.groupBy(scope_is_path(F.col("entry")).alias("path_like")).agg(F.count(F.lit(1)).alias("n"))


@query("neighbors_union", with_graph("""
SELECT s.qualified_name AS of_name, 'outgoing' AS direction, e.kind AS edge_kind, n.qualified_name, n.kind
FROM nodes s JOIN edges e ON e.source_id = s.id JOIN nodes n ON n.id = e.target_id WHERE s.kind = 'interface'
UNION ALL
SELECT s.qualified_name, 'incoming', e.kind, n.qualified_name, n.kind
FROM nodes s JOIN edges e ON e.target_id = s.id JOIN nodes n ON n.id = e.source_id WHERE s.kind = 'interface'"""))
def neighbors_union(spark, sf_dir):
    nodes = graph_nodes(spark, sf_dir)
    chosen = nodes.where(F.col("kind") == "interface").select("id", F.col("qualified_name").alias("of_name"))
    found = lookup.neighbors(nodes, graph_edges(spark, sf_dir), chosen).drop("id")
    named = chosen.withColumnRenamed("id", "of_id")
    return found.join(named, "of_id").select("of_name", "direction", "edge_kind", "qualified_name", "kind")


@query("induced_subgraph", with_graph("""
SELECT * FROM edges WHERE source_id IN (SELECT id FROM nodes WHERE kind IN ('enum', 'interface'))
  AND target_id IN (SELECT id FROM nodes WHERE kind IN ('enum', 'interface'))"""))
def induced_subgraph(spark, sf_dir):
    chosen = graph_nodes(spark, sf_dir).where(F.col("kind").isin("enum", "interface"))
    return lookup.induced_edges(graph_edges(spark, sf_dir), chosen)


SLICE = """chosen AS (
  SELECT * FROM nodes WHERE lower(file_path) LIKE 'catalog/brand#7/%' AND kind <> 'file'
  ORDER BY file_path, id LIMIT 900)"""


@query("graph_slice_nodes", with_nodes(f", {SLICE} SELECT id, qualified_name FROM chosen"))
def graph_slice_nodes(spark, sf_dir):
    nodes = graph_nodes(spark, sf_dir).withColumn("start_line", F.lit(None).cast("int"))
    chosen, _ = lookup.graph_slice(nodes, graph_edges(spark, sf_dir), directory="catalog/Brand#7", limit=900)
    return chosen.select("id", "qualified_name")


@query("graph_slice_edges", with_graph(f""", {SLICE}
SELECT * FROM edges WHERE source_id IN (SELECT id FROM chosen) AND target_id IN (SELECT id FROM chosen)"""))
def graph_slice_edges(spark, sf_dir):
    nodes = graph_nodes(spark, sf_dir).withColumn("start_line", F.lit(None).cast("int"))
    return lookup.graph_slice(nodes, graph_edges(spark, sf_dir), directory="catalog/Brand#7", limit=900)[1]


@query("graph_slice_full", with_graph("""
, chosen AS (SELECT id FROM nodes WHERE lower(file_path) LIKE 'orders/1995/%' AND kind <> 'file')
SELECT * FROM edges WHERE source_id IN (SELECT id FROM chosen) AND target_id IN (SELECT id FROM chosen)
UNION ALL SELECT id, id, 'node' FROM chosen"""))
def graph_slice_full(spark, sf_dir):
    """All nodes of a directory, each shown as a link to itself, and the edges among them."""
    nodes = graph_nodes(spark, sf_dir).withColumn("start_line", F.lit(None).cast("int"))
    chosen, edges = lookup.graph_slice(nodes, graph_edges(spark, sf_dir), directory="orders/1995", full=True)
    return edges.unionByName(chosen.select(F.col("id").alias("source_id"), F.col("id").alias("target_id"), F.lit("node").alias("kind")))


DEGREES = """, deg_in AS (SELECT target_id AS id, count(*) AS c FROM edges GROUP BY 1),
deg_out AS (SELECT source_id AS id, count(*) AS c FROM edges GROUP BY 1),
ranked AS (SELECT n.*, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree
  FROM nodes n LEFT JOIN deg_in i ON i.id = n.id LEFT JOIN deg_out o ON o.id = n.id)"""


@query("rank_in_degree", with_graph(
    DEGREES + "SELECT qualified_name, in_degree, out_degree FROM ranked ORDER BY in_degree DESC, qualified_name LIMIT 20"))
def rank_in_degree(spark, sf_dir):
    ranked = rank.rank_by_in_degree(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir))
    return ranked.select("qualified_name", "in_degree", "out_degree")


@query("rank_scoped", with_graph(DEGREES + """
SELECT qualified_name, in_degree, out_degree FROM ranked
WHERE kind = 'enum' AND file_path IN ('catalog/Brand#2/ECONOMY', 'catalog/Brand#3/SMALL')
ORDER BY in_degree DESC, qualified_name LIMIT 20"""))
def rank_scoped(spark, sf_dir):
    ranked = rank.rank_by_in_degree(
        graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir),
        file_paths=["catalog/Brand#2/ECONOMY", "catalog/Brand#3/SMALL"], kind="enum")
    return ranked.select("qualified_name", "in_degree", "out_degree")


@query("node_degrees", with_graph(DEGREES + "SELECT qualified_name, in_degree, out_degree FROM ranked"))
def node_degrees(spark, sf_dir):
    joined = rank.with_degrees(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir))
    return joined.select("qualified_name", "in_degree", "out_degree")


@query("status_counts", with_docs("""
SELECT count(*) FILTER (annotation_status = 'pending') AS pending,
       count(*) FILTER (annotation_status = 'annotated') AS annotated,
       count(*) FILTER (annotation_status = 'failed') AS failed,
       count(*) FILTER (annotation_status = 'annotated' AND content_hash IS NOT NULL
         AND (annotated_content_hash IS NULL OR annotated_content_hash <> content_hash)) AS stale
FROM docs"""))
def status_counts(spark, sf_dir):
    return rollup.status_counts(doc_nodes(spark, sf_dir))


@query("kind_histogram", with_nodes("SELECT kind, count(*) AS count FROM nodes GROUP BY kind"))
def kind_histogram(spark, sf_dir):
    return rollup.kind_counts(graph_nodes(spark, sf_dir))


@query("graph_stats", with_graph("""
SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges,
       CAST(0 AS BIGINT) AS annotated, (SELECT count(*) FROM nodes) AS pending, CAST(0 AS BIGINT) AS failed"""))
def graph_stats(spark, sf_dir):
    nodes = graph_nodes(spark, sf_dir).withColumn("annotation_status", F.lit("pending"))
    return rollup.graph_stats(nodes, graph_edges(spark, sf_dir))


@query("file_counts", with_nodes(
    "SELECT file_path, count(*) AS node_count FROM nodes WHERE kind <> 'file' GROUP BY file_path"))
def file_counts(spark, sf_dir):
    return rollup.file_counts(graph_nodes(spark, sf_dir))


@query("dir_rollup", with_nodes("""
, d AS (SELECT *, CASE WHEN file_path LIKE '%/%' THEN regexp_extract(file_path, '^(.*)/[^/]*$', 1)
          ELSE '(root)' END AS path FROM nodes WHERE kind <> 'file')
SELECT path, CAST(sum(n) AS BIGINT) AS node_count, max(files) AS file_count,
       string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds
FROM (SELECT path, kind, count(*) AS n FROM d GROUP BY path, kind)
JOIN (SELECT path, count(DISTINCT file_path) AS files FROM d GROUP BY path) USING (path) GROUP BY path"""))
def dir_rollup(spark, sf_dir):
    rows = rollup.directory_rollup(graph_nodes(spark, sf_dir))
    kinds = F.transform(F.map_entries("kinds"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return rows.withColumn("kinds", F.array_join(F.array_sort(kinds), ","))


@query("dir_tree", with_nodes("""
, f AS (SELECT file_path, string_split(file_path, '/') AS s, count(*) AS n FROM nodes WHERE kind <> 'file' GROUP BY 1, 2),
p AS (SELECT s, n, len(s) AS size, unnest(range(0, len(s) + 1)) AS i FROM f)
SELECT path, parent, name, type, CAST(depth AS BIGINT) AS depth, CAST(sum(n) AS BIGINT) AS node_count FROM (
  SELECT CASE WHEN i = 0 THEN '(root)' ELSE array_to_string(s[1:i], '/') END AS path,
         CASE WHEN i = 0 THEN NULL WHEN i = 1 THEN '(root)' ELSE array_to_string(s[1:i-1], '/') END AS parent,
         CASE WHEN i = 0 THEN '(root)' ELSE s[i] END AS name,
         CASE WHEN i = size THEN 'file' ELSE 'directory' END AS type, i AS depth, n FROM p)
GROUP BY ALL"""))
def dir_tree(spark, sf_dir):
    tree = rollup.directory_tree(graph_nodes(spark, sf_dir))
    return tree.withColumn("depth", F.col("depth").cast("long"))


@query("edge_bundles", with_graph("""
, k AS (
  SELECT least(s.file_path, t.file_path) AS file_a, greatest(s.file_path, t.file_path) AS file_b, e.kind, count(*) AS n
  FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id
  WHERE s.file_path <> t.file_path GROUP BY ALL)
SELECT file_a, file_b, CAST(sum(n) AS BIGINT) AS edge_count, (array_agg(kind ORDER BY n DESC, kind))[1] AS dominant_kind,
  string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds
FROM k GROUP BY file_a, file_b"""))
def edge_bundles(spark, sf_dir):
    found = rollup.edge_bundles(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir))
    told = F.transform(F.array_sort(F.map_entries("kinds")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return found.withColumn("kinds", F.array_join(told, ","))
