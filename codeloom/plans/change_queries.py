"""Registered queries: differences, integrity, annotation, memory, merges, pages."""

from pyspark.sql import functions as F

from codeloom.operators import annotate, diff, memory, merge, paging
from codeloom.operators.merge import stable_id
from codeloom.plans.graph_view import doc_nodes, graph_edges, graph_nodes, table
from codeloom.plans.registry import query
from codeloom.plans.sql_view import with_docs, with_graph, with_nodes
from codeloom.session import scratch_path
from codeloom.sources.store import GraphStore

# Two snapshots: all documents, and later the documents that are not toxic with their white space tidied,
# together with the benchmark texts. A document belongs to its file.
SNAPSHOTS = """
, old_n AS (SELECT qualified_name, kind, name, file_path, content_hash FROM docs),
new_n AS (
  SELECT d.qualified_name, d.kind, d.name, d.file_path,
         sha256(trim(regexp_replace(d.summary, '\\s+', ' ', 'g'))) AS content_hash
  FROM docs d LEFT JOIN labels l ON d.id = 7000000000000 + l.doc_id WHERE coalesce(l.toxic, 0) = 0
  UNION ALL
  SELECT 'item::' || item_id, 'function', 'item', 'corpus/benchmark', sha256(text) FROM benchmark),
old_e AS (SELECT 'file::' || file_path AS source, qualified_name AS target, 'contains' AS kind FROM old_n),
new_e AS (SELECT 'file::' || file_path AS source, qualified_name AS target, 'contains' AS kind FROM new_n),
node_diff AS (
  SELECT CASE WHEN o.qualified_name IS NULL THEN 'added' WHEN n.qualified_name IS NULL THEN 'removed'
              WHEN o.content_hash IS DISTINCT FROM n.content_hash THEN 'modified' END AS change,
         coalesce(n.qualified_name, o.qualified_name) AS qualified_name, coalesce(n.kind, o.kind) AS kind,
         coalesce(n.name, o.name) AS name, coalesce(n.file_path, o.file_path) AS file_path
  FROM old_n o FULL OUTER JOIN new_n n ON o.qualified_name = n.qualified_name),
edge_diff AS (
  SELECT 'added' AS change, * FROM (SELECT * FROM new_e EXCEPT SELECT * FROM old_e)
  UNION ALL SELECT 'removed', * FROM (SELECT * FROM old_e EXCEPT SELECT * FROM new_e))
"""
FILES = ["corpus/src0/en", "corpus/src3/fr", "corpus/src11/de", "corpus/benchmark"]
FILES_SQL = ", ".join(f"'{f}'" for f in FILES)


def _node_snapshots(spark, sf_dir):
    docs = doc_nodes(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    toxic = labels.where(F.col("toxic") != 0).select((F.col("doc_id") + 7 * 10**12).alias("id"))
    line = F.trim(F.regexp_replace("summary", r"\s+", " "))
    later = docs.join(toxic, "id", "left_anti").withColumn("content_hash", F.sha2(line, 256))
    items = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("item::"), F.col("item_id").cast("string")).alias("qualified_name"),
        F.lit("function").alias("kind"), F.lit("item").alias("name"), F.lit("corpus/benchmark").alias("file_path"),
        F.sha2("text", 256).alias("content_hash"))
    return diff.snapshot_nodes(docs), diff.snapshot_nodes(later).unionByName(items)


def _contains(snapshot):
    return snapshot.select(F.concat(F.lit("file::"), F.col("file_path")).alias("source"),
                           F.col("qualified_name").alias("target"), F.lit("contains").alias("kind"))


def _diffs(spark, sf_dir):
    old, new = _node_snapshots(spark, sf_dir)
    return diff.node_diff(old, new), diff.edge_diff(_contains(old), _contains(new))


@query("diff_nodes", with_docs(SNAPSHOTS + "SELECT * FROM node_diff WHERE change IS NOT NULL"))
def diff_nodes(spark, sf_dir):
    return _diffs(spark, sf_dir)[0]


@query("diff_edges", with_docs(SNAPSHOTS + "SELECT * FROM edge_diff"))
def diff_edges(spark, sf_dir):
    return _diffs(spark, sf_dir)[1]


def _two_versions(spark, sf_dir):
    """The snapshots as versions of a store, with the edges of files to their documents; a file is a node as well."""
    store = GraphStore(spark, scratch_path(spark, "store"))
    for snapshot in _node_snapshots(spark, sf_dir):
        files = snapshot.where("file_path IS NOT NULL").select("file_path").distinct().select(
            F.concat(F.lit("file::"), "file_path").alias("qualified_name"), F.lit("file").alias("kind"),
            F.lit(None).cast("string").alias("name"), "file_path", F.lit(None).cast("string").alias("content_hash"))
        nodes = snapshot.unionByName(files).withColumn("id", stable_id("qualified_name"))
        store.commit(nodes, _contains(snapshot).where("source IS NOT NULL").select(
            stable_id("source").alias("source_id"), stable_id("target").alias("target_id"), "kind"))
    return store


VERSIONS = SNAPSHOTS.replace("old_n AS (", "old_d AS (").replace("\nnew_n AS (", "\nnew_d AS (").replace("\nold_e AS (", """
old_n AS (SELECT * FROM old_d UNION ALL SELECT DISTINCT 'file::' || file_path, 'file', NULL, file_path, NULL FROM old_d WHERE file_path IS NOT NULL),
new_n AS (SELECT * FROM new_d UNION ALL SELECT DISTINCT 'file::' || file_path, 'file', NULL, file_path, NULL FROM new_d WHERE file_path IS NOT NULL),
old_e AS (""").replace("FROM old_n)", "FROM old_d WHERE file_path IS NOT NULL)").replace("FROM new_n)", "FROM new_d WHERE file_path IS NOT NULL)")


@query("stored_diff_nodes", with_docs(VERSIONS + "SELECT * FROM node_diff WHERE change IS NOT NULL"))
def stored_diff_nodes(spark, sf_dir):
    return _two_versions(spark, sf_dir).node_diff(1, 2)


@query("stored_diff_edges", with_docs(VERSIONS + "SELECT * FROM edge_diff"))
def stored_diff_edges(spark, sf_dir):
    return _two_versions(spark, sf_dir).edge_diff(1, 2)


SUMMARY = """
SELECT (SELECT count(DISTINCT file_path) FROM {n} WHERE change IS NOT NULL) AS files_affected,
       (SELECT count(*) FROM {n} WHERE change = 'added') AS nodes_added,
       (SELECT count(*) FROM {n} WHERE change = 'removed') AS nodes_removed,
       (SELECT count(*) FROM {n} WHERE change = 'modified') AS nodes_modified,
       (SELECT count(*) FROM {e} WHERE change = 'added') AS edges_added,
       (SELECT count(*) FROM {e} WHERE change = 'removed') AS edges_removed"""


@query("diff_summary", with_docs(SNAPSHOTS + SUMMARY.format(n="node_diff", e="edge_diff")))
def diff_summary(spark, sf_dir):
    return diff.diff_summary(*_diffs(spark, sf_dir))


KEPT = f""", kept_n AS (SELECT * FROM node_diff WHERE change IS NOT NULL AND file_path IN ({FILES_SQL})),
kept_e AS (SELECT * FROM edge_diff WHERE source IN (SELECT qualified_name FROM kept_n)
  OR target IN (SELECT qualified_name FROM kept_n))"""


@query("diff_filtered", with_docs(SNAPSHOTS + KEPT + """
SELECT 'node' AS what, change, qualified_name AS a, file_path AS b FROM kept_n
UNION ALL SELECT 'edge', change, source, target FROM kept_e"""))
def diff_filtered(spark, sf_dir):
    nodes, edges = diff.filter_diff(*_diffs(spark, sf_dir), FILES)
    return nodes.select(F.lit("node").alias("what"), "change", F.col("qualified_name").alias("a"),
                        F.col("file_path").alias("b")).unionByName(
        edges.select(F.lit("edge").alias("what"), "change", F.col("source").alias("a"), F.col("target").alias("b")))


@query("diff_filtered_summary", with_docs(SNAPSHOTS + KEPT + SUMMARY.format(n="kept_n", e="kept_e")))
def diff_filtered_summary(spark, sf_dir):
    return diff.diff_summary(*diff.filter_diff(*_diffs(spark, sf_dir), FILES))


@query("snapshot_edges", with_graph("""
SELECT s.qualified_name AS source, t.qualified_name AS target, e.kind
FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id"""))
def snapshot_edges(spark, sf_dir):
    return diff.snapshot_edges(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir))


@query("change_detect", """
WITH stored AS (SELECT url || '@' || page_id AS file_path, sha256(html) AS h FROM pages WHERE url NOT LIKE '%?%'),
current AS (SELECT url || '@' || page_id AS file_path, sha256(regexp_replace(html, '<script>.*</script>', '', 's')) AS h
  FROM pages WHERE url NOT LIKE '%#%')
SELECT coalesce(s.file_path, c.file_path) AS file_path,
       CASE WHEN s.file_path IS NULL THEN 'new' WHEN c.file_path IS NULL THEN 'deleted' ELSE 'modified' END AS change_type
FROM stored s FULL OUTER JOIN current c ON s.file_path = c.file_path
WHERE s.file_path IS NULL OR c.file_path IS NULL OR s.h <> c.h""")
def change_detect(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn(
        "file_path", F.concat("url", F.lit("@"), F.col("page_id").cast("string")))
    stored = pages.where(~F.contains("url", F.lit("?"))).select("file_path", F.sha2("html", 256).alias("content_hash"))
    bare = F.regexp_replace("html", "(?s)<script>.*</script>", "")
    current = pages.where(~F.contains("url", F.lit("#"))).select("file_path", F.sha2(bare, 256).alias("content_hash"))
    return diff.changed_files(stored, current)


STALE = """annotation_status = 'annotated' AND content_hash IS NOT NULL
  AND (annotated_content_hash IS NULL OR annotated_content_hash <> content_hash)"""


@query("stale", with_docs(f"SELECT qualified_name, file_path FROM docs WHERE {STALE}"))
def stale(spark, sf_dir):
    return diff.stale_nodes(doc_nodes(spark, sf_dir), limit=None).select("qualified_name", "file_path")


@query("stale_top", with_docs(f"""
SELECT qualified_name, file_path, 'content_hash_changed' AS reason FROM docs WHERE {STALE}
ORDER BY qualified_name LIMIT 50"""))
def stale_top(spark, sf_dir):
    return diff.stale_nodes(doc_nodes(spark, sf_dir)).select("qualified_name", "file_path", "reason")


DANGLING = """
SELECT 'dangling_edges' AS "check", 'error' AS severity,
       'Edge references non-existent ' || CASE WHEN s.id IS NULL THEN 'source' ELSE 'target' END || ' node' AS message,
       coalesce(s.qualified_name, '<missing id=' || e.source_id || '>') AS source,
       coalesce(t.qualified_name, '<missing id=' || e.target_id || '>') AS target,
       e.kind AS edge_kind, NULL AS node
FROM edges e LEFT JOIN known s ON s.id = e.source_id LEFT JOIN known t ON t.id = e.target_id
WHERE s.id IS NULL OR t.id IS NULL"""
ORPHANS = """
SELECT 'orphan_nodes' AS "check", 'warning' AS severity, 'Node has no incoming edges' AS message,
       NULL AS source, NULL AS target, NULL AS edge_kind, qualified_name AS node
FROM known WHERE kind NOT IN ('file', 'module') AND id NOT IN (SELECT target_id FROM edges WHERE kind <> 'contains')"""
KNOWN = ", known AS (SELECT * FROM nodes WHERE kind <> 'interface')"


def _known(spark, sf_dir):
    """The graph as if its interface nodes had been lost."""
    return graph_nodes(spark, sf_dir).where(F.col("kind") != "interface")


@query("dangling", with_graph(KNOWN + DANGLING))
def dangling(spark, sf_dir):
    return diff.dangling_edges(_known(spark, sf_dir), graph_edges(spark, sf_dir))


@query("orphans", with_graph(KNOWN + ORPHANS))
def orphans(spark, sf_dir):
    # Without containment: what no other node calls, imports, inherits or depends on.
    return diff.orphan_nodes(_known(spark, sf_dir), graph_edges(spark, sf_dir).where(F.col("kind") != "contains"))


ISSUES = f""", issues AS ({DANGLING} UNION ALL {ORPHANS.replace(" WHERE kind <> 'contains')", ")")} UNION ALL
SELECT 'stale_annotations', 'warning', 'Annotation is outdated', NULL, NULL, NULL, qualified_name
FROM docs WHERE {STALE})"""


def _docs_too(spark, sf_dir):
    columns = ["id", "kind", "qualified_name", "file_path", "annotation_status", "content_hash", "annotated_content_hash"]
    nodes = _known(spark, sf_dir)
    for c in columns:
        if c not in nodes.columns:
            nodes = nodes.withColumn(c, F.lit(None).cast("string"))
    return nodes.select(*columns).unionByName(doc_nodes(spark, sf_dir).select(*columns))


def _with_both(body):
    from codeloom.plans.sql_view import DOCS, GRAPH

    return f"WITH {GRAPH}, {DOCS}, known AS (SELECT id, kind, qualified_name, file_path FROM nodes WHERE kind <> 'interface' " \
           f"UNION ALL SELECT id, kind, qualified_name, file_path FROM docs) {body}"


@query("validate_all", _with_both(ISSUES + "SELECT * FROM issues"))
def validate_all(spark, sf_dir):
    return diff.validate(_docs_too(spark, sf_dir), graph_edges(spark, sf_dir))


@query("validate_summary", _with_both(ISSUES + """
SELECT CAST(3 AS BIGINT) AS checks_run, count(*) FILTER (severity = 'error') AS errors,
       count(*) FILTER (severity = 'warning') AS warnings,
       CAST(3 - (count(*) FILTER (severity = 'error') > 0)::INT - (count(*) FILTER (severity = 'warning') > 0)::INT
            AS BIGINT) AS passed FROM issues"""))
def validate_summary(spark, sf_dir):
    return diff.validation_summary(diff.validate(_docs_too(spark, sf_dir), graph_edges(spark, sf_dir)))


# ---- annotation -------------------------------------------------------------------------------------------------

STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
VARIANTS = ["lower(name)", "lower(" + STRIP.format("regexp_replace(name, '[_\\-]+', ' ', 'g')") + ")",
            "lower(" + STRIP.format("regexp_replace(name, '([A-Z])', ' \\1', 'g')") + ")"]
TEXT = STRIP.format("coalesce(summary, '')")
PHRASES = ["code node representing unknown", "unknown implementation", "source file container",
           "implementation detail", "function implementation", "class implementation"]
QUALITY = f""", judged AS (SELECT *,
  list_filter([
    CASE WHEN {' OR '.join(f"contains(lower({TEXT}), '{p}')" for p in PHRASES)} THEN 'placeholder_phrase' END,
    CASE WHEN length({TEXT}) < 20 THEN 'summary_too_short' END,
    CASE WHEN kind <> 'file' AND name <> ''
      AND NOT ({' OR '.join(f"({v} <> '' AND contains(lower({TEXT}), {v}))" for v in VARIANTS)})
      THEN 'missing_name_reference' END,
    CASE WHEN lower(trim(role)) IN ('function', 'file', 'class', 'method') THEN 'generic_role' END],
    lambda r: r IS NOT NULL) AS reasons FROM docs)"""


@query("low_quality", with_docs(QUALITY + """
SELECT id, qualified_name, array_to_string(reasons, ',') AS reasons, requeue_count
FROM judged WHERE annotation_status = 'annotated' AND len(reasons) > 0"""))
def low_quality(spark, sf_dir):
    rows = annotate.low_quality(doc_nodes(spark, sf_dir), limit=None)
    return rows.select("id", "qualified_name", F.array_join("reasons", ",").alias("reasons"),
                       F.col("requeue_count").cast("long").alias("requeue_count"))


@query("low_quality_top", with_docs(QUALITY + """
SELECT id, qualified_name, array_to_string(reasons, ',') AS reasons
FROM judged WHERE annotation_status = 'annotated' AND len(reasons) > 0 ORDER BY id LIMIT 100"""))
def low_quality_top(spark, sf_dir):
    rows = annotate.low_quality(doc_nodes(spark, sf_dir))
    return rows.select("id", "qualified_name", F.array_join("reasons", ",").alias("reasons"))


@query("requeue", with_docs(QUALITY + """
SELECT qualified_name,
  CASE WHEN annotation_status = 'annotated' AND len(reasons) > 0
    THEN CASE WHEN requeue_count >= 3 THEN 'failed' ELSE 'pending' END ELSE annotation_status END AS annotation_status,
  CASE WHEN annotation_status = 'annotated' AND len(reasons) > 0 AND requeue_count < 3
    THEN requeue_count + 1 ELSE requeue_count END AS requeue_count,
  CASE WHEN annotation_status = 'annotated' AND len(reasons) > 0
    THEN array_to_string(reasons, ',') ELSE '' END AS reasons, role
FROM judged"""))
def requeue(spark, sf_dir):
    after = annotate.requeue(doc_nodes(spark, sf_dir), limit=None)
    props = F.from_json("properties", "role STRING, requeue_count BIGINT, requeue_reason ARRAY<STRING>")
    return after.select(
        "qualified_name", "annotation_status", props["requeue_count"].alias("requeue_count"),
        F.coalesce(F.array_join(props["requeue_reason"], ","), F.lit("")).alias("reasons"), props["role"].alias("role"))


@query("requeue_stats", with_docs(QUALITY + """
SELECT count(*) AS low_quality, count(*) FILTER (requeue_count < 3) AS requeued,
       count(*) FILTER (requeue_count >= 3) AS failed
FROM judged WHERE annotation_status = 'annotated' AND len(reasons) > 0"""))
def requeue_stats(spark, sf_dir):
    return annotate.requeue_stats(annotate.low_quality(doc_nodes(spark, sf_dir), limit=None), dry_run=False)


@query("tier_hint", with_docs("""
SELECT qualified_name, CASE WHEN (requeue_count + 1) / 5.0 >= 0.5 OR length(summary) > 2000 OR kind IN ('class', 'interface')
  THEN 'strong' ELSE 'fast' END AS recommended_model_tier FROM docs"""))
def tier_hint(spark, sf_dir):
    """With a centrality that follows from a number of the document."""
    props = F.from_json("properties", "requeue_count BIGINT")
    tier = annotate.recommended_tier(F.col("kind"), F.col("summary"), (props["requeue_count"] + 1) / 5.0)
    return doc_nodes(spark, sf_dir).select("qualified_name", tier.alias("recommended_model_tier"))


@query("pending_queue", with_docs("""
SELECT id, qualified_name, kind, CASE WHEN length(source) > 2000 OR kind IN ('class', 'interface')
  THEN 'strong' ELSE 'fast' END AS recommended_model_tier, md5(source) AS source_md5
FROM (SELECT *, array_to_string(list_slice(string_split(regexp_replace(summary, '\n$', ''), chr(10)), 1, 3), chr(10)) AS source FROM docs)
WHERE annotation_status IN ('pending', 'failed') ORDER BY id LIMIT 125"""))
def pending_queue(spark, sf_dir):
    docs = doc_nodes(spark, sf_dir)
    # Here every document is a file of its own.
    files = docs.select(F.col("qualified_name").alias("file_path"), F.col("summary").alias("content"))
    nodes = docs.withColumn("file_path", F.col("qualified_name")).withColumns({"start_line": F.lit(1), "end_line": F.lit(3)})
    queue = annotate.pending_queue(nodes, graph_edges(spark, sf_dir), files, batch_size=125, retry_failed=True)
    return queue.select("id", "qualified_name", "kind", "recommended_model_tier", F.md5("source").alias("source_md5"))


@query("queue_neighbors", with_graph("""
, batch AS (SELECT id FROM nodes WHERE kind = 'enum' ORDER BY id LIMIT 150),
far AS (SELECT source_id AS of_id, 'outgoing' AS direction, kind AS edge_kind, target_id AS other FROM edges
  UNION ALL SELECT target_id, 'incoming', kind, source_id FROM edges)
SELECT of_id, direction, edge_kind, n.kind, n.qualified_name FROM far JOIN batch b ON b.id = of_id JOIN nodes n ON n.id = other"""))
def queue_neighbors(spark, sf_dir):
    nodes, edges = graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir)
    pending = nodes.where("kind = 'enum'").withColumn("annotation_status", F.lit("pending"))
    return annotate.queue_neighbors(nodes, edges, annotate.pending_nodes(pending, 150))


# Tags of a document: its first words, its language and a few words with synonyms taken from its label.
TAGS_SQL = """list_value(split_part(text, ' ', 1), ' ' || upper(lang), 'Utils', 'helper',
  CASE WHEN quality = 1 THEN 'Tests' WHEN quality = 0 THEN 'error' END, '', lang)"""


def _tags():
    return F.array(F.split_part("text", F.lit(" "), F.lit(1)), F.concat(F.lit(" "), F.upper("lang")), F.lit("Utils"),
                   F.lit("helper"), F.when(F.col("quality") == 1, "Tests").when(F.col("quality") == 0, "error"),
                   F.lit(""), F.col("lang"))


@query("normalize_tags", f"""
WITH t AS (SELECT d.doc_id, unnest({TAGS_SQL}) AS tag, generate_subscripts({TAGS_SQL}, 1) AS i
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
n AS (SELECT doc_id, i, CASE {STRIP.format('lower(tag)')} WHEN 'utils' THEN 'utilities' WHEN 'helper' THEN 'utilities'
   WHEN 'tests' THEN 'testing' WHEN 'error' THEN 'error-handling' ELSE {STRIP.format('lower(tag)')} END AS tag
  FROM t WHERE tag IS NOT NULL),
f AS (SELECT doc_id, tag, min(i) AS i FROM n WHERE tag <> '' GROUP BY doc_id, tag)
SELECT doc_id, string_agg(tag, ',' ORDER BY i) AS tags FROM f GROUP BY doc_id""")
def normalize_tags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select("doc_id", F.array_join(annotate.normalize_tags(_tags()), ",").alias("tags"))


@query("name_variants", with_nodes(f"""
SELECT DISTINCT name, array_to_string(list_sort(list_distinct([{VARIANTS[0]}, {VARIANTS[1]}, {VARIANTS[2]}])), '|') AS variants
FROM (SELECT name FROM nodes UNION SELECT p_type FROM part)"""))
def name_variants(spark, sf_dir):
    names = graph_nodes(spark, sf_dir).select("name").unionByName(
        table(spark, sf_dir, "part").select(F.col("p_type").alias("name"))).distinct()
    return names.select("name", F.array_join(F.array_sort(annotate.name_variants(F.col("name"))), "|").alias("variants"))


RESULTS = """, results AS (
  SELECT 'doc::' || doc_id AS qualified_name, 'Reviewed: quality ' || quality AS summary, toxic = 1 AS failed FROM labels
  UNION ALL SELECT 'item::' || item_id, text, false FROM benchmark)"""


def _results(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("doc::"), F.col("doc_id").cast("string")).alias("qualified_name"),
        F.concat(F.lit("Reviewed: quality "), F.col("quality").cast("string")).alias("summary"),
        F.array(F.lit("Tests"), F.lit("label")).alias("tags"), F.lit("reviewed").alias("role"),
        (F.col("toxic") == 1).alias("failed"), F.col("doc_id").alias("position"))
    items = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("item::"), F.col("item_id").cast("string")).alias("qualified_name"),
        F.col("text").alias("summary"), F.array(F.lit("x")).alias("tags"), F.lit("r").alias("role"),
        F.lit(False).alias("failed"), F.col("item_id").alias("position"))
    return labels.unionByName(items)


@query("write_annotations", with_docs(RESULTS + """
SELECT d.qualified_name, md5(CASE WHEN r.failed = false THEN r.summary ELSE d.summary END) AS summary_md5,
  CASE WHEN r.failed THEN 'failed' WHEN r.failed = false THEN 'annotated' ELSE d.annotation_status END AS annotation_status,
  CASE WHEN r.failed THEN NULL WHEN r.failed = false THEN content_hash ELSE annotated_content_hash END AS annotated_content_hash,
  CASE WHEN r.failed = false THEN 'testing,label' ELSE language || ',' || json_extract_string(properties, '$.tags[1]') END AS tags,
  CASE WHEN r.failed = false THEN 'reviewed' ELSE role END AS role, requeue_count
FROM docs d LEFT JOIN results r ON r.qualified_name = d.qualified_name"""))
def write_annotations(spark, sf_dir):
    after = annotate.write_annotations(doc_nodes(spark, sf_dir), _results(spark, sf_dir))
    props = F.from_json("properties", "role STRING, tags ARRAY<STRING>, requeue_count BIGINT")
    return after.select(
        "qualified_name", F.md5("summary").alias("summary_md5"), "annotation_status", "annotated_content_hash",
        F.array_join(props["tags"], ",").alias("tags"), props["role"].alias("role"),
        props["requeue_count"].alias("requeue_count"))


@query("write_stats", with_docs(RESULTS + """
SELECT count(*) FILTER (d.id IS NOT NULL AND NOT failed) AS written, count(*) FILTER (d.id IS NOT NULL AND failed) AS failed,
       count(*) FILTER (d.id IS NULL) AS skipped
FROM results r LEFT JOIN docs d ON d.qualified_name = r.qualified_name"""))
def write_stats(spark, sf_dir):
    return annotate.write_stats(doc_nodes(spark, sf_dir), _results(spark, sf_dir))


# ---- memory -----------------------------------------------------------------------------------------------------

def _memory(spark, sf_dir):
    """Events as log entries: errors in one box, all others in the other."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "litter").otherwise("treat").alias("box"),
        F.col("event_type").alias("category"),
        F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" "), F.col("props")).alias("description"),
        F.lit("").alias("context"), F.col("ts").alias("created_at"), F.col("event_type").alias("source_agent"))


MEMORY = """WITH memory AS (
  SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'litter' ELSE 'treat' END AS box, event_type AS category,
         'user ' || user_id || ' ' || props AS description, ts FROM events) """


@query("memory_query", MEMORY + """
SELECT id, category, description FROM memory WHERE box = 'treat' AND category = 'purchase'
  AND contains(lower(description), 'user 4') ORDER BY ts DESC, id DESC LIMIT 50""")
def memory_query(spark, sf_dir):
    rows = memory.query_entries(_memory(spark, sf_dir), "treat", "purchase", "USER 4")
    return rows.select("id", "category", "description")


@query("memory_markdown", MEMORY + """
SELECT NULL AS category, '# Treat Box' || chr(10) AS value, CAST(NULL AS BIGINT) AS id
UNION ALL SELECT DISTINCT category, chr(10) || '## ' || category || chr(10), NULL FROM memory WHERE box = 'treat'
UNION ALL SELECT category, '- **' || description || '** _(agent: ' || category || ')_', id FROM memory WHERE box = 'treat'""")
def memory_markdown(spark, sf_dir):
    return memory.markdown_lines(_memory(spark, sf_dir), "treat").select("category", "value", "id")


# ---- merges -----------------------------------------------------------------------------------------------------

@query("upsert_nodes", with_docs("""
, incoming AS (SELECT 'doc::' || conv_id AS qualified_name, 'turn ' || turn AS name, text AS summary,
    CASE role WHEN 'user' THEN 'pending' WHEN 'assistant' THEN 'annotated' ELSE 'failed' END AS annotation_status,
    sha256(text) AS content_hash FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
j AS (SELECT d.qualified_name IS NOT NULL AND i.qualified_name IS NOT NULL
      AND d.annotation_status IN ('annotated', 'failed') AND i.annotation_status = 'pending' AS keep,
    coalesce(i.qualified_name, d.qualified_name) AS qualified_name, coalesce(i.name, d.name) AS name,
    d.summary AS os, i.summary AS ns, d.annotation_status AS oa, i.annotation_status AS na,
    coalesce(i.content_hash, d.content_hash) AS content_hash, i.qualified_name IS NULL AS old_only
  FROM docs d FULL OUTER JOIN incoming i ON d.qualified_name = i.qualified_name)
SELECT qualified_name, name, md5(CASE WHEN keep OR old_only THEN os ELSE ns END) AS summary_md5,
       CASE WHEN keep OR old_only THEN oa ELSE na END AS annotation_status, content_hash FROM j"""))
def upsert_nodes(spark, sf_dir):
    stored = doc_nodes(spark, sf_dir)
    incoming = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("doc::"), F.col("conv_id").cast("string")).alias("qualified_name"),
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("name"), F.col("text").alias("summary"),
        F.when(F.col("role") == "user", "pending").when(F.col("role") == "assistant", "annotated")
        .otherwise("failed").alias("annotation_status"),
        F.sha2("text", 256).alias("content_hash"), F.col("turn").alias("position"))
    after = merge.upsert_nodes(stored, incoming, position="position")
    return after.select("qualified_name", "name", F.md5("summary").alias("summary_md5"), "annotation_status", "content_hash")


@query("upsert_edges", """
WITH new AS (SELECT l_orderkey AS source_id, l_partkey AS target_id, 'depends_on' AS kind,
    arg_max(l_quantity, l_linenumber::BIGINT * 1000000000 + l_suppkey * 1000 + l_quantity) AS weight
  FROM lineitem WHERE l_linenumber < 4 GROUP BY l_orderkey, l_partkey),
old AS (SELECT l_orderkey AS source_id, l_partkey AS target_id, 'depends_on' AS kind, min(l_discount) AS weight
  FROM lineitem WHERE l_linenumber > 2 GROUP BY l_orderkey, l_partkey)
SELECT source_id, target_id, kind, coalesce(new.weight, old.weight) AS weight
FROM old FULL JOIN new USING (source_id, target_id, kind)""")
def upsert_edges(spark, sf_dir):
    """Half of the incoming edges are stored already, with other weights."""
    stored = table(spark, sf_dir, "lineitem").where("l_linenumber > 2").groupBy(
        F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.lit("depends_on").alias("kind")).agg(
        F.min("l_discount").alias("weight"))
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber < 4").select(
        F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.lit("depends_on").alias("kind"),
        F.col("l_quantity").alias("weight"),
        (F.col("l_linenumber").cast("long") * F.lit(10**9) + F.col("l_suppkey") * 1000 + F.col("l_quantity").cast("long")).alias("position"))
    return merge.upsert_edges(stored, lines, position="position")


GONE = """gone AS (SELECT id FROM nodes WHERE file_path IN (
  SELECT 'orders/' || year(o_orderdate) || '/' || o_orderstatus FROM orders WHERE o_orderstatus = 'F'))"""


def _after_delete(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    files = orders.select(F.concat(F.lit("orders/"), F.year("o_orderdate").cast("string"), F.lit("/F")).alias("file_path"))
    return merge.delete_files(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir), files)


@query("delete_nodes", with_nodes(f", {GONE} SELECT * FROM nodes WHERE id NOT IN (SELECT id FROM gone)"))
def delete_nodes(spark, sf_dir):
    return _after_delete(spark, sf_dir)[0]


@query("delete_cascade", with_graph(f""", {GONE}
SELECT * FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)"""))
def delete_cascade(spark, sf_dir):
    return _after_delete(spark, sf_dir)[1]


@query("stored_hashes", with_docs("SELECT file_path, content_hash FROM docs WHERE kind = 'file' AND content_hash IS NOT NULL"))
def stored_hashes(spark, sf_dir):
    return diff.stored_hashes(doc_nodes(spark, sf_dir))


@query("git_changes", """
WITH old AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus <> 'P'), new AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 9 <> 4)
SELECT 'c/' || coalesce(old.k, new.k) AS file_path,
  CASE WHEN old.k IS NULL THEN 'new' WHEN new.k IS NULL THEN 'deleted' ELSE 'modified' END AS change_type
FROM old FULL JOIN new ON old.k = new.k WHERE old.k IS NULL OR new.k IS NULL OR old.k IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def git_changes(spark, sf_dir):
    """Stored and present files by the keys of customers; git's list are those with a debt."""
    from codeloom.sources.tree import git_changes as changes

    def files(df, key):
        return df.select(F.concat(F.lit("c/"), F.col(key).cast("string")).alias("file_path")).distinct()

    customer = table(spark, sf_dir, "customer")
    return changes(files(table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'"), "o_custkey"),
                   files(customer.where("c_custkey % 9 <> 4"), "c_custkey"), files(customer.where("c_acctbal < 0"), "c_custkey"))


# ---- pages and budgets ------------------------------------------------------------------------------------------

@query("page_rows", with_nodes("SELECT id, qualified_name FROM nodes ORDER BY file_path, id LIMIT 50 OFFSET 100"))
def page_rows(spark, sf_dir):
    """The third page of 50, each page found by the key of the last row before it."""
    mark, cursor = paging.call_mark("nodes"), None
    nodes = graph_nodes(spark, sf_dir)
    for _ in range(3):
        rows, cursor = paging.page(nodes, ["file_path", "id"], cursor, 50, mark)
    return rows.select("id", "qualified_name")


@query("budget_prefix", """
SELECT doc_id, CAST(used AS BIGINT) AS used FROM (
  SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents)
WHERE used <= 60000""")
def budget_prefix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = paging.budget_prefix(docs, ["doc_id"], F.col("n_chars"), 60_000)
    return rows.select("doc_id", "used")


@query("token_estimate", with_nodes("""
SELECT id, CAST(greatest(1, ceil(length('{"kind":"' || kind || '","qualified_name":"' || qualified_name || '"}') / 4.0))
  AS BIGINT) AS tokens FROM nodes"""))
def token_estimate(spark, sf_dir):
    nodes = graph_nodes(spark, sf_dir)
    return nodes.select("id", paging.row_tokens(nodes, ["kind", "qualified_name"]).alias("tokens"))
