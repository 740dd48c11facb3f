"""Table schemas and fixed values of the code graph."""

from pyspark.sql import types as T

# The columns of the three tables.
NODES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("qualified_name", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("language", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("annotation_status", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("properties", T.StringType()),
    T.StructField("annotated_content_hash", T.StringType()),
    T.StructField("graph_version", T.LongType()),
    T.StructField("centrality", T.DoubleType()),
    T.StructField("in_degree_cache", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

EDGES = T.StructType([
    T.StructField("source_id", T.LongType()),
    T.StructField("target_id", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("properties", T.StringType()),
    T.StructField("updated_at", T.TimestampType()),
])

MEMORY = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("box", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("source_agent", T.StringType()),
])

# The sets below must stay as they are for results to be right.
NODE_KINDS = ["function", "class", "method", "interface", "type_alias", "enum", "module", "file"]
EDGE_KINDS = ["imports", "calls", "inherits", "contains", "depends_on"]
ANNOTATION_STATUSES = ["pending", "annotated", "failed"]
CHECKS = ["dangling_edges", "orphan_nodes", "stale_annotations"]

# Edge weights of the weighted PageRank and its constants.
EDGE_WEIGHTS = {
    "calls": 1.0,
    "imports": 0.6,
    "inherits": 0.9,
    "contains": 0.3,
    "depends_on": 0.5,
}
DEFAULT_EDGE_WEIGHT = 0.5
PAGERANK_DAMPING = 0.85
PAGERANK_ROUNDS = 50
PAGERANK_STOP_DELTA = 1e-8
PAGERANK_WARN_DELTA = 0.01

# File suffix to language.
LANGUAGES = {
    ".py": "python",
    ".ts": "typescript",
    ".tsx": "tsx",
    ".js": "javascript",
    ".jsx": "javascript",
}

# The tag vocabulary and the synonyms mapped into it.
TAG_TAXONOMY = [
    "auth",
    "database",
    "api",
    "config",
    "testing",
    "logging",
    "validation",
    "serialization",
    "middleware",
    "routing",
    "models",
    "services",
    "utilities",
    "error-handling",
    "caching",
]
TAG_SYNONYMS = {
    "authentication": "auth",
    "authorization": "auth",
    "db": "database",
    "sql": "database",
    "orm": "database",
    "rest": "api",
    "http": "api",
    "endpoint": "api",
    "endpoints": "api",
    "configuration": "config",
    "settings": "config",
    "test": "testing",
    "tests": "testing",
    "log": "logging",
    "validate": "validation",
    "validator": "validation",
    "serialize": "serialization",
    "deserialize": "serialization",
    "json": "serialization",
    "route": "routing",
    "routes": "routing",
    "router": "routing",
    "model": "models",
    "schema": "models",
    "service": "services",
    "util": "utilities",
    "utils": "utilities",
    "helper": "utilities",
    "helpers": "utilities",
    "error": "error-handling",
    "errors": "error-handling",
    "exception": "error-handling",
    "exceptions": "error-handling",
    "cache": "caching",
}

# Phrases and roles that mark an annotation as weak.
PLACEHOLDER_PHRASES = [
    "code node representing unknown",
    "unknown implementation",
    "source file container",
    "implementation detail",
    "function implementation",
    "class implementation",
]
GENERIC_ROLES = ["function", "file", "class", "method"]
MAX_REQUEUE = 3

# Memory boxes and their categories.
MEMORY_CATEGORIES = {
    "litter": ["failure", "anti-pattern", "unsupported", "regression", "never-do"],
    "treat": ["best-practice", "validated-pattern", "always-do", "convention", "optimization"],
}
