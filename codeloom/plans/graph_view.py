"""The given tables read as a code graph.

nodes: region (module), nation (file), supplier (interface), customer (class), part (enum)
and orders (function); ids are 10^12 times the number of the table plus its key.
edges: region -> nation -> customer / supplier ``contains``; customer -> order ``calls``;
order -> part ``depends_on`` and part -> supplier ``imports`` from lineitem; part -> part
``inherits``, which closes cycles.

Documents are nodes with text: ``doc_nodes`` overlays the labels as annotation state.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = {"region": 1, "nation": 2, "supplier": 3, "customer": 4, "part": 5, "order": 6, "doc": 7}
STEP = 10**12


# Columns of the given tables, stated so that opening a table starts no job.
COLUMNS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def node_id(entity: str, key):
    return (F.lit(BASE[entity] * STEP) + F.col(key).cast("long")).cast("long")


def _node(df: DataFrame, entity: str, kind: str, key: str, name, path) -> DataFrame:
    return df.select(
        node_id(entity, key).alias("id"),
        F.lit(kind).alias("kind"),
        name.alias("name"),
        F.concat(F.lit(f"{entity}::"), F.col(key).cast("string")).alias("qualified_name"),
        path.alias("file_path"),
    )


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, name, qualified_name, file_path) of the whole graph."""
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation").join(
        F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")
    )
    # region and nation are fixed lists of the schema (5 and 25 rows), so they are broadcast.
    nation_path = F.concat(F.lit("geo/"), F.col("r_name"), F.lit("/"), F.col("n_name"))
    places = F.broadcast(nation.select("n_nationkey", nation_path.alias("place")))
    supplier = table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    customer = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    part = table(spark, sf_dir, "part")
    orders = table(spark, sf_dir, "orders")
    parts = [
        _node(region, "region", "module", "r_regionkey", F.col("r_name"), F.concat(F.lit("geo/"), F.col("r_name"))),
        _node(nation, "nation", "file", "n_nationkey", F.col("n_name"), nation_path),
        _node(supplier, "supplier", "interface", "s_suppkey", F.col("s_name"),
              F.concat(F.col("place"), F.lit("/suppliers"))),
        _node(customer, "customer", "class", "c_custkey", F.col("c_name"),
              F.concat(F.col("place"), F.lit("/customers/"), F.col("c_mktsegment"))),
        _node(part, "part", "enum", "p_partkey", F.col("p_name"),
              F.concat(F.lit("catalog/"), F.col("p_brand"), F.lit("/"), F.col("p_type"))),
        _node(orders, "order", "function", "o_orderkey", F.col("o_orderpriority"),
              F.concat(F.lit("orders/"), F.year("o_orderdate").cast("string"), F.lit("/"), F.col("o_orderstatus"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def _edge(df: DataFrame, kind: str, source, target) -> DataFrame:
    return df.select(source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("kind"))


#: Rows of lineitem whose edges one task tells apart, about.
PIECE_ROWS = 500_000


def _distinct(pairs: DataFrame, pieces: int) -> DataFrame:
    least = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if pieces <= least:
        return pairs.distinct()
    return pairs.repartition(pieces, "source_id", "target_id").distinct()


def graph_edges(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """(source_id, target_id, kind). ``distinct=False`` keeps the repeats that lineitem holds,
    for operators that drop repeats themselves and so need no shuffle here."""
    nation = table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier")
    customer = table(spark, sf_dir, "customer")
    part = table(spark, sf_dir, "part")
    orders = table(spark, sf_dir, "orders")
    lineitem = table(spark, sf_dir, "lineitem")
    uses = _edge(lineitem, "depends_on", node_id("order", "l_orderkey"), node_id("part", "l_partkey"))
    made = _edge(lineitem, "imports", node_id("part", "l_partkey"), node_id("supplier", "l_suppkey"))
    if distinct:
        # Told apart in pieces whose number follows the rows (which readers count from the files' ends), so that a task holds a piece
        # and not a share of the table.
        pieces = math.ceil(lineitem.count() / PIECE_ROWS)
        uses, made = (_distinct(pairs, pieces) for pairs in (uses, made))
    # The ring over the parts needs their number, read as a scalar subquery.
    n_parts = part.agg(F.count(F.lit(1))).scalar()
    ring = part.select("p_partkey", F.pmod(F.col("p_partkey") * 7 + 1, n_parts).alias("next_part"))
    parts = [
        _edge(nation, "contains", node_id("region", "n_regionkey"), node_id("nation", "n_nationkey")),
        _edge(supplier, "contains", node_id("nation", "s_nationkey"), node_id("supplier", "s_suppkey")),
        _edge(customer, "contains", node_id("nation", "c_nationkey"), node_id("customer", "c_custkey")),
        _edge(orders, "calls", node_id("customer", "o_custkey"), node_id("order", "o_orderkey")),
        uses,
        made,
        _edge(ring, "inherits", node_id("part", "p_partkey"), node_id("part", "next_part")),
    ]
    return reduce(DataFrame.unionByName, parts)


def doc_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as annotated nodes, with the columns of the full node table that they fill."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = (
        F.when(F.col("quality") == 1, "annotated").when(F.col("quality") == 0, "failed").otherwise("pending")
    )
    kind = (
        F.when(F.col("lang") == "en", "function").when(F.col("lang") == "fr", "class")
        .when(F.col("lang") == "de", "method").otherwise("file")
    )
    role = F.when(F.col("lang") == "en", "Function").otherwise(F.col("source"))
    digest = F.sha2("text", 256)
    return docs.select(
        node_id("doc", "doc_id").alias("id"),
        kind.alias("kind"),
        F.regexp_extract("text", r"^(\S*)", 1).alias("name"),
        F.concat(F.lit("doc::"), F.col("doc_id").cast("string")).alias("qualified_name"),
        F.concat(F.lit("corpus/"), F.col("source"), F.lit("/"), F.col("lang")).alias("file_path"),
        F.col("lang").alias("language"),
        F.col("text").alias("summary"),
        status.alias("annotation_status"),
        digest.alias("content_hash"),
        F.concat(
            F.lit('{"role": "'), role, F.lit('", "tags": ["'), F.col("lang"), F.lit('", "'), F.col("source"),
            F.lit('"], "requeue_count": '), F.pmod(F.col("n_chars"), F.lit(5)).cast("string"), F.lit("}"),
        ).alias("properties"),
        F.when(F.col("quality") == 1, F.when(F.col("toxic") == 0, digest)
               .otherwise(F.sha2(F.upper("text"), 256))).alias("annotated_content_hash"),
    )
