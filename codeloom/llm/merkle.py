"""Merkle manifest of a dataset: a hash tree over its rows, and every row's proof, by butterfly exchange.

Rows are the leaves of trees (one for each value of a column), and the trees' roots, in order, are the leaves of one more tree.
A node is the hash of up to ``fanout`` consecutive nodes of the level below, also of a single one, until one node is left.

The leaves of a tree are numbered by range partitions and prefix sums of their sizes, and cut into aligned blocks of
fanout ** LEVELS leaves. A block hashes its own subtree. Then blocks swap roots round by round: in round r, a block has its
ancestor r levels above its own root, asks for the ancestors of its siblings one block each of theirs, and hashes the next
ancestor itself, as all other blocks below it do. So after the last round every block has the tree's root and the siblings
of all its ancestors, and no message ever goes down the tree. A round moves a few digests per block, never leaves.

Nulls: a null field is ``-`` in its leaf's input, the tree of null keys is the first one, null ids come first in a tree.
Rows with equal ids are ordered by their leaves; repeated rows have equal leaves, so it makes no difference which comes first.
Empty and very long texts are hashed like others, whole. An empty table has no rows, no trees and no root. Extra columns are
not part of a leaf unless named, and not looked at, also if they clash with names in here.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import written

FANOUT = 2
#: Levels of a block of leaves: 4,096 leaves with a fanout of 2.
LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SIDES = "array<struct<left: string, right: string>>"


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """The hash of some fields, each as its length in bytes and its value."""
    values = [f.cast("string") for f in fields]
    told = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.sha2(F.concat(*told), 256)


def placed(items: DataFrame, order: list[str]) -> DataFrame:
    """``items(tree, leaf, ...)`` with nth (the place in its tree by ``order``) and n (the tree's leaves).

    The last part of the order is the row, so that a third of all rows with one id are still spread over the partitions."""
    by = ["tree", *order, "leaf", "row"]
    rows = items.withColumn("row", F.monotonically_increasing_id())
    lies = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")
    lies = lies.withColumn("part", F.shiftright("at", 33))
    # at most as many rows of a tree as there are partitions
    parts = lies.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    of_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = written(parts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(of_tree).alias("n")), "merkle-parts")
    return lies.join(parts, ["tree", "part"]).withColumn("nth", F.col("at") + F.col("shift")).drop("row", "at", "part", "shift")


def height(n: int, fanout: int) -> int:
    """The levels above the leaves of a tree of n."""
    levels, reach = 0, 1
    while reach < n:
        levels, reach = levels + 1, reach * fanout
    return levels


def levels_of(leaves: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes of each level of a subtree, the leaves first."""
    found = [leaves]
    for _ in range(levels):
        low = found[-1]
        found.append([sha256("".join(low[i:i + fanout])) for i in range(0, len(low), fanout)])
    return found


def sides_of(nodes: list[list[str]], i: int, fanout: int) -> list[tuple[str, str]]:
    """(siblings to the left, to the right) of the i-th leaf and each of its ancestors below the top."""
    found = []
    for level in nodes[:-1]:
        first = i - i % fanout
        found.append(("".join(level[first:i]), "".join(level[i + 1:first + fanout])))
        i //= fanout
    return found


def blocks(items: DataFrame, order: list[str], fanout: int, levels: int) -> DataFrame:
    """A row per block: tree, block, blocks (of its tree), levels (of its own subtree), root (of that), and leaves, an array of
    the items' columns and nth."""
    rows = placed(items, order)
    size = fanout ** levels
    fields = ["nth", *(c for c in items.columns if c != "tree")]
    grouped = rows.groupBy("tree", F.floor(F.col("nth") / size).cast("long").alias("block")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct(*fields))).alias("leaves"))  # at most ``size`` each

    def run(batches):
        for batch in batches:
            own, roots = [], []
            for n, leaves in zip(batch.column("n").to_pylist(), batch.column("leaves"), strict=True):
                own.append(levels if n > size else height(n, fanout))
                roots.append(levels_of(leaves.values.field("leaf").to_pylist(), own[-1], fanout)[-1][0])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own, pa.int32()), pa.array(roots, pa.string())], names=[*batch.schema.names, "levels", "root"])

    kind = grouped.schema["leaves"].dataType.simpleString()
    made = grouped.mapInArrow(run, f"tree string, block long, n long, leaves {kind}, levels int, root string")
    return written(made.withColumn("blocks", F.ceil(F.col("n") / size).cast("long")), "merkle-blocks")


def exchanged(made: DataFrame, fanout: int) -> DataFrame:
    """(tree, block, root, upper) for the ``blocks``: the tree's root, and the siblings of the block's root and of its ancestors."""
    state = made.select("tree", "block", "blocks", "root").withColumn("upper", F.expr(f"cast(array() as {SIDES})"))
    reach = 1
    most = made.agg(F.max("blocks")).first()[0] or 0
    while reach < most:
        own = F.floor(F.col("block") / reach).cast("long")
        first = own - own % fanout
        # siblings that exist, and of each one block: as far into it as the block is into its own ancestor
        there = F.least(F.lit(reach).cast("long"), F.col("blocks") - F.col("other") * reach)
        asked = (state.where(F.col("blocks") > reach).select("tree", "block", "blocks", own.alias("own"), F.explode(F.sequence(first, first + fanout - 1)).alias("other"))
                 .where((F.col("other") != F.col("own")) & (F.col("other") * reach < F.col("blocks")))
                 .select("tree", "block", "other", (F.col("other") * reach + (F.col("block") % reach) % there).alias("holder")))
        told = asked.join(state.select("tree", F.col("block").alias("holder"), F.col("root").alias("digest")), ["tree", "holder"])
        heard = told.groupBy("tree", "block").agg(F.sort_array(F.collect_list(F.struct("other", "digest"))).alias("heard"))  # fanout - 1 each

        def joined(test):
            return F.array_join(F.transform(F.filter("heard", test), lambda h: h["digest"]), "")

        live = state.join(heard, ["tree", "block"], "left").withColumn("heard", F.coalesce("heard", F.expr("cast(array() as array<struct<other: long, digest: string>>)")))
        live = live.withColumn("left", joined(lambda h: h["other"] < own)).withColumn("right", joined(lambda h: h["other"] > own))
        goes_on = F.col("blocks") > reach
        upper = F.when(goes_on, F.concat("upper", F.array(F.struct("left", "right")))).otherwise(F.col("upper"))
        root = F.when(goes_on, F.sha2(F.concat("left", "root", "right"), 256)).otherwise(F.col("root"))
        state = written(live.select("tree", "block", "blocks", root.alias("root"), upper.cast(SIDES).alias("upper")), "merkle-round")
        reach *= fanout
    return state.drop("blocks")


def grown(items: DataFrame, order: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The ``blocks`` of ``items(tree, leaf, ...)``, root being that of the whole tree, with upper: what is beside the block's
    ancestors, from its own root upwards."""
    made = blocks(items, order, fanout, levels)
    return made.drop("root").join(exchanged(made, fanout), ["tree", "block"])


def manifest(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """A row per leaf of ``leaves(tree, id, leaf, tried)``: id, leaf, subroot (of its tree), root (of all), proof_sha256 (of all siblings on
    its way), folded_root (what ``tried``, or else the leaf, comes to with these siblings), verified (whether that is the root)."""
    trees = grown(leaves, ["id"], fanout, levels)
    tops = trees.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("leaf"))
    top = grown(written(tops, "merkle-tops"), ["name"], fanout, levels)

    def opened(batches):
        for batch in batches:
            for own, leaves, upper, root in zip(batch.column("levels").to_pylist(), batch.column("leaves").to_pylist(),
                                                batch.column("upper").to_pylist(), batch.column("root").to_pylist(), strict=True):
                nodes = levels_of([x["leaf"] for x in leaves], own, fanout)
                rows = [{"tree": x["name"], "top": root, "beside": [dict(zip(("left", "right"), s, strict=True)) for s in sides_of(nodes, i, fanout)] + upper}
                        for i, x in enumerate(leaves)]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("tree", pa.string()), ("top", pa.string()), (
                    "beside", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))]))

    above = written(top.select("levels", "leaves", "upper", "root").mapInArrow(opened, f"tree string, top string, beside {SIDES}"), "merkle-above")
    whole = trees.join(above, "tree").select("levels", "leaves", F.col("root").alias("subroot"), "top", F.concat("upper", "beside").alias("upper"))

    def proved(batches):
        for batch in batches:
            for row in batch.to_pylist():
                leaves, upper = row["leaves"], [(s["left"], s["right"]) for s in row["upper"]]
                nodes = levels_of([x["leaf"] for x in leaves], row["levels"], fanout)
                proofs, folded = [], []
                for i, x in enumerate(leaves):
                    sides = sides_of(nodes, i, fanout) + upper
                    node = x["leaf"] if x["tried"] is None else x["tried"]
                    for left, right in sides:
                        node = sha256(left + node + right)
                    proofs.append(sha256("".join([a + b for a, b in sides])))
                    folded.append(node)
                n = len(leaves)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["id"] for x in leaves], pa.int64()), pa.array([x["leaf"] for x in leaves]), pa.array([row["subroot"]] * n),
                     pa.array([row["top"]] * n), pa.array(proofs), pa.array(folded), pa.array([f == row["top"] for f in folded])],
                    names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return whole.mapInArrow(proved, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def documents_manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The ``manifest`` of documents by language, where n_chars of one document in seven is one more than it was when it is verified."""
    fields = [F.col(c) for c in FIELDS]
    tried = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    # a name for each tree that is not null, in the order of the languages
    rows = docs.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("id"),
                       leaf(*fields).alias("leaf"), F.when(tampered, leaf(*tried)).alias("tried"))
    return manifest(written(rows, "merkle-leaves"), fanout, levels).withColumnRenamed("id", "doc_id")


SQL = r"""
with recursive d as materialized (select row_number() over () as r, doc_id, source, lang, n_chars, text from documents),
f as (select r, doc_id, lang, n_chars, coalesce(strlen(doc_id::varchar)::varchar || ':' || doc_id::varchar, '-')
    || coalesce(strlen(source)::varchar || ':' || source, '-') || coalesce(strlen(lang)::varchar || ':' || lang, '-') as a,
  coalesce(strlen(n_chars::varchar)::varchar || ':' || n_chars::varchar, '-') as b,
  coalesce(strlen((n_chars + 1)::varchar)::varchar || ':' || (n_chars + 1)::varchar, '-') as b_tried,
  coalesce(strlen(text)::varchar || ':' || text, '-') as c,
  xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda crc, byte:
    list_reduce(list_concat([xor(crc, byte)], range(8)), lambda y, step: case when y & 1 = 1 then xor(y >> 1, 3988292384) else y >> 1 end)), 4294967295) as crc
  from d),
leaves as (select r, doc_id, lang, sha256(a || b || c) as leaf, case when crc % 7 = 0 then sha256(a || b_tried || c) else sha256(a || b || c) end as tried from f),
base as materialized (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from leaves),
tree(lang, l, i, n, h) as (select lang, 0, i, n, leaf from base union all
  select lang, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from tree where n > 1 group by lang, l, i // 2, n),
tops as materialized (select lang, l as height, h, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from tree where n = 1),
top(l, i, n, h) as (select 0, i, n, h from tops union all
  select l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from top where n > 1 group by l, i // 2, n),
sib as materialized (
  select b.r, t.l, t.h, t.i & 1 = 0 as before from base b join tree t on t.lang is not distinct from b.lang and t.i = xor(b.i >> t.l, 1)
  union all
  select b.r, s.height + t.l, t.h, t.i & 1 = 0 from base b join tops s on s.lang is not distinct from b.lang join top t on t.i = xor(s.i >> t.l, 1)),
whole as materialized (select b.r, b.doc_id, b.leaf, b.tried, s.h as subroot, s.height + (select max(l) from top) as height, (select h from top where n = 1) as root
  from base b join tops s on s.lang is not distinct from b.lang),
fold(r, l, h) as (select r, 0, tried from whole union all
  select f.r, f.l + 1, sha256(case when s.h is null then f.h when s.before then s.h || f.h else f.h || s.h end)
  from fold f join whole w on w.r = f.r left join sib s on s.r = f.r and s.l = f.l where f.l < w.height)
select w.doc_id, w.leaf, w.subroot, w.root, sha256(coalesce((select string_agg(s.h, '' order by s.l) from sib s where s.r = w.r), '')) as proof_sha256,
  f.h as folded_root, f.h = w.root as verified
from whole w join fold f on f.r = w.r and f.l = w.height
"""
