"""Mixing sources to target weights.

Every document gets a random key from a hash of its id. The keys' range is cut into as many equal parts as the data needs
(parts of about ``PART_ROWS`` rows); documents are ordered by key within (source, part), and a prefix sum of the parts'
totals makes that an order of the whole source, in which no task holds more than one part. The mix of a source is a budget
of words, taken in that order: whole epochs first, then the documents of the next epoch up to the exact word.

Null, empty and blank texts have no words and are never taken. A null source is a source of its own, the last one. Rows
that agree in id and size are interchangeable; other ties are ordered by id, then size. An empty table gives no rows.
Extra columns play no part in ``mix`` and are carried along by ``materialise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import WORD, fresh, row_key, word_count
from codeloom.session import written

#: Rows in one part of the key range, which one task orders at a time.
PART_ROWS = 50_000
SEED = "mix-1"


def random_key(doc_id: Column) -> Column:
    """32 hexadecimal digits that order the documents at random, the same in every run."""
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def source_targets(per_source: DataFrame, weights: tuple[int, ...], most_epochs: int) -> DataFrame:
    """(source, source_size) with ``target`` added: the weights' shares of all words, none above ``most_epochs`` times
    its source.

    Sources are weighted in code-point order, null last. In the order of ``most_epochs * size / weight``, the sources that
    stop at their limit come first; the level at which a source would stop is what the limits before it have left, over the
    weights that are left. There is one row per source here, not per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.lit(list(weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = (per_source.withColumn("place", F.row_number().over(by_name) - 1)
              .withColumn("weight", weight.cast("long"))
              .withColumn("limit", F.col("source_size") * most_epochs))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levelled = (ranked.withColumn("level", left / weight_left)
                .withColumn("stops", F.col("limit") <= F.col("weight") * F.col("level")))
    first_free = F.min(F.when(~F.col("stops"), F.struct(F.col("limit") / F.col("weight"), "place", "level"))).over(whole)
    return levelled.withColumn("free", first_free["level"]).select(
        "source", "source_size",
        F.when(F.col("free").isNull() | F.col("stops"), F.col("limit").cast("double"))
        .otherwise(F.col("weight") * F.col("free")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, part_rows: int = PART_ROWS) -> DataFrame:
    """For each row of ``docs``: doc_id, source, size, source_size, target, taken, and the parts of its ``row_key``
    (key_id, key_hash, key_bytes)."""
    key_id, key_hash, key_bytes = row_key(F.col("doc_id"), F.col("text"))
    sized = written(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), random_key(F.col("doc_id")).alias("key"),
        key_id.alias("key_id"), key_hash.alias("key_hash"), key_bytes.alias("key_bytes")), "mix-sizes")
    parts = max(1, -(-sized.count() // part_rows))
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    # 13 digits are exact as a double; the part is the key's place in the range of keys
    part = F.floor(F.conv(F.substring("key", 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13)) * parts)
    sized = sized.withColumn("name", named).withColumn("part", part)
    per_part = sized.groupBy("name", "source", "part").agg(F.sum("size").alias("part_size"))
    per_source = per_part.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    targets = source_targets(per_source, weights, most_epochs).withColumn("name", named).drop("source")
    earlier = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (per_part.withColumn("before", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
               .select("name", "part", "before").join(targets, "name"))
    inside = Window.partitionBy("name", "part").orderBy("key", "key_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(offsets, ["name", "part"]).withColumn(
        "begins", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor("target")
    per_epoch = F.greatest("source_size", F.lit(1))
    rest = F.greatest(F.least(budget % per_epoch - F.col("begins"), F.col("size")), F.lit(0))
    taken = F.floor(budget / per_epoch) * F.col("size") + rest
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"),
                         "key_id", "key_hash", "key_bytes")


def materialise(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mixed documents with the columns of ``docs``: a row for every epoch that takes a document, its text cut after
    the last word taken; documents that are not taken go. ``n_chars``, if there, follows the text."""
    names = [fresh(docs, n) for n in ("mix_id", "mix_hash", "mix_bytes", "mix_size", "mix_taken", "mix_epoch")]
    a, b, c, size, taken, epoch = names
    # repeated rows share a key: number them on both sides, so that each meets one row of the plan
    n = fresh(docs, "mix_n")
    keyed = docs
    for name, column in zip((a, b, c), row_key(docs["doc_id"], docs["text"]), strict=True):
        keyed = keyed.withColumn(name, column)
    wanted = (plan.groupBy(F.col("key_id").alias(a), F.col("key_hash").alias(b), F.col("key_bytes").alias(c))
              .agg(F.max("size").alias(size), F.sum("taken").alias(taken), F.count(F.lit(1)).alias(n)))
    joined = keyed.join(wanted, [a, b, c])
    # the words taken from a set of repeated rows are dealt to them evenly, the first rows getting what is over
    place = F.row_number().over(Window.partitionBy(a, b, c).orderBy(a))
    deal = F.floor(F.col(taken) / F.col(n)) + F.when(place <= F.col(taken) % F.col(n), 1).otherwise(0)
    dealt = joined.withColumn(taken, deal)
    last = F.ceil(F.col(taken) / F.col(size)).cast("int")
    rows = dealt.where(F.col(taken) > 0).withColumn(epoch, F.explode(F.sequence(F.lit(1), last)))
    over = (F.col(taken) - (F.col(epoch) - 1) * F.col(size)).cast("int")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, over), "")
    text = F.when(over < F.col(size), cut).otherwise(F.col("text"))
    columns = {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return rows.withColumns(columns).select(*docs.columns)


SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    md5('mix-1:' || coalesce(cast(doc_id as varchar), 'null')) as key, coalesce(cast(doc_id as varchar), 'null') as key_id
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, row_number() over (order by source nulls last) - 1 as place from s),
r as (select source, source_size, place, 1 + place % 3 as weight, 3 * source_size as cap from w),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over o, 0))::double
      / (sum(weight) over () - coalesce(sum(weight) over o, 0))::double as level
    from r window o as (order by cap / weight::double, place rows between unbounded preceding and 1 preceding)),
f as (select *, cap <= weight * level as stops from l),
t as (select source, source_size, case when stops or (select count(*) from f where not stops) = 0 then cap::double
      else weight * (select level from f where not stops order by cap / weight::double, place limit 1) end as target from f),
p as (select d.doc_id, d.size::bigint as size, t.source_size, t.target, floor(t.target)::bigint as budget,
    greatest(t.source_size, 1) as per_epoch,
    coalesce(sum(d.size) over (partition by d.source order by key, key_id, size
      rows between unbounded preceding and 1 preceding), 0)::bigint as begins
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (budget // per_epoch * size + greatest(least(budget % per_epoch - begins, size), 0))::bigint as taken from p
"""
