"""Near-duplicate texts by BagMinHash: weighted Jaccard similarity of their word shingles, counted as often as they occur.

Every shingle has a Poisson process of points over (time, weight), the same for all documents; a document sees the points
below the shingle's number of occurrences. The weights are cut in dyadic bands, each with a process of its own rate, and a
point's place in its band says which occurrences it belongs to. A component of the signature is the first point that falls to
it, so that two documents agree in it with a probability of exactly their weighted Jaccard similarity. Points are made in
order of time and only up to the time by which the signature should be full; documents where it is not go on.

The signature is banded; documents that share a band's bucket are candidates. Documents with equal shingles are one class, and
only classes are compared. In each bucket the classes are first compared with that of most copies; where a bucket still holds
several groups, the classes of different groups are compared with each other. Shingles that a class has alone, or apart from the
typical class of its bucket, bound its similarity to others and rule out most of these pairs. A comparison takes the exact
similarity of all shingles.
Groups are the components of the pairs of at least ``LEAST``; one document of a group is kept, that with the smallest id.

A text without words (null, empty, blank) is like no other, except that repeated rows of it are one document. A text of fewer
words than a shingle is one shingle. Null ids come last in the choice of the kept document; ties of id go to the smaller text
hash. Repeated rows (same id and text) are copies of each other. An empty table gives no rows; extra columns are carried
along by ``deduplicated``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import by_text, fresh, row_key, small_batches
from codeloom.llm.components import components
from codeloom.llm.words import U, mixed, shingles
from codeloom.session import written

LEAST, SHINGLE = 0.8, 5
#: A pair with similarity 0.8 shares no bucket with probability (1 - 0.8 ** 6) ** 32 = 6e-5.
BANDS, ROWS = 32, 6
SLOTS = BANDS * ROWS
MOST_BYTES = 1 << 19
#: Points that a task makes at once.
MOST_POINTS = 150_000
#: Points that a document makes, on average, before its signature is taken to be full (19 in 20 are).
POINTS = SLOTS * (np.log(SLOTS) + 3)


def counted(hashes: np.ndarray, bounds: np.ndarray):
    """(document, shingle, occurrences) of the distinct shingles of each document, sorted."""
    hashes = hashes.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        hashes[a:b].sort()
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return doc[at], hashes[at], np.diff(np.append(at, len(hashes)))


def marked(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A number for each document that depends on its shingles and their occurrences, not on their order."""
    sums = np.concatenate([[0], np.cumsum(mixed(hashes ^ U(0x8EBC6AF09C88C6E3)), dtype=np.uint64)]).astype(np.uint64)
    return mixed(sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from random bits."""
    return ((x >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def bands_of(doc: np.ndarray, shingle: np.ndarray, times: np.ndarray):
    """The dyadic weight bands [0, 1), [1, 2), [2, 4), ... that each shingle's occurrences reach into:
    (document, key of the band's process, first weight, width, occurrences)."""
    reach = np.where(times > 1, np.ceil(np.log2(np.maximum(times, 1))).astype(np.int64) + 1, 1)
    row = np.repeat(np.arange(len(doc)), reach)
    level = np.arange(len(row)) - np.repeat(np.cumsum(reach) - reach, reach)
    width = np.where(level > 0, 2.0 ** (level - 1), 1.0)
    first = np.where(level > 0, width, 0.0)
    key = mixed(shingle[row] + level.astype(np.uint64) * U(0xA0761D6478BD642F))
    return doc[row], key, first, width, times[row]


def signatures(doc: np.ndarray, shingle: np.ndarray, times: np.ndarray, n_docs: int) -> np.ndarray:
    """One row of ``SLOTS`` numbers per document: the time of the first point (upper half) and its mark (lower half)."""
    empty = np.iinfo(np.uint64).max
    out = np.full((n_docs, SLOTS), empty)
    owner, key, first, width, most = bands_of(doc, shingle, times)
    weight = np.bincount(doc, times, n_docs)

    def add_points(live: np.ndarray, step: int, horizon: np.ndarray):
        """All points of some processes up to their documents' horizons."""
        now, number = np.zeros(len(live)), np.zeros(len(live), np.uint64)
        while len(live):
            n = number[:, None] + np.arange(1, step + 1, dtype=np.uint64)
            bits = mixed(key[live][:, None] + n * U(0x9E3779B97F4A7C15))
            time = now[:, None] + np.cumsum(-np.log(uniform(bits)), axis=1) / width[live][:, None]
            i, j = np.nonzero(time <= horizon[owner[live]][:, None])
            more = mixed(bits[i, j] ^ U(0x2545F4914F6CDD1D))
            inside = np.ones(len(i), bool)
            part = np.flatnonzero(width[live[i]] > 1)  # wider bands: which occurrence is it?
            if len(part):
                at = live[i[part]]
                place = first[at] + np.floor(uniform(mixed(more[part] + U(1))) * width[at])
                inside[part] = place < most[at]
            i, j, more = i[inside], j[inside], more[inside]
            slot = (more >> U(32)) % U(SLOTS)
            value = time[i, j].astype(np.float32).view(np.uint32).astype(np.uint64) << U(32) | (more & U(0xFFFFFFFF))
            np.minimum.at(out.reshape(-1), owner[live[i]] * SLOTS + slot.astype(np.int64), value)
            go = time[:, -1] <= horizon[owner[live]]
            now, number, live = time[go, -1], number[go] + U(step), live[go]

    stretch = 1.0
    left = np.flatnonzero(weight > 0)
    while len(left):
        horizon = np.full(n_docs, -1.0)
        horizon[left] = stretch * POINTS / weight[left]
        chosen = horizon[owner] > 0
        spread = np.maximum(horizon[owner] * width, 0)
        # entries with many points to come make them in larger steps, some entries at a time
        for low, high, step in ((-1, 1.5, 1), (1.5, 6, 4), (6, 24, 12), (24, 100, 48), (100, np.inf, 192)):
            own = np.flatnonzero(chosen & (spread > low) & (spread <= high))
            for at in range(0, len(own), MOST_POINTS // step):
                add_points(own[at:at + MOST_POINTS // step], step, horizon)
        full = (out[left] != empty).all(axis=1)
        left, stretch = left[~full], stretch * 2
    return out


def buckets(signature: np.ndarray) -> np.ndarray:
    """A key for each band of each signature."""
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + U(1), (len(signature), BANDS)).copy()
    rows = signature.reshape(len(signature), BANDS, ROWS)
    for r in range(ROWS):
        key = mixed((key ^ rows[:, :, r]) * U(0x9E3779B97F4A7C15) + U(r))
    return key.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """A row per row: its ``row_key`` (a, b, c), doc_id, weight (number of shingles), c1 and c2 (which documents with equal
    shingles have in common), and the buckets."""
    def run(batches):
        for batch in batches:
            for part in by_text(batch, "text", MOST_BYTES):
                texts = part.column("text").to_pylist()
                n = part.num_rows
                once, bounds = shingles(texts, SHINGLE)
                # two marks from hashes that have nothing in common, from the words' bytes on
                marks = [marked(once, bounds), marked(*shingles(texts, SHINGLE, seed=1))]
                doc, shingle, times = counted(once, bounds)
                sizes = np.bincount(doc, times, n).astype(np.int64)
                keys = buckets(signatures(doc, shingle, times, n))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array(sizes), pa.array(marks[0]), pa.array(marks[1]), listed],
                    names=["a", "b", "c", "doc_id", "weight", "c1", "c2", "buckets"])

    a, b, c = row_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(a.alias("a"), b.alias("b"), c.alias("c"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = rows.mapInArrow(run, "a string, b long, c int, doc_id long, weight long, c1 long, c2 long, buckets array<long>")
    blank = F.col("weight") == 0  # a class of its own
    return made.withColumns({"c1": F.when(blank, F.xxhash64("a", "b", "c")).otherwise(F.col("c1")),
                             "c2": F.when(blank, F.lit(0).cast("long")).otherwise(F.col("c2"))})


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, members) for the rows of ``docs`` whose key is in ``wanted`` (node, a, b, c): the shingles with the number of
    the occurrence, packed and sorted."""
    def run(batches):
        for batch in batches:
            for part in by_text(batch, "text", MOST_BYTES):
                doc, shingle, times = counted(*shingles(part.column("text").to_pylist(), SHINGLE))
                row = np.repeat(np.arange(len(doc)), times)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                member = np.where(nth > 0, mixed(shingle[row] + nth.astype(np.uint64) * U(0xE7037ED1A0B428DB)), shingle[row])
                bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, times, part.num_rows).astype(np.int64))])
                packed = [np.sort(member[s:e]).tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(packed, pa.binary())], names=["node", "members"])

    a, b, c = row_key(F.col("doc_id"), F.col("text"))
    texts = docs.select(a.alias("a"), b.alias("b"), c.alias("c"), "text").join(wanted, ["a", "b", "c"])
    # repeated rows give their set more than once
    return texts.select("node", "text").mapInArrow(run, "node long, members binary").groupBy("node").agg(F.first("members").alias("members"))


def linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose sets have at least this Jaccard similarity."""
    def run(batches):
        name, base = None, None
        for batch in batches:
            fine = np.zeros(batch.num_rows, bool)
            us, ours, theirs = batch.column("u").to_pylist(), batch.column("ours"), batch.column("theirs")
            for i, u in enumerate(us):
                if u != name:
                    name, base = u, np.frombuffer(ours[i].as_py(), np.uint64)
                other = np.frombuffer(theirs[i].as_py(), np.uint64)
                both = np.concatenate([base, other])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                fine[i] = common >= least * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(fine))

    theirs = pairs.join(sets.select(F.col("node").alias("v"), F.col("members").alias("theirs")), "v")
    both = theirs.join(sets.select(F.col("node").alias("u"), F.col("members").alias("ours")), "u")
    return both.select("u", "v", "ours", "theirs").mapInArrow(run, "u long, v long")


def outside(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, centre, apart, alone) for ``nodes(node, centre)``: how many of a node's shingles its centre does not have, and how many no
    other of these nodes has.

    A node sends the shingles that its centre does not have, and a centre, without its name, all of its own. A shingle that one
    node alone has sent is in no other: another node would have sent it too, or its centre would have."""
    def run(batches):
        name, base = None, None
        for batch in batches:
            found, owner = [], []
            for node, centre, ours, theirs in zip(*(batch.column(c).to_pylist() for c in ("node", "centre", "ours", "theirs")), strict=True):
                if centre != name:
                    name, base = centre, np.frombuffer(theirs, np.uint64)
                own = np.frombuffer(ours, np.uint64)
                if node != centre:
                    own = own[base[np.minimum(np.searchsorted(base, own), len(base) - 1)] != own]
                found.append(own)
                owner.append(np.full(len(own), -1 if node == centre else node))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(owner))],
                                                 names=["shingle", "node"])

    centres = nodes.select(F.col("centre").alias("node"), "centre").distinct()
    both = nodes.unionByName(centres).distinct().join(sets.select("node", F.col("members").alias("ours")), "node").join(
        sets.select(F.col("node").alias("centre"), F.col("members").alias("theirs")), "centre")
    sent = written(both.select("node", "centre", "ours", "theirs").mapInArrow(run, "shingle long, node long"), "bag-sent")
    alone = sent.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last and node >= 0")
    counts = [sent.groupBy("node").agg(F.count(F.lit(1)).alias("apart")), alone.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))]
    return nodes.join(counts[0], "node", "left").join(counts[1], "node", "left").fillna(0, ["apart", "alone"])


def groups(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``_groups``, with small batches for the jobs that run on the way."""
    with small_batches(docs.sparkSession):
        return _groups(docs, least)


def _groups(docs: DataFrame, least: float) -> DataFrame:
    """A row for each distinct row of ``docs``: its row_key (a, b, c), doc_id, copies (rows of this key), group_id (the id of
    its group's kept document) and chosen (whether it is that document)."""
    rows = written(signed(docs), "bag-signatures")
    # node: written once, so that the numbers stay
    classes = written(rows.groupBy("c1", "c2").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "b", "a", "c")).alias("rep"),
        F.first("weight").alias("weight"), F.first("buckets").alias("buckets"), F.count(F.lit(1)).alias("rows"))
        .withColumn("node", F.monotonically_increasing_id()), "bag-classes")
    entries = classes.where("weight > 0").select("node", "weight", "rows", F.explode("buckets").alias("bucket"))
    # a bucket's centre is the class of most copies, as it is the likeliest origin of the others
    shared = entries.groupBy("bucket").agg(F.max(F.struct("rows", "node", "weight")).alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # written, so that the joins on buckets have plain exchanges and split very full ones
    shared = written(shared.select("bucket", F.col("centre.node").alias("u"), F.col("centre.weight").alias("w")), "bag-buckets")
    members = written(entries.join(shared, "bucket").select("bucket", "node", "weight", "u", "w"), "bag-members")
    near = F.least("weight", "w") >= least * F.greatest("weight", "w") - 1e-6
    tried = written(members.where((F.col("node") != F.col("u")) & near).select("u", F.col("node").alias("v")).distinct(), "bag-pairs")
    wanted = (members.select("node").distinct().join(classes.select("node", "rep.a", "rep.b", "rep.c"), "node"))
    sets = written(shingle_sets(docs, wanted), "bag-sets")
    links = written(linked(tried, sets, least), "bag-links")

    named = written(components(links).withColumnRenamed("component", "root"), "bag-named")

    def merged(named: DataFrame, more: DataFrame) -> DataFrame:
        """The groups with further links: only the groups that these touch are looked at."""
        roots = [named.withColumnsRenamed({"node": c, "root": f"root_{c}"}) for c in "uv"]
        ends = more.join(roots[0], "u", "left").join(roots[1], "v", "left").select(
            F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
        onto = written(components(written(ends.distinct(), "bag-joined")), "bag-onto")
        new = onto.withColumnsRenamed({"node": "root", "component": "further"})
        moved = named.join(new, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        # nodes that had no link before
        first = onto.join(named, "node", "left_anti").select("node", F.col("component").alias("root"))
        return written(moved.unionByName(first), "bag-named")

    # the members of buckets that hold more than one group, with the group as root
    rooted = written(members.join(named, "node", "left").withColumn("root", F.coalesce("root", "node")), "bag-rooted")
    split = written(rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"))
                    .where("low < high").select("bucket"), "bag-split")
    rest = written(rooted.join(split, "bucket").select("bucket", "node", "weight", "u", "root"), "bag-rest")
    centred = rest.groupBy("node").agg(F.min("u").alias("centre"))
    centres = centred.select(F.col("centre").alias("node"), F.lit(True).alias("was_centre")).distinct()
    alone = written(outside(centred, sets).join(centres, "node", "left").fillna(False, ["was_centre"]), "bag-alone")
    rest = written(rest.join(alone.drop("centre", "apart"), "node").drop("u"), "bag-rest")
    # each bucket's most typical member, not the centre of before: that with the smallest share of shingles of its own. With
    # these as centres it shows what each text has alone, those that were centres included
    typical = written(rest.groupBy("bucket").agg(F.min(F.struct(
        "was_centre", (F.col("alone") / F.col("weight")).alias("share"), "node")).alias("best")), "bag-typical")
    centred = rest.join(typical, "bucket").groupBy("node").agg(F.min("best").alias("best")).select("node", F.col("best.node").alias("centre"))
    rest = written(rest.select("bucket", "node", "weight", "root").join(written(outside(centred, sets), "bag-alone"), "node").join(
        classes.select("node", F.col("buckets").alias("bands")), "node"), "bag-rest")

    # what is still apart, all with all. A pair that is similar enough has so many shingles in common; those that a text has
    # alone can't be among them
    common = least / (1 + least) * (F.col("weight") + F.col("w")) - 1e-6
    able = near & (F.col("weight") - F.col("alone") >= common) & (F.col("w") - F.col("other_alone") >= common)
    other = rest.select("bucket", F.col("node").alias("u"), F.col("weight").alias("w"), F.col("alone").alias("other_alone"),
                        F.col("root").alias("far"), F.col("centre").alias("other_centre"), F.col("apart").alias("other_apart"), F.col("bands").alias("other_bands"))
    # with one centre, two nodes can share what both have of it, and what both have apart from it and not alone
    shared = F.least(F.col("weight") - F.col("apart"), F.col("w") - F.col("other_apart")) + F.least(
        F.col("apart") - F.col("alone"), F.col("other_apart") - F.col("other_alone"))
    # and two nodes meet in the first of the buckets that they share
    meets = F.element_at("bands", F.array_position(F.zip_with("bands", "other_bands", lambda a, b: a == b), True).cast("int")) == F.col("bucket")
    able = able & meets & ((F.col("centre") != F.col("other_centre")) | (shared >= common))
    ordered = [F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")]
    crossing = written(rest.join(other, "bucket").where((F.col("root") < F.col("far")) & able).select(*ordered).distinct()
                    .join(tried, ["u", "v"], "left_anti"), "bag-pairs")
    found = written(linked(crossing, sets, least), "bag-links")
    if found.limit(1).count():
        named = merged(named, found)

    final = named.withColumnRenamed("root", "component")
    placed = classes.select("c1", "c2", "rep", "node").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = written(placed, "bag-placed")
    best = placed.groupBy("component").agg(F.min("rep").alias("best"))
    chosen = written(placed.join(best, "component").select("c1", "c2", "best"), "bag-chosen")
    keyed = rows.groupBy("a", "b", "c").agg(F.first("doc_id").alias("doc_id"), F.first("c1").alias("c1"), F.first("c2").alias("c2"),
                                            F.count(F.lit(1)).alias("copies"))
    this = F.struct("b", "a", "c") == F.struct("best.b", "best.a", "best.c")
    return keyed.join(chosen, ["c1", "c2"]).select("a", "b", "c", "doc_id", "copies", F.col("best.doc_id").alias("group_id"),
                                                   this.alias("chosen"))


def labelled(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """A row per row of ``docs``: doc_id, group_id, kept."""
    rows = groups(docs, least).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select("doc_id", "group_id", (F.col("chosen") & (F.col("copy") == 1)).alias("kept"))


def deduplicated(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The kept rows of ``docs``, with its columns."""
    names = [fresh(docs, n) for n in ("bag_a", "bag_b", "bag_c")]
    keyed = docs
    for name, column in zip(names, row_key(docs["doc_id"], docs["text"]), strict=True):
        keyed = keyed.withColumn(name, column)
    kept = groups(docs, least).where("chosen").select(*(F.col(o).alias(n) for o, n in zip("abc", names, strict=True)))
    return keyed.join(kept, names).dropDuplicates(names).select(*docs.columns)


#: All pairs, for small tables; the ids of documents must tell them apart.
SQL = r"""
with recursive w as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
words as (select doc_id, len(ws) as n, unnest(ws) as word, generate_subscripts(ws, 1) as j from w),
wide as (select doc_id, n, j, array_to_string(list(word) over (partition by doc_id order by j rows between current row and 4 following), ' ') as s
  from words),
bag as materialized (select doc_id, hash(s) as s, count(*) as c from wide where j <= n - 4 or j = 1 group by all),
size as materialized (select doc_id, sum(c) as n from bag group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, sum(least(a.c, b.c)) as i from bag a join bag b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as materialized (select a, b from common join size x on x.doc_id = a join size y on y.doc_id = b where i >= 0.8 * (x.n + y.n - i)),
both_ways as (select a, b from link union all select b, a from link),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join both_ways l on l.a = r.b)
select a as doc_id, min(b) as group_id, min(b) = a as kept from reach group by a
"""
