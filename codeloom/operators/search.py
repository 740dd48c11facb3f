"""Full-text search over node text with BM25 ranks.

``search`` reads each text once, keeps the places of the few words it asks for and shuffles nothing.
``GraphStore`` keeps an index ``postings(term, id, col, pos)`` sorted by term in each file (``sources.wordindex``); ``search_index``
then reads only the pages of its terms.

A query is built from ``term``, ``phrase``, ``prefix`` and ``near`` with ``&``, ``|`` and ``-`` (and not);
``parse`` reads the usual text form of it.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.porter import stem, stem_tokens
from codeloom.functions.text import _accents, tokens
from codeloom.operators.joins import spread
from codeloom.session import shared_dir

TEXT_COLUMNS = ["name", "qualified_name", "summary"]
# BM25 constants, and the floor of the inverse document frequency.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


# ---- index ------------------------------------------------------------------------------------------------------

def node_words(nodes: DataFrame, columns: list[str] | None = None, stemmed: bool = True, least: int = 1) -> DataFrame:
    """(id, words): per node an array of (col, words), the words of each text column, in at least so many partitions."""
    columns = columns or [c for c in TEXT_COLUMNS if c in nodes.columns]

    def words(c: str) -> Column:
        return stem_tokens(tokens(F.col(c))) if stemmed else tokens(F.col(c))

    split = [F.struct(F.lit(c).alias("col"), words(c).alias("words")) for c in columns]
    return spread(nodes.select("id", *columns), least=least).select("id", F.array(*split).alias("words"))


def index_texts(nodes: DataFrame, columns: list[str] | None = None, stemmed: bool = True, least: int = 1) -> DataFrame:
    """(id, col, words): one row per node and text column."""
    return node_words(nodes, columns, stemmed, least).select("id", F.explode("words").alias("t")).select(
        "id", "t.col", "t.words")


def postings(texts: DataFrame) -> DataFrame:
    """(term, id, col, pos): one row per occurrence."""
    return texts.select("id", "col", F.posexplode("words").alias("pos", "term"))


def lengths(texts: DataFrame) -> DataFrame:
    """(id, dl): words per node over all columns; nodes without words have a row too."""
    return texts.groupBy("id").agg(F.sum(F.size("words")).alias("dl"))


#: Nodes whose words one task sorts.
SORTED_NODES = 8_000
INDEX = {"postings": "term STRING, id BIGINT, col STRING, pos INT", "lengths": "id BIGINT, dl BIGINT"}


def write_index(nodes: DataFrame, path: str, columns: list[str] | None = None, stemmed: bool = True) -> None:
    """``postings`` and ``lengths`` of the nodes. Each task sorts and writes the words of its own nodes, so only the texts are shuffled; a
    frequent word lies in all files, in a few pages of each. The lengths are counted in the written files, where a node's words lie together."""
    texts = index_texts(nodes, columns, stemmed, least=-(-nodes.count() // SORTED_NODES))
    postings(texts).select("term", "id", "col", "pos").sortWithinPartitions("term", "id").write.parquet(f"{path}/postings")
    counted = open_index(nodes.sparkSession, path, "postings").groupBy("id").agg(F.count(F.lit(1)).alias("dl"))
    ids = nodes.select("id").distinct()
    ids.join(counted, "id", "left").select("id", F.coalesce("dl", F.lit(0).cast("long")).alias("dl")).write.parquet(f"{path}/lengths")


def open_index(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``postings`` or ``lengths`` of a written index."""
    return spark.read.schema(INDEX[name]).parquet(f"{path}/{name}")


# ---- queries ----------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Phrase:
    """Words in a row. ``prefix``: the last word may go on. ``columns``: only in these; ``start``: at the start."""

    words: tuple[str, ...]
    prefix: bool = False
    columns: tuple[str, ...] = ()
    start: bool = False

    def __and__(self, other):
        return Query("and", (self, other))

    def __or__(self, other):
        return Query("or", (self, other))

    def __sub__(self, other):
        return Query("not", (self, other))


@dataclass(frozen=True)
class Query:
    op: str
    parts: tuple = field(default_factory=tuple)
    distance: int = 10

    __and__, __or__, __sub__ = Phrase.__and__, Phrase.__or__, Phrase.__sub__


def _words(text: str) -> tuple[str, ...]:
    marked, plain = _accents()
    text = text.lower().translate(str.maketrans(marked, plain))
    return tuple(re.findall(r"[^\W_]+", text))


def term(text: str) -> Phrase:
    return Phrase(_words(text))


phrase = term


def prefix(text: str) -> Phrase:
    return Phrase(_words(text), prefix=True)


def near(*phrases: Phrase, distance: int = 10) -> Query:
    return Query("near", tuple(phrases), distance)


def within(query, *columns: str):
    """The query with all its phrases restricted to ``columns``."""
    if isinstance(query, Phrase):
        kept = tuple(c for c in columns if not query.columns or c in query.columns)
        return replace(query, columns=kept)
    return replace(query, parts=tuple(within(p, *columns) for p in query.parts))


_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([A-Za-z0-9_\u0080-\U0010ffff]+)|(.))', re.S)


def parse(text: str):
    """Read a query such as ``name: order* AND (total OR "net price") NOT draft``.

    Words that stand side by side must all occur. Raises ValueError for what is no query.
    """
    items = [m.groups() for m in _LEX.finditer(text.strip())]

    def peek(i=0):
        return items[i] if i < len(items) else (None, None, None)

    def fail():
        raise ValueError(f"no search query: {text!r}")

    def symbol(s):
        if peek()[2] == s:
            items.pop(0)
            return True
        return False

    def one_phrase():
        start = symbol("^")
        words: tuple[str, ...] = ()
        while True:
            quoted, bare, _ = peek()
            if quoted is None and (bare is None or bare in ("AND", "OR", "NOT")):
                fail()
            items.pop(0)
            words += _words(quoted if quoted is not None else bare)
            if not symbol("+"):
                break
        return Phrase(words, prefix=symbol("*"), start=start)

    def atom():
        if symbol("("):
            inner = level(0)
            return inner if symbol(")") else fail()
        if peek()[1] == "NEAR" and peek(1)[2] == "(":
            del items[:2]
            phrases, distance = [one_phrase()], 10
            while not symbol(")"):
                if symbol(","):
                    distance = int(items.pop(0)[1] or fail())
                elif peek() == (None, None, None):
                    fail()
                else:
                    phrases.append(one_phrase())
            return near(*phrases, distance=distance)
        if symbol("{"):
            names = []
            while not symbol("}"):
                names.append((items.pop(0)[1] if items else None) or fail())
            return within(atom(), *names) if symbol(":") else fail()
        if (peek()[1] or peek()[0]) and peek(1)[2] == ":":
            name = items[0][1] or items[0][0]
            del items[:2]
            if name not in TEXT_COLUMNS:
                fail()
            return within(atom(), name)
        return one_phrase()

    def level(n):
        # 0: OR, 1: AND, 2: NOT, 3: side by side
        if n == 3:
            found = atom()
            while any(peek()[:2]) and peek()[1] not in ("AND", "OR", "NOT") or peek()[2] in ("(", "{", "^"):
                found = found & atom()
            return found
        word, join = (("OR", "__or__"), ("AND", "__and__"), ("NOT", "__sub__"))[n]
        found = level(n + 1)
        while peek()[1] == word:
            items.pop(0)
            found = getattr(found, join)(level(n + 1))
        return found

    if not items:
        fail()
    query = level(0)
    return query if not items else fail()


def phrases_of(query) -> list[Phrase]:
    if isinstance(query, Phrase):
        return [query] if query.words else []
    return [p for part in query.parts for p in phrases_of(part)]


# ---- search -----------------------------------------------------------------------------------------------------

def _asked(word: Column, phrases: list[Phrase]) -> Column:
    """Whether a word of the index is one that the phrases ask for."""
    cond = F.lit(False)
    for p in phrases:
        exact = p.words[:-1] if p.prefix else p.words
        if exact:
            cond = cond | word.isin(*exact)
        if p.prefix:
            cond = cond | F.startswith(word, F.lit(p.words[-1]))
    return cond


def _wanted(phrases: list[Phrase], stemmed: bool) -> tuple[list[Phrase], Column]:
    """The phrases as they are in the index, and the filter of postings that they need. The index
    holds stems, so the words of a query are stemmed too, that of a prefix included."""
    done = [replace(p, words=tuple(stem(w) for w in p.words)) if stemmed else p for p in phrases]
    return done, _asked(F.col("term"), done)


def _places(p: Phrase) -> Column:
    """Array of (col, pos) where the phrase starts in a node, from the node's array ``hits(term, col, pos)``."""
    def matches(hit: Column, word: str, is_last: bool) -> Column:
        return F.startswith(hit["term"], F.lit(word)) if (p.prefix and is_last) else (hit["term"] == word)

    def found(i: int) -> Column:
        word, is_last = p.words[i], i == len(p.words) - 1
        rows = F.filter("hits", lambda h: matches(h, word, is_last))
        return F.transform(rows, lambda h: F.struct(h["col"].alias("col"), (h["pos"] - i).alias("pos")))

    places = found(0)
    for i in range(1, len(p.words)):
        places = F.array_intersect(places, found(i))
    if p.columns:
        places = F.filter(places, lambda h: h["col"].isin(*p.columns))
    if p.start:
        places = F.filter(places, lambda h: h["pos"] == 0)
    return places


def _nears(query) -> list[Query]:
    if isinstance(query, Phrase):
        return []
    return [query] if query.op == "near" else [n for part in query.parts for n in _nears(part)]


def _in_clumps(query: Query, number: dict[int, str]) -> dict[str, Column]:
    """For each phrase of a NEAR, those of its places that are in a clump. A clump has all phrases in one column, none of
    them ending more than the distance before the start of the last one."""
    def reaches(phrase: Phrase, place: Column, last: Column) -> Column:
        return (place["col"] == last["col"]) & (place["pos"] <= last["pos"]) & (
            place["pos"] >= last["pos"] - len(phrase.words) - query.distance)

    def has(phrase: Phrase, last: Column) -> Column:
        return F.exists(number[id(phrase)], lambda place: reaches(phrase, place, last))

    anywhere = F.concat(*[F.col(number[id(p)]) for p in query.parts])
    lasts = F.filter(anywhere, lambda last: reduce(and_, [has(p, last) for p in query.parts]))

    def kept(phrase: Phrase) -> Column:
        # the array around ``lasts`` has it found once per node, not once per place
        return F.transform(F.array(lasts), lambda found: F.filter(
            number[id(phrase)], lambda place: F.exists(found, lambda last: reaches(phrase, place, last))))[0]

    return {number[id(p)]: kept(p) for p in query.parts}


def _holds(query, number: dict[int, str]) -> Column:
    """Whether a node matches, from its columns of phrase places."""
    if isinstance(query, Phrase):
        return F.size(number[id(query)]) > 0 if query.words else F.lit(False)
    if query.op == "near":
        return reduce(and_, [F.size(number[id(p)]) > 0 for p in query.parts])
    parts = [_holds(p, number) for p in query.parts]
    if query.op == "not":
        return parts[0] & ~parts[1]
    out = parts[0]
    for part in parts[1:]:
        out = (out & part) if query.op == "and" else (out | part)
    return out


def _scored(query) -> list[Phrase]:
    """Phrases that add to the rank: not those behind a NOT, which cannot occur in a result as a whole."""
    if isinstance(query, Phrase):
        return [query] if query.words else []
    parts = query.parts[:1] if query.op == "not" else query.parts
    return [p for part in parts for p in _scored(part)]


def _prepare(query, stemmed: bool):
    """Query, its phrases as they are in the index, the filter of words, and the column of each phrase."""
    if isinstance(query, str):
        query = parse(query)
    plain = phrases_of(query)
    indexed, cond = _wanted(plain, stemmed)
    return query, indexed, cond, {id(p): f"p{i}" for i, p in enumerate(plain)}


def _match(hits: DataFrame, query, indexed, number, *totals: Column) -> tuple[DataFrame, dict]:
    """Matching rows of ``hits(id, dl, hits)`` as (id, dl, count of each phrase), and the numbers of rows per
    phrase and ``totals`` of all rows, all in one pass."""
    columns = [f"p{i}" for i in range(len(indexed))]
    places = hits.select("id", "dl", *[_places(p).alias(c) for c, p in zip(columns, indexed, strict=True)])
    seen = Observation()
    shared_dir(hits.sparkSession)
    # The weight of a phrase comes from all rows that have it; a NEAR then keeps only what is in its clumps.
    counted = places.observe(seen, *[F.count_if(F.size(c) > 0).alias(c) for c in columns], *totals)
    for found in _nears(query):
        counted = counted.withColumns(_in_clumps(found, number))
    matched = (
        counted.where(_holds(query, number)).select("id", "dl", *[F.size(c).alias(c) for c in columns]).checkpoint()
    )
    return matched, seen.get


def _bm25(matched: DataFrame, query, number, having: dict, n: int, words: int) -> DataFrame:
    if not n or not words:
        return matched.select("id", F.lit(0.0).alias("rank"))
    score = F.lit(0.0)
    for c in [number[id(p)] for p in _scored(query)]:
        idf = math.log((n - having[c] + 0.5) / (having[c] + 0.5))
        tf = F.col(c).cast("double")
        long = K1 * (1 - B + B * F.col("dl") / (words / n))
        score = score + (idf if idf > 0 else IDF_FLOOR) * tf * (K1 + 1) / (tf + long)
    return matched.select("id", (-score).alias("rank"))


def search_index(
    occurrences: DataFrame, doc_lengths: DataFrame, query, stemmed: bool = True, totals: tuple[int, int] | None = None,
) -> DataFrame:
    """(id, rank) of all nodes that match, from a written index; the better, the lower the rank. ``totals``: the numbers of
    nodes and words, counted unless given.

    The words asked for are filtered before anything is shuffled, and one node's hits are no more
    than the occurrences of those words in its own text.
    """
    query, indexed, cond, number = _prepare(query, stemmed)
    if not indexed:
        return doc_lengths.select("id", F.lit(0.0).alias("rank")).where(F.lit(False))
    hits = occurrences.where(cond).groupBy("id").agg(F.collect_list(F.struct("term", "col", "pos")).alias("hits"))
    matched, having = _match(hits.join(doc_lengths, "id"), query, indexed, number)
    n, words = totals or doc_lengths.agg(F.count(F.lit(1)), F.sum("dl")).first()
    return _bm25(matched, query, number, having, n, words)


def search_texts(texts: DataFrame, query, stemmed: bool = True) -> DataFrame:
    """The same from ``texts(id, words array of (col, words))`` without an index: one pass, no shuffle."""
    query, indexed, cond, number = _prepare(query, stemmed)
    if not indexed:
        return texts.select("id", F.lit(0.0).alias("rank")).where(F.lit(False))
    hits = F.flatten(F.transform("words", lambda t: F.filter(
        F.transform(t["words"], lambda w, i: F.struct(w.alias("term"), t["col"].alias("col"), i.alias("pos"))),
        lambda h: _asked(h["term"], indexed))))
    dl = F.aggregate("words", F.lit(0), lambda a, t: a + F.size(t["words"]))
    matched, seen = _match(
        texts.select("id", dl.alias("dl"), hits.alias("hits")), query, indexed, number,
        F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words"))
    return _bm25(matched, query, number, seen, seen["n"], seen["words"])


def search(
    nodes: DataFrame, query, kind: str | None = None, limit: int | None = 20,
    columns: list[str] | None = None, stemmed: bool = True,
) -> DataFrame:
    """The best matching nodes with their ``rank``, best first; ties by qualified name."""
    return ranked(nodes, search_texts(node_words(nodes, columns, stemmed), query, stemmed), kind, limit)


def ranked(nodes: DataFrame, found: DataFrame, kind: str | None = None, limit: int | None = 20) -> DataFrame:
    """Search results joined to their nodes."""
    if kind is not None:
        nodes = nodes.where(F.col("kind") == kind)
    rows = nodes.join(found, "id")
    return rows if limit is None else rows.orderBy("rank", "qualified_name").limit(limit)
