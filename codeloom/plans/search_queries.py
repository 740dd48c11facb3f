"""Registered queries: full-text search over the documents."""

from functools import lru_cache

from pyspark.sql import functions as F

from codeloom.functions import porter
from codeloom.operators import search
from codeloom.plans.graph_view import doc_nodes, table
from codeloom.plans.registry import query
from codeloom.plans.sql_view import DOCS, with_docs
from codeloom.session import files_state, scratch_path
from codeloom.sources.store import GraphStore

WORDS = """, texts AS (SELECT id, 'name' AS col, name AS text FROM docs UNION ALL
  SELECT id, 'qualified_name', qualified_name FROM docs UNION ALL SELECT id, 'summary', summary FROM docs),
words AS MATERIALIZED (
  SELECT id, col, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS ws FROM texts),
plain AS MATERIALIZED (SELECT id, col, unnest(ws) AS t, generate_subscripts(ws, 1) AS pos FROM words),
l AS MATERIALIZED (SELECT id, sum(len(ws)) AS dl FROM words GROUP BY id),
s AS MATERIALIZED (SELECT count(*) AS n, avg(dl) AS mean FROM l)"""
AS_THEY_ARE = ", tok AS MATERIALIZED (SELECT * FROM plain)"


def _shape(e: str) -> str:
    """Vowels as 1 and consonants as 0; y counts by what stands before it."""
    return (f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({e}, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g'), "
            f"'[aeiouy]', '1', 'g'), '[^1]', '0', 'g')")


def _measure(e: str) -> str:
    return f"len(regexp_extract_all({_shape(e)}, '1+0+'))"


def _vowel(e: str) -> str:
    return f"contains({_shape(e)}, '1')"


def _cvc(e: str) -> str:
    return f"(suffix({_shape(e)}, '010') AND NOT regexp_matches({e}, '[wxy]$'))"


def _longest(rules: list[tuple[str, str]], extra=lambda s: "true", least: int = 0) -> str:
    """The rule of the longest suffix that fits, as a CASE."""
    cases = []
    for old, new in sorted(rules, key=lambda r: -len(r[0])):
        part = f"left(w, -{len(old)})"
        cases.append(f"WHEN suffix(w, '{old}') THEN CASE WHEN {_measure(part)} > {least} AND {extra(old)} THEN {part} || '{new}' ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


def _stemmed() -> str:
    """The steps of the stemmer over the distinct words, one table each."""
    steps = [
        "CASE WHEN suffix(w, 'sses') AND len(w) > 4 OR suffix(w, 'ies') AND len(w) > 3 THEN left(w, -2) "
        "WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN left(w, -1) ELSE w END",
        f"""CASE WHEN suffix(w, 'eed') THEN CASE WHEN {_measure("left(w, -3)")} > 0 THEN left(w, -1) ELSE w END
        WHEN suffix(w, 'ed') AND {_vowel("left(w, -2)")} THEN '#' || left(w, -2)
        WHEN suffix(w, 'ing') AND {_vowel("left(w, -3)")} THEN '#' || left(w, -3) ELSE w END""",
        # a mark shows that an ending went
        f"""CASE WHEN w NOT LIKE '#%' THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w[2:] || 'e'
        WHEN len(w) > 2 AND right(w, 1) = left(right(w, 2), 1) AND NOT regexp_matches(w, '[aeioulsz]$') THEN w[2:-2]
        WHEN {_measure("w[2:]")} = 1 AND {_cvc("w[2:]")} THEN w[2:] || 'e' ELSE w[2:] END""",
        f"""CASE WHEN suffix(w, 'y') AND {_vowel("left(w, -1)")} THEN left(w, -1) || 'i' ELSE w END""",
        _longest(porter.STEP2), _longest(porter.STEP3),
        _longest([(s, "") for s in porter.STEP4], lambda s: "regexp_matches(w, '[st]ion$')" if s == "ion" else "true", least=1),
        f"""CASE WHEN suffix(w, 'e') AND ({_measure("left(w, -1)")} > 1 OR {_measure("left(w, -1)")} = 1 AND NOT {_cvc("left(w, -1)")})
        THEN left(w, -1) ELSE w END""",
        f"CASE WHEN suffix(w, 'll') AND {_measure('w')} > 1 THEN left(w, -1) ELSE w END",
    ]
    tables = ["e0 AS MATERIALIZED (SELECT DISTINCT t, t AS w FROM plain)"]
    for i, step in enumerate(steps):
        tables.append(f"e{i + 1} AS MATERIALIZED (SELECT t, CASE WHEN len(t) < 3 OR octet_length(encode(t)) > 64 THEN t ELSE {step} END AS w FROM e{i})")
    return f", {', '.join(tables)}, tok AS MATERIALIZED (SELECT id, col, w AS t, pos FROM plain JOIN e{len(steps)} USING (t))"


def _sql(phrases: list[str], match: str, scored: list[int] | None = None, where: str = "", top: int | None = None,
         only: dict[int, str] | None = None, near: int | None = None, words: str = AS_THEY_ARE) -> str:
    """BM25 over all text columns. ``phrases``: a few words each; a word that ends in * is a prefix. ``only``: a condition
    on a phrase's first word; ``near``: the two phrases, of one word each, must stand so close."""
    ctes, joins, terms = [], [], []
    for i, text in enumerate(phrases):
        parts = text.split()
        test = " AND ".join(
            (f"w{k}.t LIKE '{w[:-1]}%'" if w.endswith("*") else f"w{k}.t = '{w}'") for k, w in enumerate(parts))
        tables = " ".join(
            f"{'FROM' if k == 0 else 'JOIN'} tok w{k}"
            + (f" ON w{k}.id = w0.id AND w{k}.col = w0.col AND w{k}.pos = w0.pos + {k}" if k else "") for k in range(len(parts)))
        extra = f" AND {only[i]}" if only and i in only else ""
        close = f"""AND EXISTS (SELECT 1 FROM tok o WHERE o.id = w0.id AND o.col = w0.col AND o.t = '{phrases[1 - i]}'
            AND abs(o.pos - w0.pos) <= {near} + 1)""" if near is not None else ""
        ctes.append(f"h{i} AS MATERIALIZED (SELECT count(DISTINCT w0.id) AS n {tables} WHERE {test}{extra})")
        ctes.append(f"p{i} AS MATERIALIZED (SELECT w0.id, count(*) AS tf {tables} WHERE {test}{extra} {close} GROUP BY w0.id)")
        joins.append(f"LEFT JOIN p{i} ON p{i}.id = d.id")
        if scored is None or i in scored:
            idf = f"ln((s.n - (SELECT n FROM h{i}) + 0.5) / ((SELECT n FROM h{i}) + 0.5))"
            terms.append(f"""coalesce((CASE WHEN {idf} <= 0 THEN 1e-6 ELSE {idf} END) * p{i}.tf * 2.2
              / (p{i}.tf + 1.2 * (0.25 + 0.75 * l.dl / s.mean)), 0)""")
    for i in range(len(phrases)):
        match = match.replace(f"[{i}]", f"(p{i}.tf IS NOT NULL)")
    tail = f"ORDER BY rank, qualified_name LIMIT {top}" if top else ""
    return with_docs(f"""{WORDS}{words},
{', '.join(ctes)}
SELECT qualified_name, round(rank, 6) AS rank FROM (
  SELECT d.qualified_name, -({' + '.join(terms)}) AS rank
  FROM docs d JOIN l ON l.id = d.id CROSS JOIN s {' '.join(joins)} WHERE ({match}) {where} {tail})""")


@lru_cache(4)
def _index(spark, app: str, sf_dir: str, stemmed: bool, state: tuple):
    """(postings, lengths) over all text columns, written once per state of the input's files; later queries read the
    pages of their words."""
    path = scratch_path(spark, "word-index")
    search.write_index(doc_nodes(spark, sf_dir), path, stemmed=stemmed)
    return search.open_index(spark, path, "postings"), search.open_index(spark, path, "lengths")


def _search(spark, sf_dir, text, kind=None, limit=None, stemmed=False):
    state = files_state(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet")
    index = _index(spark, spark.sparkContext.applicationId, sf_dir, stemmed, state)
    found = search.search_index(*index, text, stemmed=stemmed)
    rows = search.ranked(doc_nodes(spark, sf_dir), found, kind, limit)
    return rows.select("qualified_name", F.round("rank", 6).alias("rank"))


@query("bm25_term", _sql(["thtion"], "[0]"))
def bm25_term(spark, sf_dir):
    return _search(spark, sf_dir, "thtion")


@query("bm25_top", _sql(["the", "tion"], "[0] OR [1]", top=20))
def bm25_top(spark, sf_dir):
    return _search(spark, sf_dir, "the OR tion", limit=20)


@query("bm25_and", _sql(["and", "with", "by"], "[0] AND [1] AND [2]"))
def bm25_and(spark, sf_dir):
    return _search(spark, sf_dir, "and with AND by")


@query("bm25_not", _sql(["the", "with"], "[0] AND NOT [1]", scored=[0]))
def bm25_not(spark, sf_dir):
    return _search(spark, sf_dir, "the NOT with")


@query("bm25_kind_filter", _sql(["la", "en"], "[0] OR [1]", where="AND d.kind = 'class'", top=50))
def bm25_kind_filter(spark, sf_dir):
    return _search(spark, sf_dir, "la OR en", kind="class", limit=50)


@query("phrase_search", _sql(["of the"], "[0]"))
def phrase_search(spark, sf_dir):
    return _search(spark, sf_dir, '"of the"')


@query("prefix_search", _sql(["thr*"], "[0]"))
def prefix_search(spark, sf_dir):
    return _search(spark, sf_dir, "thr*")


@query("near_search", _sql(["with", "that"], "[0] AND [1]", near=4))
def near_search(spark, sf_dir):
    return _search(spark, sf_dir, "NEAR(with that, 4)")


@query("column_search", _sql(["the", "doc"], "[0] AND [1]", only={0: "w0.col IN ('name')", 1: "w0.col IN ('name', 'qualified_name')"}))
def column_search(spark, sf_dir):
    return _search(spark, sf_dir, "name : the AND {name qualified_name} : doc")


@query("start_search", _sql(["the", "of"], "[0] AND [1]", only={0: "w0.pos = 1"}))
def start_search(spark, sf_dir):
    return _search(spark, sf_dir, "^the AND of")


@query("search_scan", _sql(["erth", "der die"], "[0] OR [1]"))
def search_scan(spark, sf_dir):
    """Without an index: each text is read once and nothing is shuffled."""
    rows = search.search(doc_nodes(spark, sf_dir), 'erth OR "der die"', limit=None, stemmed=False)
    return rows.select("qualified_name", F.round("rank", 6).alias("rank"))


@query("porter_search", _sql([porter.stem("thing"), porter.stem("thed"), porter.stem("relation")], "[0] OR [1] OR [2]", words=_stemmed()))
def porter_search(spark, sf_dir):
    return _search(spark, sf_dir, "thing OR thed OR relation", stemmed=True)


# Some documents go, some get another summary, some new ones come.
LATER = DOCS.replace("\ndocs AS (", "\nall_docs AS (") + """, docs AS (
  SELECT id, kind, name, qualified_name, CASE WHEN id % 20 = 7 THEN 'A thing said first. ' || summary ELSE summary END AS summary
  FROM all_docs WHERE id % 20 <> 3
  UNION ALL SELECT id + 1000000000000, kind, name, 'new' || qualified_name, 'A relation of things: ' || name FROM all_docs WHERE id % 20 = 11)"""


def _later(docs):
    number = F.col("id") % 20
    summary = F.when(number == 7, F.concat(F.lit("A thing said first. "), "summary")).otherwise(F.col("summary"))
    new = docs.where(number == 11).withColumns({
        "id": F.col("id") + 10**12, "qualified_name": F.concat(F.lit("new"), "qualified_name"),
        "summary": F.concat(F.lit("A relation of things: "), "name")})
    return docs.where(number != 3).withColumn("summary", summary).unionByName(new)


STORED = [porter.stem("thing"), porter.stem("thed"), porter.stem("relation")]


def _stored(spark, sf_dir, version):
    """The documents in a store, indexed and changed: the second version's index goes on from the first one's."""
    store = GraphStore(spark, scratch_path(spark, "store"))
    docs = doc_nodes(spark, sf_dir)
    store.commit(docs)
    if version == 2:
        store.words().state(store.entry())
        store.commit(_later(docs))
    rows = store.search("thing OR thed OR relation", limit=None)
    return rows.select("qualified_name", F.round("rank", 6).alias("rank"))


@query("stored_search", _sql(STORED, "[0] OR [1] OR [2]", words=_stemmed()))
def stored_search(spark, sf_dir):
    return _stored(spark, sf_dir, 1)


@query("stored_search_changed", _sql(STORED, "[0] OR [1] OR [2]", words=_stemmed()).replace(DOCS, LATER))
def stored_search_changed(spark, sf_dir):
    return _stored(spark, sf_dir, 2)


@query("stems", with_docs(WORDS + _stemmed() + " SELECT DISTINCT p.t AS word, e9.w AS stem FROM plain p JOIN e9 USING (t)"))
def stems(spark, sf_dir):
    """Every distinct word with its stem."""
    texts = search.index_texts(doc_nodes(spark, sf_dir), stemmed=False)
    words = texts.select(F.explode("words").alias("word")).distinct()
    return words.select("word", porter.stem_tokens(F.array("word"))[0].alias("stem"))


@query("word_counts", """
SELECT lang, word, count(*) AS occurrences, count(DISTINCT doc_id) AS docs FROM (
  SELECT doc_id, lang, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')) AS word FROM documents)
GROUP BY lang, word""")
def word_counts(spark, sf_dir):
    """The vocabulary by language: counted per document first, so a frequent word shuffles one row per document."""
    from codeloom.functions.text import tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(tokens(F.col("text"))).alias("word"))
    return docs.groupBy("lang", "word", "doc_id").agg(F.count(F.lit(1)).alias("tf")).groupBy("lang", "word").agg(
        F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("docs"))
