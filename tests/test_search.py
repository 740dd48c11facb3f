import random
import sqlite3

import pytest

from codeloom.operators import search

WORDS = ("order orders user users validate validation service services total totals price calculate calculation "
         "the of handler handling connect connection naïve data model relational").split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice(WORDS) + "_" + rng.choice(WORDS), f"mod.{rng.choice(WORDS)}::N{i}",
             " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 25)))) for i in range(1, 60)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(name, qualified_name, summary, tokenize='porter')")
    con.executemany("insert into f(rowid, name, qualified_name, summary) values (?, ?, ?, ?)", rows)
    nodes = spark.createDataFrame(rows, "id BIGINT, name STRING, qualified_name STRING, summary STRING")
    texts = search.node_words(nodes).persist()
    return con, nodes, texts


@pytest.mark.parametrize("text", [
    "order", "user OR price", "order AND user", "order user total", "the NOT user", '"total price"', "valid*",
    "name : order", "calculate_total", "(order OR user) AND NOT_A_WORD", "{name summary} : user", "naive",
    "summary : (user AND order)", 'NEAR(order user, 3)', 'NEAR(order user price, 6)', 'NEAR("total price" user)', "^ order", "user + order", "the AND (price OR data) NOT total",
    '"service handl*"', "relational", "connection OR handler OR data",
])
def test_same_rows_and_ranks_as_fts5(corpus, text):
    con, _, texts = corpus
    want = dict(con.execute("select rowid, bm25(f) from f where f match ?", (text,)).fetchall())
    got = {r["id"]: r["rank"] for r in search.search_texts(texts, text).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_written_index_gives_the_same(corpus):
    _, nodes, texts = corpus
    rows = search.index_texts(nodes)
    for text in ("order AND user", "pri*", '"total price"', "nowhere"):
        a = {r["id"]: round(r["rank"], 9) for r in search.search_texts(texts, text).collect()}
        b = {r["id"]: round(r["rank"], 9) for r in search.search_index(search.postings(rows), search.lengths(rows), text).collect()}
        assert a == b


@pytest.mark.parametrize("text", ["", "a::b", "foo-bar", "a.b", "it's", "AND", "order AND", "(order", '"open', "nocolumn : x"])
def test_bad_queries_raise(text):
    with pytest.raises(ValueError):
        search.parse(text)


def test_built_queries_equal_read_ones():
    assert search.parse("a AND b OR c") == (search.term("a") & search.term("b")) | search.term("c")
    assert search.parse('name : "x y" NOT z*') == search.within(search.phrase("x y"), "name") - search.prefix("z")


def test_kind_and_limit(spark):
    nodes = spark.createDataFrame([(1, "class", "user", "a", "user"), (2, "function", "user", "b", "user user")],
                                  "id BIGINT, kind STRING, name STRING, qualified_name STRING, summary STRING")
    assert [r["id"] for r in search.search(nodes, "user", kind="class").collect()] == [1]
    assert search.search(nodes, "user", limit=1).count() == 1


def test_no_nodes_give_no_rows(spark):
    nodes = spark.createDataFrame([], "id BIGINT, kind STRING, name STRING, qualified_name STRING, summary STRING")
    assert search.search(nodes, "user OR NEAR(a b)").count() == 0
    texts = search.index_texts(nodes)
    assert search.search_index(search.postings(texts), search.lengths(texts), "user").count() == 0
