import random

from codeloom.llm import chat

TREE = "id string, parent string, role string, text string, score double, extra int"


def told(df):
    """The conversations of formatted trees, read back."""
    rows = df.withColumn("turns", chat.read_turns(df["text"])).withColumn("loss", chat.masked_text(df["text"], df["loss_mask"])).collect()
    return sorted((r["root"], r["branch"], [(t["role"], t["text"]) for t in r["turns"]], r["loss"]) for r in rows)


def test_best_branches_of_a_tree(spark):
    rows = [("a", None, "user", "hi", None, 1), ("b", "a", "assistant", "one", 1.0, 1), ("c", "a", "assistant", "two", 2.0, 1),
            ("d", "b", "user", "more", 5.0, 1), ("e", "c", "user", "less", 1.0, 1), ("f", "c", "user", None, 4.0, 1),
            ("g", "zz", "user", "lost parent", 0.0, 1), ("h", "i", "user", "cycle", 1.0, 1), ("i", "h", "user", "cycle", 1.0, 1)]
    got = told(chat.formatted(chat.paths(spark.createDataFrame(rows, TREE), top=2)))
    assert got == [  # d and f tie with 6 points: the smaller leaf first
        ("a", 1, [("user", "hi"), ("assistant", "one"), ("user", "more")], "one"),
        ("a", 2, [("user", "hi"), ("assistant", "two"), ("user", "")], "two"),
        ("g", 1, [("user", "lost parent")], "")]


def test_control_strings_survive(spark):
    random.seed(3)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<\\/s>", "<\\\\s>", "[\\INST]", "[", "<", "\\", "/s>", "INST]", "\n", "x", "é🙂", "\\n", "\\s"]
    rows, want = [], []
    for c in range(60):
        turns = [(random.choice(["user", "assistant", "system", "a\nb", "</s>", "\\n", ""]),
                  "".join(random.choices(parts, k=random.randrange(8)))) for _ in range(random.randrange(1, 12))]
        rows += [(c, t, role, text) for t, (role, text) in enumerate(turns)]
        want.append((turns, "".join(x for r, x in turns if r == "assistant")))
    messages = chat.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = [(turns, loss) for _, _, turns, loss in told(chat.formatted(chat.paths(messages)))]
    assert sorted(got) == sorted(want)


def test_long_chain_ties_nulls_and_empty(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", str(t)) for t in range(70)]
    rows += [(2, 0, None, None), (2, 0, None, None), (None, 3, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r[0].split(":")[0]: r for r in told(chat.formatted(chat.paths(chat.linear(df))))}
    assert got["1"][2] == [("user" if t % 2 == 0 else "assistant", str(t)) for t in range(70)]
    assert got["2"][2] == [("", ""), ("", "")] and got["null"][3] == "n"
    assert chat.formatted(chat.paths(chat.linear(df.limit(0)))).count() == 0
