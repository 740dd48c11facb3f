"""Inputs and plain counterparts that several tests share."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


class Groups:
    """Union-find, the plain way."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def twins():
    """Two words of 1,024 letters with equal polynomial hashes modulo 2 ** 64, whatever the base: the number of ones in a
    place's binary form decides its letter."""
    odd = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[x] for x in odd), "".join("ba"[x] for x in odd)
