"""Hashes of all words of a batch of texts, with numpy, within a task."""

from __future__ import annotations

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: The first j bytes of a block of eight.
FIRST = np.array([(1 << 8 * j) - 1 for j in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x; one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def split_words(raw: list[bytes]):
    """(bytes, begins, ends, bounds) of the words of some texts: word i is bytes[begins[i]:ends[i]], and text k has the words
    bounds[k]:bounds[k + 1]."""
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = SPACE[data]
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    firsts = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return data, begins, ends, np.searchsorted(begins, firsts)


def heads(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first eight bytes of each stretch of ``data`` as a number, fewer if it is shorter."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[begins] & FIRST[np.minimum(sizes, 8)]


def hash_words(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each word; other seeds give independent ones.

    Blocks of eight bytes are mixed with their place and the seed, and the mixed blocks of a word are added up with its length
    and mixed again. Words of at most eight bytes and of one length never share a hash."""
    sizes = ends - begins
    salt = mixed(np.array([seed * 2 + 1, seed * 2 + 2], np.uint64) * U(0xA24BAED4963EE407))
    sums = mixed(heads(data, begins, sizes) ^ salt[0]) + sizes.astype(np.uint64) * (salt[1] | U(1))
    long = np.flatnonzero(sizes > 8)
    if len(long):
        more = (sizes[long] - 1) // 8
        firsts = np.cumsum(more) - more
        nth = np.arange(int(more.sum())) - np.repeat(firsts, more) + 1
        rest = heads(data, np.repeat(begins[long], more) + 8 * nth, np.repeat(sizes[long], more) - 8 * nth)
        place = mixed(nth.astype(np.uint64) * U(0x9FB21C651E98DF25) + salt[1])
        sums[long] += np.add.reduceat(mixed(mixed(rest ^ place) + mixed(place + salt[0])), firsts)
    return mixed(sums)


def word_hashes(texts: list[str | None], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, bounds): text i has the words bounds[i]:bounds[i + 1]. Null counts as empty."""
    data, begins, ends, bounds = split_words([(t or "").encode() for t in texts])
    return hash_words(data, begins, ends, seed), bounds


def joined(a: np.ndarray, b: np.ndarray, salt: np.uint64) -> np.ndarray:
    """A hash of two hashes, in this order."""
    x = a * U(0x9E3779B97F4A7C15) + b * U(0xD1342543DE82EF95) + salt
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


def windows(hashes: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A hash for each run of ``length`` consecutive words, across the whole array; another seed gives another hash.

    Hashes of runs of 2, 4, 8, ... words are made of two halves each; two such runs that overlap make up a window."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    salt = U((seed * 2 + 1) * 0xE7037ED1A0B428DB % (1 << 64))
    runs, width = hashes, 1
    while 2 * width <= length:
        runs = joined(runs[:-width], runs[width:], salt + U(width))
        width *= 2
    return mixed(joined(runs[:n], runs[length - width:][:n], salt))


def shingles(texts: list[str | None], length: int = 5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the runs of ``length`` words of each text; a shorter text with words has one, of all of them."""
    hashes, bounds = word_hashes(texts, seed)
    size = np.diff(bounds)
    count = np.where(size >= length, size - length + 1, np.minimum(size, 1))
    ends = np.cumsum(count)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    rolled = windows(hashes, length, seed)
    own = np.repeat(size >= length, count)
    if own.any():
        place = np.arange(len(out)) - np.repeat(ends - count, count) + np.repeat(bounds[:-1], count)
        out[own] = rolled[place[own]]
    for i in np.flatnonzero((size > 0) & (size < length)):
        key = U(len(raw := hashes[bounds[i]:bounds[i + 1]]))
        for h in raw:
            key = mixed(np.array([key ^ h]) * U(0x9E3779B97F4A7C15))[0]
        out[ends[i] - 1] = key
    return out, np.concatenate([[0], ends])
