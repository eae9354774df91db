"""Spelling variants by composing the vocabulary acceptor with a one-edit transducer and the acceptor again.

The acceptor ``A`` is the minimal acyclic automaton of a set of words; ``T``
changes, drops or adds exactly one code point.  The composition ``A . T . A``
accepts the pairs of words that are one edit apart.  As ``A`` is deterministic, a
composed state before the edit is a state of ``A`` twice; behind the edit it is
two states whose common right language completes the pair.  Words are told apart
by their rank among the words of a state (the automaton carries the counts), so
pairs are enumerated as numbers, bottom-up over the states, without recursion.

No task builds the automaton of the whole vocabulary.  It is partitioned by
initial state: words are dealt by their shortest prefix that at most ``LIMIT``
words share, and each task composes the acceptor of one such prefix, edits
behind the prefix only.  Edits within the prefix lead from the few initial states
that more than ``LIMIT`` words pass through; there the composed machine reads one
edit and then equal rests, so these pairs are the words that agree after dropping
the code point at that place, an equi-join whose groups hold no more words than
the alphabet has code points (and the shorter word itself).  Which prefixes are
that frequent is counted on Spark, in one pass over hashed prefixes.

A deletion within a run of equal code points is the same at each of its places;
it is read at the last one, so each pair is found once.

Defined results: null and empty texts have no words; a null id is written as the
empty text in the hash of a run; rows that repeat count each time; a vocabulary
without near words gives null forms and each word as its own root; words of any
length are taken (a prefix is hashed, never listed); extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm.common import LOWER, UPPER, between, written

LIMIT = 4000
TYPO = 199
MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
#: Words a task counts before it sends them on.
HELD = 200_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_GAP = re.compile("[^A-Za-zÀ-ÿ]")
_FOLD = str.maketrans(UPPER, LOWER)
_NONE = np.zeros((0, 2), np.int64)


# ------------------------------------------------------------ words


def with_typo(doc: str, run: str, every: int = TYPO) -> str:
    """The run, without one code point where the hash of document and run says so."""
    h = zlib.crc32(f"{doc}:{run}".encode("utf-8", "replace"))
    if every and h % every == 0:
        at = h % len(run)
        return run[:at] + run[at + 1:]
    return run


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, every: int = TYPO) -> DataFrame:
    """``(word, n)`` of the words of all whole texts; tasks count, then one aggregate adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
                                             ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for piece in between(text, _GAP):
                    _add(counts, Counter(_RUN.findall(piece)), doc, min_length, every)
                    if len(counts) >= HELD:
                        yield sent()
        if counts:
            yield sent()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(
        F.col("n") >= min_count)


def _add(counts: Counter, own: Counter, doc: str, min_length: int, every: int) -> None:
    for found, n in own.items():
        if len(found) >= min_length:
            word = with_typo(doc, found.translate(_FOLD), every)
            if len(word) >= min_length:
                counts[word] += n


# ------------------------------------------------------------ automata


class Acceptor:
    """Minimal acyclic automaton of sorted distinct words; a state's children have smaller numbers.

    ``arcs[q]`` maps a code point to ``(state, words before it)`` in code-point order, ``final[q]`` says
    whether a word ends, ``size[q]`` is the number of words that can be completed from ``q``."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        # The path of the word last read: for each of its prefixes whether it is a word, and its closed children.
        path: list[list] = [[False, {}]]
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                ends, children = path.pop()
                key = (ends, *children.items())
                state = known.get(key)
                if state is None:
                    state = known[key] = self._state(ends, children)
                path[-1][1][last[len(path) - 1]] = state

        for word in words:
            same = 0
            for a, b in zip(last, word):  # noqa: B905
                if a != b:
                    break
                same += 1
            close(same)
            path += [[False, {}] for _ in range(len(word) - same)]
            path[-1][0] = True
            last = word
        close(0)
        self.start = self._state(*path[0])

    def _state(self, ends: bool, children: dict[str, int]) -> int:
        before, arcs = int(ends), {}
        for c, q in children.items():
            arcs[c] = (q, before)
            before += self.size[q]
        self.arcs.append(arcs)
        self.final.append(ends)
        self.size.append(before)
        return len(self.arcs) - 1


class OneEdit:
    """The pairs that ``A . T . A`` accepts, as ranks of words."""

    def __init__(self, a: Acceptor):
        self.a = a
        self.shared: dict[tuple[int, int], np.ndarray] = {}

    def common(self, p: int, q: int) -> np.ndarray:
        """Ranks (in ``p``, in ``q``) of the words that can be completed from both states."""
        if p == q:
            own = np.arange(self.a.size[p])
            return np.stack([own, own], 1)
        found = self.shared.get((p, q))
        if found is None:
            arcs, final = self.a.arcs, self.a.final
            pairs, todo = [], [(p, q, 0, 0)]
            while todo:
                x, y, i, j = todo.pop()
                if x == y:
                    pairs += [(i + n, j + n) for n in range(self.a.size[x])]
                    continue
                if final[x] and final[y]:
                    pairs.append((i, j))
                one, two = arcs[x], arcs[y]
                for c in (one if len(one) < len(two) else two):
                    if c in one and c in two:
                        (u, m), (v, n) = one[c], two[c]
                        todo.append((u, v, i + m, j + n))
            found = self.shared[p, q] = np.array(pairs, np.int64) if pairs else _NONE
        return found

    def at(self, q: int) -> list[np.ndarray]:
        """Pairs whose edit is read in state ``q``."""
        a, out = self.a, []
        arcs = list(a.arcs[q].items())
        for i, (_, (x, m)) in enumerate(arcs):
            for _, (y, n) in arcs[i + 1:]:
                both = self.common(x, y)
                if len(both):
                    out.append(both + (m, n))
        for c, (x, m) in arcs:
            both = self.common(x, q)
            if len(both) and c in a.arcs[x]:
                # Of equal code points the last is dropped: what follows it differs from it.
                y, n = a.arcs[x][c]
                both = both[(both[:, 0] < n) | (both[:, 0] >= n + a.size[y])]
            if len(both):
                out.append(both + (m, 0))
        return out

    def pairs(self, depth: int) -> np.ndarray:
        """All pairs whose edit is at ``depth`` or behind it, as ranks from the start."""
        a = self.a
        # The words of one group share their first ``depth`` code points: the way there is a single path.
        q = a.start
        for _ in range(depth):
            if len(a.arcs[q]) != 1 or a.final[q]:
                break
            q = next(iter(a.arcs[q].values()))[0]
        below = {q}
        todo = [q]
        while todo:
            for x, _ in a.arcs[todo.pop()].values():
                if x not in below:
                    below.add(x)
                    todo.append(x)
        done: dict[int, np.ndarray] = {}
        users = dict.fromkeys(below, 0)
        for s in below:
            for x, _ in a.arcs[s].values():
                users[x] += 1
        for s in sorted(below):
            parts = self.at(s)
            for x, m in a.arcs[s].values():
                if len(done[x]):
                    parts.append(done[x] + m if m else done[x])
                users[x] -= 1
                if not users[x] and x != q:
                    del done[x]
            done[s] = parts[0] if len(parts) == 1 else np.concatenate([_NONE, *parts])
        return done[q]


# ------------------------------------------------------------ pairs on Spark


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash of every prefix of every word, the empty one first."""
    for batch in batches:
        words = batch.column("word").to_pylist()
        for at in range(0, len(words), 1000):
            out_word, depth, hashes = [], [], []
            for word in words[at:at + 1000]:
                h = 0
                for d in range(len(word) + 1):
                    if d:
                        # A hash chain over the code points, 61 bits.
                        h = (h * 1_000_003 + ord(word[d - 1]) + 1) % ((1 << 61) - 1)
                    depth.append(d)
                    hashes.append(h)
                out_word += [word] * (len(word) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(out_word, pa.string()), pa.array(depth, pa.int32()),
                                              pa.array(hashes, pa.int64())], ["word", "depth", "prefix"])


def with_depth(vocabulary: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(word, n, depth)``: the length of the word's shortest prefix that at most ``limit`` words share."""
    prefixes = written(vocabulary.select("word").mapInArrow(_prefix_rows, "word string, depth int, prefix long"),
                       "spelling-prefixes")
    hot = prefixes.groupBy("depth", "prefix").agg(F.count(F.lit(1)).alias("words")).filter(F.col("words") > limit)
    met = prefixes.join(hot, ["depth", "prefix"], "left")
    depth = met.groupBy("word").agg(F.coalesce(
        F.min(F.when(F.col("words").isNull(), F.col("depth"))), F.max("depth") + 1).alias("depth"))
    return written(vocabulary.join(depth, "word"), "spelling-vocabulary")


def _compose(table: pa.Table) -> pa.Table:
    table = table.sort_by("word")
    words = table.column("word").to_pylist()
    # Arrow sorts by UTF-8, which is the order of code points.
    depth = table.column("depth")[0].as_py() if words else 0
    pairs = OneEdit(Acceptor(words)).pairs(depth)
    a, b = pa.array(pairs[:, 0]), pa.array(pairs[:, 1])
    n = table.column("n")
    return pa.table({"word": table.column("word").take(a), "n": n.take(a),
                     "near": table.column("word").take(b), "near_n": n.take(b)})


def near_pairs(vocabulary: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(word, n, near, near_n)``: each unordered pair of words of ``(word, n)`` one edit apart, once."""
    words = with_depth(vocabulary, limit)
    schema = "word string, n long, near string, near_n long"
    by_prefix = words.filter(F.col("depth") <= F.length("word")).withColumn(
        "start", F.substring(F.col("word"), F.lit(1), F.col("depth")))
    composed = by_prefix.groupBy("depth", "start").applyInArrow(_compose, schema)

    # Edits at the initial states that more words pass through: equal rests.
    places = F.explode(F.sequence(F.lit(0), F.col("depth") - 1))
    early = words.filter(F.col("depth") > 0).select("word", "n", places.alias("at"))
    size = F.length("word")
    rest = F.concat(F.substring(F.col("word"), F.lit(1), F.col("at")), F.substring(F.col("word"), F.col("at") + 2, size))
    dropped = early.filter(F.col("at") < size).select(
        "at", rest.alias("rest"), "word", "n",
        (F.substring(F.col("word"), F.col("at") + 1, F.lit(1))
         != F.substring(F.col("word"), F.col("at") + 2, F.lit(1))).alias("last"))
    left = dropped.select("at", "rest", "word", "n")
    right = dropped.select("at", "rest", F.col("word").alias("near"), F.col("n").alias("near_n"))
    changed = left.join(right, ["at", "rest"]).filter(F.col("word") < F.col("near"))
    itself = early.filter(F.col("at") <= size).select("at", F.col("word").alias("rest"), F.col("word").alias("near"),
                                                    F.col("n").alias("near_n"))
    shorter = dropped.filter("last").select("at", "rest", "word", "n").join(itself, ["at", "rest"])
    cols = ["word", "n", "near", "near_n"]
    return composed.select(*cols).unionByName(changed.select(*cols)).unionByName(shorter.select(*cols))


# ------------------------------------------------------------ forms


def variants(vocabulary: DataFrame, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of every word of ``(word, n)``.

    The form is the most frequent near word (of several the first in code-point order) if it is ``ratio`` times as
    frequent; forms grow by that factor, so a chain of them is at most ``log(largest n)`` long, and as many doublings
    of the step follow each word to the last form of its chain (``ratio`` is 2 or more)."""
    if ratio < 2:
        raise ValueError("forms must be at least twice as frequent, or chains of them need not end")
    vocabulary = written(vocabulary, "spelling-words")
    pairs = written(near_pairs(vocabulary, limit), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"),
                                          F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(
        (-F.col("near_n")).alias("o"), F.col("near").alias("near"))).alias("b"))
    joined = vocabulary.join(best, "word", "left")
    enough = -F.col("b.o") >= F.lit(ratio) * F.col("n")
    found = written(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("b.near")).alias("form"), F.when(enough, -F.col("b.o")).alias("form_n")), "spelling-forms")
    top = found.agg(F.max("n").alias("n")).first()["n"] or 1
    links, reach = 0, 1
    while reach <= top:
        links, reach = links + 1, reach * ratio
    jump = found.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(max(0, (links - 1).bit_length())):
        on = jump.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jump = written(jump.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")),
                       "spelling-roots")
    return found.join(jump, "word", "left").withColumn("root", F.coalesce("root", "word"))
