"""Conditional text generation from a count model, all sequences at once.

State ``(seq_id, label, prev, out)`` advances one token per step by an
equi-join to the model's candidate lists on ``(label, prev)``, followed by
row-local higher-order functions (ban, penalty, temperature, top-k, top-p,
draw).  The draw uses ``u = uniform(seed, seq_id, step)``, so a recomputed
task draws the same token.

End of a sequence: the drawn token is the end marker (which is not part of the
text), its length with its prompt reaches the limit, or no candidate is left.
Only living sequences are joined: every step writes its state (a reliable
checkpoint), the next one reads the rows of it that go on, and those that ended
are collected once in a while.

A sequence never leaves its label.  Where no more than ``hot_rows`` sequences live,
labels whose rows of the model take no more than ``local_bytes`` are therefore
co-grouped with their sequences and run all steps in the label's task, by the same
rules and with the same bits in plain Python (:func:`next_token`): one job instead of one a step.  Larger
labels, and those with a count that has no logarithm, go step by step.

Shuffles: the candidate table is written once, bucketed and sorted by its key,
so the joins of all steps read it in place and only the living state moves, to
the buckets.  Contexts that more than ``hot_rows`` living sequences share (the
start of a label, frequent words) would fill one bucket; the lists of those, at
most twice the shuffle partitions many and of at most ``width`` entries each, are
broadcast instead, and their sequences do not move at all.  Where no more than
``hot_rows`` sequences live from the start, the lists are written in hash slices
instead: a step reads the slices of its living contexts, not the whole table, and
broadcasts the lists it found.

Warping order: repetition penalty, repeated-bigram ban, temperature, top-k,
renormalise, top-p; greedy takes the best candidate after the ban and the
penalty.  Candidate lists keep ``k + steps`` entries so the penalty and ban
(which touch at most ``steps`` tokens) cannot pull in a candidate from beyond
the list: top-k stays exact.  That holds for penalties of 1 and more; smaller
ones, which would lift seen tokens from anywhere, are an error.
"""

from __future__ import annotations

import functools
import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quill.functions import fdlibm
from quill.functions.hashing import uniform
from quill.operators.model import candidate_lists, repetition_penalty
from quill.session import scratch_path

#: Living sequences of one context from which its list is broadcast.
HOT_ROWS = 10_000
#: Bytes of a label's rows (their strings, and ROW_BYTES each) up to which one task runs its sequences.
LOCAL_BYTES, ROW_BYTES = 192 << 20, 24
#: Candidate lists of a label that its task keeps at a time.
KEPT_LISTS = 2048
#: Slices of the candidate lists where few sequences live: for each shuffle partition, and at most.
SLICES, MOST_SLICES = 4, 8192
#: Steps after which ended sequences are collected and the living are counted.
COLLECT_EVERY = 16


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row: inside the lambda of
    an array function it would be computed for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def _cmp(a: Column, b: Column) -> Column:
    return (F.when(a["score"] > b["score"], F.lit(-1)).when(a["score"] < b["score"], F.lit(1))
            .when(a["token"] < b["token"], F.lit(-1)).when(a["token"] > b["token"], F.lit(1)).otherwise(F.lit(0)))


def banned_after(out: Column, prev: Column) -> Column:
    """Tokens that already followed ``prev`` in ``out`` (no repeated bigram)."""
    idx = F.when(F.size(out) >= 2, F.sequence(F.lit(0), F.size(out) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(idx, lambda i: F.get(out, i) == prev), lambda i: F.get(out, i + 1))


def _scored(score: Column, token: Column) -> Column:
    return F.struct(score.alias("score"), token.alias("token"))


def penalise(cands: Column, seen: Column, r: float) -> Column:
    """Repetition penalty on ``(score, token)`` candidates: a seen token's
    negative score is multiplied by ``r``, a positive one divided."""
    return F.transform(cands, lambda x: _scored(
        repetition_penalty(x["score"], F.array_contains(seen, x["token"]), r), x["token"]))


def ban_repeats(cands: Column, banned: Column) -> Column:
    """Drop candidates that would repeat a bigram (``banned`` = tokens that
    already followed the current context)."""
    return F.filter(cands, lambda x: ~F.array_contains(banned, x["token"]))


def with_temperature(cands: Column, temperature: float) -> Column:
    """Divide candidate scores (log-probabilities) by the temperature."""
    return F.transform(cands, lambda x: _scored(x["score"] / F.lit(float(temperature)), x["token"]))


def best_candidates(cands: Column, total: Column, out: Column, prev: Column, k: int, temperature: float = 1.0,
                    penalty: float = 1.0, no_repeat: bool = True) -> Column:
    """The ``k`` best ``(score, token)`` after penalty, bigram ban and temperature, best first."""
    c = F.transform(cands, lambda x: _scored(F.log(x["n"] / total), x["token"]))
    if penalty != 1.0:
        c = penalise(c, out, penalty)
    if no_repeat:
        c = let(F.struct(c.alias("c"), banned_after(out, prev).alias("banned")),
                lambda v: ban_repeats(v["c"], v["banned"]))
    if temperature != 1.0:
        c = with_temperature(c, temperature)
    return F.slice(F.array_sort(c, _cmp), 1, k)


def sample_next(cands: Column, total: Column, out: Column, prev: Column, u: Column, k: int,
                p: float = 1.0, temperature: float = 1.0, penalty: float = 1.0, no_repeat: bool = True) -> Column:
    """The drawn token (null when nothing is left to draw).  Warping order:
    penalty, bigram ban, temperature, top-k, renormalise, top-p."""
    c = best_candidates(cands, total, out, prev, k, temperature, penalty, no_repeat)
    init = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("s"),
                    F.array().cast("array<struct<token:string,w:double,before:double>>").alias("arr"))

    def merge(acc, x):
        m = F.when(F.size(acc["arr"]) == 0, x["score"]).otherwise(acc["m"])
        w = F.exp(x["score"] - m)
        item = F.struct(x["token"].alias("token"), w.alias("w"), acc["s"].alias("before"))
        return F.struct(m.alias("m"), (acc["s"] + w).alias("s"), F.array_append(acc["arr"], item).alias("arr"))

    def finish(acc):
        kept = lambda y: y["before"] < F.lit(float(p)) * acc["s"]
        def pick(cut):
            hit = F.filter(acc["arr"], lambda y: kept(y) & (y["before"] + y["w"] >= cut))
            return F.coalesce(F.get(hit, 0)["token"], F.element_at(F.filter(acc["arr"], kept), -1)["token"])
        return F.aggregate(acc["arr"], F.lit(0.0), lambda t, y: t + F.when(kept(y), y["w"]).otherwise(F.lit(0.0)),
                           lambda tk: F.when(F.size(acc["arr"]) > 0, let(u * tk, pick)))

    return F.aggregate(c, init, merge, finish)


def bucketed_candidates(model: DataFrame, width: int, buckets: int) -> str:
    """Name of a table ``(label, _p, cands, total)`` of candidate lists, written below the shared folder,
    bucketed and sorted by ``(label, _p)``.

    ``_p`` is the context or '' for the start: tokens are never empty, so a join on it is a plain equi-join."""
    spark = model.sparkSession
    lists = candidate_lists(model, ["label", "prev"], width).withColumn(
        "_p", F.coalesce(F.col("prev"), F.lit(""))).drop("prev")
    name = f"quill_candidates_{uuid.uuid4().hex}"
    (lists.repartition(buckets, "label", "_p").write.option("path", scratch_path(spark, "candidates"))
     .bucketBy(buckets, "label", "_p").sortBy("label", "_p").saveAsTable(name))
    return name


def sliced_candidates(model: DataFrame, width: int, slices: int) -> str:
    """Name of a table ``(label, _p, cands, total, _slice)`` of candidate lists, written below the shared folder and
    bucketed by ``_slice``, the hash slice of ``(label, _p)``: a reader of few contexts opens their files alone."""
    spark = model.sparkSession
    lists = candidate_lists(model, ["label", "prev"], width).withColumn(
        "_p", F.coalesce(F.col("prev"), F.lit(""))).drop("prev").withColumn("_slice", _slice(slices))
    name = f"quill_candidates_{uuid.uuid4().hex}"
    (lists.repartition(slices, "_slice").write.option("path", scratch_path(spark, "candidates"))
     .bucketBy(slices, "_slice").saveAsTable(name))
    return name


def _slice(slices: int) -> Column:
    return F.pmod(F.xxhash64(F.col("label"), F.col("_p")), F.lit(slices)).cast("int")


def _looked_up(alive: DataFrame, cands: DataFrame, slices: int) -> DataFrame:
    """``alive`` (few sequences) beside the candidate lists of their contexts, read from the slices that hold them."""
    keys = ["label", "_p"]
    there = [r["_s"] for r in alive.select(_slice(slices).alias("_s")).distinct().collect()]  # at most all slices
    found = cands.where(F.col("_slice").isin(there)).drop("_slice").join(
        F.broadcast(alive.select(*keys).distinct()), keys, "left_semi")
    return alive.join(F.broadcast(found), keys, "left")


def _with_candidates(alive: DataFrame, cands: DataFrame, living: int, hot_rows: int, partitions: int) -> DataFrame:
    """``alive`` beside the candidate list of its context; sequences without one keep their row."""
    keys = ["label", "_p"]
    limit = max(hot_rows, -(-living // (2 * partitions)))
    if living <= limit:  # no context can have more
        return alive.join(cands, keys, "left")
    # At most living / limit contexts, so twice the partitions at most.
    hot = F.broadcast(alive.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
                      .select(*keys, F.lit(True).alias("_hot")))
    marked = alive.join(hot, keys, "left")
    shared = F.broadcast(cands.join(hot.drop("_hot"), keys, "left_semi"))
    moved = marked.where(F.col("_hot").isNull()).drop("_hot").join(cands, keys, "left")
    placed = marked.where(F.col("_hot").isNotNull()).drop("_hot").join(shared, keys, "left")
    return moved.unionByName(placed)


class Label:
    """The rows ``(_p, token, n)`` of one label's model; a context's candidate list is cut when it is first asked for."""

    def __init__(self, rows: pa.Table, width: int):
        contexts = rows.column("_p").combine_chunks().dictionary_encode()
        codes = contexts.indices.to_numpy(zero_copy_only=False)
        self.at = {p: i for i, p in enumerate(contexts.dictionary.to_pylist())}
        self.order = np.argsort(codes, kind="stable")
        self.ends = np.cumsum(np.bincount(codes, minlength=len(self.at)))
        self.tokens, self.n = rows.column("token").combine_chunks(), rows.column("n").to_numpy()
        self.width = width
        self.candidates = functools.lru_cache(KEPT_LISTS)(self._candidates)

    def _candidates(self, context: str) -> list[tuple[float, str]]:
        """The ``width`` best ``(log share, token)`` after ``context`` in candidate order; none for an unknown one."""
        i = self.at.get(context)
        if i is None:
            return []
        own = self.order[self.ends[i - 1] if i else 0 : self.ends[i]]
        n = self.n[own]
        total = float(n.sum())
        best = sorted(zip((-n).tolist(), self.tokens.take(pa.array(own)).to_pylist(), strict=True))[: self.width]
        return [(fdlibm.log(-m / total), token) for m, token in best]


def next_token(cands: list[tuple[float, str]], seen: set, banned: set, u: float | None, k: int, p: float,
               temperature: float, penalty: float, greedy: bool) -> str | None:
    """What :func:`sample_next` (or, ``greedy``, :func:`best_candidates`) takes, in plain Python; ``u`` null draws the
    last token that is kept."""
    c = cands
    if penalty != 1.0:
        c = [((s * penalty if s < 0 else s / penalty) if t in seen else s, t) for s, t in c]
    if banned:
        c = [x for x in c if x[1] not in banned]
    if temperature != 1.0 and not greedy:
        c = [(s / temperature, t) for s, t in c]
    c = sorted(c, key=lambda x: (-x[0], x[1]))[: 1 if greedy else k]
    if greedy or not c:
        return c[0][1] if c else None
    weights, before, whole = [], [], 0.0
    for s, _ in c:
        before.append(whole)
        weights.append(fdlibm.exp(s - c[0][0]))
        whole += weights[-1]
    kept = [i for i, b in enumerate(before) if b < p * whole]  # the first ones
    cut = math.inf if u is None else u * sum((weights[i] for i in kept), 0.0)
    return c[next((i for i in kept if before[i] + weights[i] >= cut), kept[-1])][1] if kept else None


def _by_label(model: DataFrame, asked: DataFrame, steps: int, width: int, k: int, p: float, temperature: float,
              penalty: float, no_repeat: bool, greedy: bool, seed, eos: str | None) -> DataFrame:
    """``(seq_id, label, out)`` of all sequences, each label's in one task beside the label's rows of the model."""
    p, temperature, penalty = float(p), float(temperature), float(penalty)

    def sequence(label: Label, name: str | None, room: int) -> list[str]:
        out, after, seen, prev = [], {}, set(), ""
        while len(out) < min(room, steps):
            if not (cands := label.candidates(prev)):
                break
            u = None
            if not greedy and name is not None:
                u = (int(hashlib.md5(f"{seed}:{name}:{len(out)}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
            token = next_token(cands, seen, after.get(prev, ()) if no_repeat else (), u, k, p, temperature, penalty, greedy)
            if token is None or token == eos:
                break
            if out:
                after.setdefault(prev, set()).add(token)
            seen.add(token)
            out.append(token)
            prev = token
        return out

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return asked.select(["seq_id", "label"]).append_column("out", pa.array([], pa.list_(pa.string())))
        label = Label(rows, width)
        out = [sequence(label, *x) for x in zip(asked.column("_name").to_pylist(), asked.column("room").to_pylist(), strict=True)]
        return asked.select(["seq_id", "label"]).append_column("out", pa.array(out, pa.list_(pa.string())))

    rows = model.select("label", F.coalesce("prev", F.lit("")).alias("_p"), "token", F.col("n").cast("double").alias("n"))
    names = asked.select("seq_id", "label", F.col("seq_id").cast("string").alias("_name"), "room")
    schema = T.StructType([asked.schema["seq_id"], asked.schema["label"], T.StructField("out", T.ArrayType(T.StringType()))])
    return rows.groupBy("label").cogroup(names.groupBy("label")).applyInArrow(run, schema)


def _large_labels(model: DataFrame, local_bytes: int) -> list:
    """Labels of ``model`` that no task should hold, or whose counts have no logarithm."""
    size = F.octet_length(F.coalesce("prev", F.lit(""))) + F.octet_length("token") + F.lit(ROW_BYTES)
    odd = F.col("token").isNull() | F.col("n").isNull() | F.isnan(F.col("n").cast("double")) | (F.col("n") <= 0)
    per = model.groupBy("label").agg(F.sum(size.cast("long")).alias("size"), F.max(odd).alias("odd"))
    return [r["label"] for r in per.where((F.col("size") > F.lit(local_bytes)) | F.col("odd")).collect()]


def generate(model: DataFrame, prompts: DataFrame, steps: int, k: int = 50, p: float = 1.0,
             temperature: float = 1.0, penalty: float = 1.0, no_repeat: bool = True, greedy: bool = False,
             seed=42, eos: str | None = None, hot_rows: int = HOT_ROWS, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """Generate text for every ``(seq_id, label)`` prompt from a count model ``(label, prev, token, n)``; the start
    context is null.

    A sequence has ``steps`` tokens at most; with a column ``n_prompt`` the tokens of its prompt count among them.
    ``eos`` is the model's end marker.  ``greedy`` takes the best token after the ban and the penalty.  Output
    ``(seq_id, label, text, n_tokens)``.  The model is read more than once: pass a written one."""
    if penalty < 1.0:
        raise ValueError("a penalty under 1 would lift seen tokens from beyond the candidate list")
    spark = model.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = (1 if greedy else k) + (steps if no_repeat or penalty != 1.0 else 0)
    room = F.lit(steps) - F.coalesce(F.col("n_prompt"), F.lit(0)) if "n_prompt" in prompts.columns else F.lit(steps)
    asked = prompts.select("seq_id", "label", room.cast("int").alias("room")).checkpoint(eager=True)
    folder = scratch_path(spark, "generated")
    ended = asked.where("room < 1").select("seq_id", "label", F.array().cast("array<string>").alias("out"))
    alive = asked.where("room >= 1")
    living = alive.count()
    rules = dict(steps=steps, width=width, k=k, p=p, temperature=temperature, penalty=penalty, no_repeat=no_repeat,
                 greedy=greedy, seed=seed, eos=eos)
    few, large = living <= max(hot_rows, -(-living // (2 * partitions))), []
    if few:
        # At most as many labels as sequences, so their list is small; null labels have no model.
        model = model.join(F.broadcast(alive.select("label").distinct()), "label", "left_semi")
        large = _large_labels(model, local_bytes)
        far = F.coalesce(F.col("label").isin(large), F.lit(False)) if large else F.lit(False)
        ended = ended.unionByName(_by_label(model.where(~far), alive.where(~far), **rules))
        model, alive = model.where(far), alive.where(far)
    ended.write.parquet(folder)
    if large or not few:
        _by_steps(model, alive, folder, hot_rows, **rules)
    done = spark.read.schema(ended.schema).parquet(folder)
    return done.select("seq_id", "label", F.array_join("out", " ").alias("text"),
                       F.size("out").cast("long").alias("n_tokens"))


def _by_steps(model: DataFrame, asked: DataFrame, folder: str, hot_rows: int, steps: int, width: int, k: int, p: float,
              temperature: float, penalty: float, no_repeat: bool, greedy: bool, seed, eos: str | None) -> None:
    """Appends ``(seq_id, label, out)`` of all sequences to ``folder``, all of them a token further by each job."""
    spark = model.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    state = asked.select("seq_id", "label", F.lit(None).cast("string").alias("prev"),
                         F.array().cast("array<string>").alias("out"), "room", F.lit(False).alias("done"))
    # Built once: the expressions are the same at every step, so their compiled code is too.
    out, prev = F.col("out"), F.col("prev")
    if greedy:
        nxt = F.get(best_candidates(F.col("cands"), F.col("total"), out, prev, 1, penalty=penalty, no_repeat=no_repeat),
                    0)["token"]
    else:
        nxt = sample_next(F.col("cands"), F.col("total"), out, prev, uniform(seed, F.col("seq_id"), F.size(out)), k, p,
                          temperature, penalty, no_repeat)
    if eos is not None:
        nxt = F.nullif(nxt, F.lit(eos))
    nxt, drawn = nxt.alias("_nxt"), F.col("_nxt")
    moved = [F.col("seq_id"), F.col("label"), drawn.alias("prev"),
             F.when(drawn.isNull(), out).otherwise(F.array_append(out, drawn)).alias("out"), F.col("room"),
             (drawn.isNull() | (F.size(out) + 1 >= F.col("room"))).alias("done")]
    context = F.coalesce(prev, F.lit("")).alias("_p")
    ended, living = [], state.count()
    few = living <= max(hot_rows, -(-living // (2 * partitions)))  # the number only falls
    if few:
        slices = min(SLICES * partitions, MOST_SLICES)
        table = sliced_candidates(model, width, slices)
    else:
        table = bucketed_candidates(model, width, partitions)
    cands = spark.table(table)
    for step in range(steps):
        alive = state.where("not done").select("seq_id", "label", "prev", "out", "room", context)
        j = _looked_up(alive, cands, slices) if few else _with_candidates(alive, cands, living, hot_rows, partitions)
        state = j.select("seq_id", "label", "out", "room", nxt).select(*moved).checkpoint(eager=True)
        ended.append(state.where("done").select("seq_id", "label", "out"))
        if (step + 1) % COLLECT_EVERY == 0 or step + 1 == steps:
            _append(ended, folder)
            ended, living = [], state.where("not done").count()
            if not living:
                break
    if ended:
        _append(ended, folder)
    spark.sql(f"DROP TABLE IF EXISTS {table}")  # the catalogue's entry; files of the scratch folder stay


def _append(parts: list[DataFrame], folder: str) -> None:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    whole.coalesce(max(1, parts[0].rdd.getNumPartitions())).write.mode("append").parquet(folder)


def prompts_per_label(labels: DataFrame, n: int, label: str = "label") -> DataFrame:
    """``n`` prompts per label with ids ``label:i``."""
    return labels.select(F.col(label).alias("label"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_i")).select(
        F.concat(F.col("label"), F.lit(":"), F.col("_i").cast("string")).alias("seq_id"), "label")


def repeated_bigrams(gen: DataFrame) -> DataFrame:
    """Per label: sequences and bigrams seen more than once within a sequence."""
    toks = F.split(F.col("text"), " ")
    pairs = F.zip_with(F.slice(toks, 1, F.greatest(F.size(toks) - 1, F.lit(0))),
                       F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    x = gen.select("seq_id", "label", F.explode_outer(pairs).alias("bg"))
    per = x.groupBy("seq_id", "label", "bg").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("label").agg(F.countDistinct("seq_id").alias("n_seq"),
                                    F.sum(F.when(F.col("bg").isNotNull() & (F.col("c") > 1), 1).otherwise(0)).cast("long").alias("n_repeat"))
