"""Mixing sources to target weights by soft membership (DataFrame functions only).

Classifier: a table of hashed words, made from labelled documents, holds for
every domain the log-likelihood of each of ``BUCKETS`` word hashes.  A
document's log-likelihoods are the sums over its words; divided by the number
of its words to the power ``SHRINK`` (words of a text are not independent) and
added to the log shares of the domains, they give its domain posteriors.

Rates: each document gets a rate of at least 0, the expected number of times it
is taken, such that the expected tokens of the domains, ``sum(rate * posterior
* tokens)``, match the targets.  Projected gradient descent on the squared
differences starts from rates of 1; all that moves between steps are the
domains' totals and their Gram matrix (one aggregate).  A step is scaled by the
inverse of the Gram matrix of the documents whose rate is still above 0, so
documents that already are at 0, however long, do not slow it; it is shortened
where it would not come nearer.  Steps go on until the targets hold to
``TOLERANCE`` of all tokens.  The rates of a step follow from the document's own
row and the steps before, so no table of rates is stored while iterating; the
trial lengths of a step are measured in one Spark job.

Where no rates meet the targets, the steps end at the least squares instead: when
the gradient is, up to ``GAP`` of the squared residual, 0 on the documents with a
rate and not below 0 on those without (the bound of the gap to the least), or
after ``STEPS`` steps.  ``reached`` beside ``wanted`` shows what is left open.

Bounded sample (documented parameter): the classifier learns from
``LABELLED_ROWS`` labelled documents of each domain, whole texts, the first in
hash order; posteriors, totals and rates cover all documents.

Defined results: words are runs without white space, a document's tokens; null
and empty texts have none, the prior as posterior and the rate 1; target weights
are scaled to 1, and a domain without a target keeps its share; a domain that no
labelled row has is unknown to the classifier, so its target cannot be met and
is refused with a ``ValueError``, and so are more than ``MAX_DOMAINS`` domains;
targets that no rates meet to ``TOLERANCE`` give the least-squares rates, or an
error where ``strict`` is set; without labelled rows all rates are 1; equal rows
get equal rates; extra columns are ignored (``rates``) or kept (``mixed``).
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.llm.common import written

BUCKETS = 1 << 13
SMOOTH = 0.5
SHRINK = 0.5
STEPS = 60
TOLERANCE = 1e-5
GAP = 1e-2
LABELLED_ROWS = 20_000
MAX_DOMAINS = 64


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), r"\s+"), lambda w: w != "")


def word_table(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               rows: int = LABELLED_ROWS) -> DataFrame:
    """``(domain, bucket, n)``: words of the labelled documents; ``labelled`` has ``(id, domain)``.

    Of each domain the ``rows`` labels that come first in hash order take part,
    so the ids are a broadcast of bounded size and no text is shuffled.
    """
    known = labelled.select("id", "domain").filter("domain is not null and id is not null").distinct().withColumn(
        "o", F.pmod(F.xxhash64(F.lit(31), "id"), F.lit(1 << 40)))
    some = None
    for domain, n in sorted(label_counts(labelled).items()):
        # Hashes are uniform: below this bound lie over 1.2 times the rows wanted, and few more, so the top-k is small.
        below = int((1 << 40) * min(1.0, (1.2 * rows + 1000) / n))
        first = known.filter((F.col("domain") == domain) & (F.col("o") < below)).orderBy("o", "id").limit(rows)
        some = first if some is None else some.unionByName(first)
    if some is None:
        some = known.limit(0)
    some = some.select("id", "domain")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")
    words = own.select("domain", F.explode(_words(F.col("text"))).alias("word"))
    return words.groupBy("domain", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))


def label_counts(labelled: DataFrame) -> dict[str, int]:
    """Labelled documents of each domain, over all labels."""
    found = labelled.select("id", "domain").filter("domain is not null and id is not null").distinct().groupBy(
        "domain").agg(F.count(F.lit(1)).alias("n")).limit(MAX_DOMAINS + 1).collect()
    if len(found) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    return {r["domain"]: r["n"] for r in found}


def likelihoods(table: DataFrame, rows: dict[str, int] | None = None) -> tuple[list[str], list[float], DataFrame]:
    """Domains, their shares (of ``rows``, else of words), and ``(bucket, l0, l1, ...)``: log-likelihoods by hashed word.

    The table has ``BUCKETS`` rows and a column a domain, whatever the corpus;
    domains are ``MAX_DOMAINS`` at most.
    """
    counts = written(table, "word-counts")
    total = {r["domain"]: r["n"] for r in counts.groupBy("domain").agg(F.sum("n").alias("n")).limit(
        MAX_DOMAINS + 1).collect()}
    if len(total) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    names = sorted(total)
    spark = table.sparkSession
    wide = counts.groupBy("bucket").agg(*(
        F.sum(F.when(F.col("domain") == d, F.col("n"))).alias(f"n{i}") for i, d in enumerate(names))) if names else None
    if wide is None:
        return [], [], spark.range(0).select(F.col("id").cast("int").alias("bucket"))
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(wide, "bucket", "left")
    logs = every.select("bucket", *(
        F.log((F.coalesce(F.col(f"n{i}"), F.lit(0)) + SMOOTH) / (total[d] + SMOOTH * BUCKETS)).alias(f"l{i}")
        for i, d in enumerate(names)))
    weight = {d: (rows or total)[d] for d in names}
    whole = sum(weight.values())
    return names, [weight[d] / whole for d in names], written(logs, "word-likelihoods")


def _summed(logs: list[float]) -> Column:
    """Sum over the words ``at`` of a document of what a constant array holds at their places."""
    constant = F.from_json(F.lit(json.dumps(logs, separators=(",", ":"))), "array<double>")
    return F.aggregate("at", F.lit(0.0), lambda total, place: total + F.get(constant, place))


def posteriors(docs: DataFrame, model: tuple[list[str], list[float], DataFrame], id_col: str = "doc_id",
               text_col: str = "text", whole: bool = False) -> DataFrame:
    """``(id, tokens, posterior)`` of every row; ``posterior`` is an array in the order of the domains.

    With ``whole``, ``id`` is a structure of all columns of the row."""
    names, shares, logs = model
    k = len(names)
    named = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if whole else F.col(id_col)
    rows = docs.select(named.alias("id"), F.transform(
        _words(F.col(text_col)), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")).alias("at"))
    seen = rows.withColumn("tokens", F.size("at").cast("long"))
    if not k:
        return seen.select("id", "tokens", F.array().cast("array<double>").alias("posterior"))
    # The classifier is BUCKETS x domains numbers: constants of the query that each word looks up by position.
    table = sorted(logs.collect(), key=lambda r: r["bucket"])
    scale = F.greatest(F.col("tokens"), F.lit(1)).cast("double") ** SHRINK
    sums = [_summed([round(r[f"l{i}"], 4) for r in table]) for i in range(k)]
    score = F.array(*(s / scale + math.log(shares[i]) for i, s in enumerate(sums)))
    scored = seen.select("id", "tokens", score.alias("s"))
    top = scored.withColumn("m", F.array_max("s")).select(
        "id", "tokens", F.expr("transform(s, x -> exp(x - m))").alias("e"))
    return top.select("id", "tokens", F.expr(
        "transform(e, x -> x / aggregate(e, 0D, (a, y) -> a + y))").alias("posterior"))


def _rate(history: list[list[float]], k: int) -> Column:
    """The rate after all steps: each moves it against the gradient and back to 0 at least."""
    load = [F.col(f"c{i}") for i in range(k)]
    rate: Column = F.lit(1.0)
    if not history:
        return rate
    steps = F.array(*(F.array(*(F.lit(float(x)) for x in step)) for step in history))
    move = lambda step: sum((load[i] * F.element_at(step, i + 1) for i in range(k)), F.lit(0.0))
    return F.aggregate(steps, rate, lambda acc, step: F.greatest(acc - move(step), F.lit(0.0)))


def _moved(rate: Column, step: list[float], k: int) -> Column:
    return F.greatest(rate - sum((F.col(f"c{i}") * F.lit(float(step[i])) for i in range(k)), F.lit(0.0)), F.lit(0.0))


def steps_to(aim: np.ndarray, now: np.ndarray, gram: np.ndarray,
             measured: Callable[[list[list[float]], list[list[float]]], list[tuple[np.ndarray, np.ndarray]]],
             least: Callable[[list[list[float]], np.ndarray], float]) -> tuple[list[list[float]], np.ndarray]:
    """Steps after which the totals are ``aim`` to ``TOLERANCE`` of all tokens, or as near as rates can come; the totals.

    ``measured(history, trials)`` gives totals and the free documents' Gram matrix after each trial step, ``least(history,
    residual)`` the smallest gradient of a document for each of its tokens.
    """
    # A step by the largest eigenvalue of all documents comes nearer wherever rates can.
    sure = 1 / max(float(np.linalg.eigvalsh(gram).max()), 1e-300)
    far = lambda total: float((total - aim) @ (total - aim))
    history: list[list[float]] = []
    total, room = now, TOLERANCE * now.sum()
    while np.abs(total - aim).max() > room and len(history) < STEPS:
        open_ = total - aim
        newton = np.linalg.pinv(gram, rcond=1e-9) @ open_
        quick = open_ / max(float(np.linalg.eigvalsh(gram).max()), 1e-300)
        trials = [x.tolist() for x in (newton, newton / 2, newton / 4, newton / 8, quick, open_ * sure)]
        found = measured(history, trials)
        best = min(range(len(trials)), key=lambda i: far(found[i][0]))
        gain = 1 - far(found[best][0]) / far(total)
        if gain > 0:
            history.append(trials[best])
            total, gram = found[best]
        if gain < 0.05:
            open_ = total - aim
            gap = max(float(total @ open_), 0.0) + max(-least(history, open_), 0.0) * aim.sum()
            if gain <= 0 or gap <= GAP * far(total):
                break
    return history, total


def _fitted(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str, text_col: str,
            strict: bool, whole: bool = False) -> tuple[list[str], DataFrame, list[list[float]], list[float], list[float]]:
    """Domains, written posteriors (with ``whole`` beside the rows themselves), steps, and the shares of the domains
    wanted and reached."""
    model = likelihoods(word_table(docs, labelled, id_col, text_col), label_counts(labelled))
    names, _, _ = model
    k = len(names)
    unknown = sorted(set(targets) - set(names))
    if names and unknown:
        raise ValueError(f"no labelled row for domains {unknown}")
    base = written(posteriors(docs, model, id_col, text_col, whole), "posteriors")
    if not k:
        return names, base, [], [], []
    loads = base.select("tokens", *_loads(k))
    cells = [(i, j) for i in range(k) for j in range(i, k)]

    def measured(history: list[list[float]], trials: list[list[float]]) -> list[tuple[np.ndarray, np.ndarray]]:
        rated = loads.withColumn("rate", _rate(history, k))
        rated = rated.select("*", *(_moved(F.col("rate"), step, k).alias(f"r{t}") for t, step in enumerate(trials)))
        sums = []
        for t in range(len(trials)):
            free = F.when(F.col(f"r{t}") > 0, F.lit(1.0)).otherwise(0.0)
            sums += [F.sum(F.col(f"r{t}") * F.col(f"c{i}")).alias(f"s{t}_{i}") for i in range(k)]
            sums += [F.sum(free * F.col(f"c{i}") * F.col(f"c{j}")).alias(f"g{t}_{i}_{j}") for i, j in cells]
        got = rated.agg(*sums).first()
        return [(np.array([got[f"s{t}_{i}"] or 0.0 for i in range(k)]), np.array(
            [[got[f"g{t}_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]))
            for t in range(len(trials))]

    def least(history: list[list[float]], residual: np.ndarray) -> float:
        slope = sum((F.col(f"c{i}") * float(x) for i, x in enumerate(residual)), F.lit(0.0)) / F.col("tokens")
        return loads.filter("tokens > 0").agg(F.min(slope).alias("m")).first()["m"] or 0.0

    [(now, gram)] = measured([], [[0.0] * k])
    if not now.sum():
        return names, base, [], [0.0] * k, [0.0] * k
    want = goal(dict(zip(names, now, strict=True)), targets)
    aim = np.array([want[n] for n in names])
    history, total = steps_to(aim, now, gram, measured, least)
    wanted, reached = (aim / now.sum()).tolist(), (total / now.sum()).tolist()
    if strict and np.abs(total - aim).max() > TOLERANCE * now.sum():
        raise ValueError(f"targets not met: {dict(zip(names, zip(reached, wanted, strict=True), strict=True))} (reached, wanted)")
    return names, base, history, wanted, reached


def _loads(k: int) -> list[Column]:
    """Expected tokens of a document in each domain, at rate 1."""
    return [(F.col("tokens") * F.element_at("posterior", i + 1)).alias(f"c{i}") for i in range(k)]


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id",
          text_col: str = "text", strict: bool = False) -> DataFrame:
    """``(id, tokens, domains, posterior, wanted, reached, rate)`` of every row.

    ``targets`` are weights of domains; the tokens of the mixture are as many
    as those of the corpus.  ``wanted`` and ``reached`` are the domains' expected
    tokens as shares of all tokens.
    """
    names, base, history, wanted, reached = _fitted(docs, labelled, targets, id_col, text_col, strict)
    k = len(names)
    listed = lambda xs, kind: F.array(*(F.lit(x) for x in xs)).cast(f"array<{kind}>")
    named = base.select("id", "tokens", listed(names, "string").alias("domains"), "posterior",
                        listed(wanted, "double").alias("wanted"), listed(reached, "double").alias("reached"), *_loads(k))
    return named.select("id", "tokens", "domains", "posterior", "wanted", "reached", _rate(history, k).alias("rate"))


def goal(now: dict[str, float], targets: dict[str, float]) -> dict[str, float]:
    """Tokens wanted of each domain: weights for those with a target, the present share for the others."""
    whole = sum(now.values())
    free = sum(now[n] for n in now if n not in targets)
    weight = sum(targets.values())
    return {n: (targets[n] / weight * (whole - free) if n in targets and weight else now[n]) for n in now}


def copies(rate: Column, id_col: Column, seed: int = 29) -> Column:
    """How often a document is taken: the rate rounded down or up by a seeded hash of its id, right on average."""
    u = (F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 40)) / float(1 << 40))
    return F.floor(rate + u).cast("int")


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id",
          text_col: str = "text", seed: int = 29) -> DataFrame:
    """``docs`` with every row as often as its rate says (0 times and more), all columns kept.

    The rows are written beside their posteriors once, so none is joined or shuffled for its rate."""
    names, base, history, _, _ = _fitted(docs, labelled, targets, id_col, text_col, False, whole=True)
    k = len(names)
    rated = base.select("id", *(["tokens", *_loads(k)] if k else [])).select("id", _rate(history, k).alias("rate"))
    times = copies(F.col("rate"), F.col(f"id.`{id_col}`"), seed)
    each = rated.select("id", times.alias("n")).filter("n > 0").select("id", F.explode(F.sequence(F.lit(1), "n")))
    return each.select("id.*")
