"""Count-based language models as tables.

The fine-tuned network of a neural pipeline is replaced by a model that *is*
a table: n-gram counts, fitted with per-document contribution bounds and
Gaussian noise when it must be private, smoothed when scored, and mixed for
distillation.

Fixed definitions:
  token      ``\\S+`` match; bigram context = previous token of the same text,
             null (start) for the first token
  smoothing  p1(w) = (c(w) + a) / (N + a (V + 1));
             p2(w|h) = (c(h,w) + k p1(w)) / (c(h) + k), unseen counts are 0
  candidate order: count (probability) descending, then token ascending
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quill.functions.hashing import gaussian
from quill.functions.text import tokens
from quill.operators.rank import join_on


def _names(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def pair_array(toks: Column) -> Column:
    """``[(null, t0), (t0, t1), ...]``: every token with its previous token."""
    none = F.array(F.lit(None).cast("string"))
    pairs = F.zip_with(F.concat(none, toks), F.concat(toks, none),
                       lambda p, t: F.struct(p.alias("prev"), t.alias("token")))
    return F.filter(pairs, lambda x: x["token"].isNotNull())


def bigram_rows(df: DataFrame, id_col: str, text: str = "text", keep: Sequence[str] = (),
                toks: str | None = None) -> DataFrame:
    """``(id, keep..., pos, prev, token)``, one row per token; no shuffle.
    ``toks`` names an existing token-array column (tokenised once upstream)."""
    src = F.col(toks) if toks else tokens(text)
    d = df.select(id_col, *keep, src.alias("_t"))
    d = d.select(id_col, *keep, F.posexplode(pair_array(F.col("_t"))).alias("pos", "_bg"))
    return d.select(id_col, *keep, F.col("pos").cast("long").alias("pos"), "_bg.prev", "_bg.token")


def pair_keys(toks: Column) -> Column:
    """Every token with its previous token as one string ``prev + ' ' + token``
    (tokens hold no blanks, so the split is unambiguous; the start context is
    the empty string).  Strings let ``array_distinct`` hash instead of
    comparing structs pairwise."""
    none = F.array(F.lit(""))
    keys = F.zip_with(F.concat(none, toks), F.concat(toks, F.array(F.lit(None).cast("string"))),
                      lambda p, t: F.when(t.isNotNull(), F.concat(p, F.lit(" "), t)))
    return F.filter(keys, lambda x: x.isNotNull())


def split_pair_key(key: Column) -> tuple[Column, Column]:
    prev = F.substring_index(key, " ", 1)
    return F.when(prev == "", F.lit(None)).otherwise(prev), F.substring_index(key, " ", -1)


def _noisy(n: Column, keys: list[str], sigma: float, tau, seed, k, public_keys: bool = False) -> Column:
    """The counts with noise, where the release is one; errors for unsafe ones."""
    if not sigma:
        return n
    if tau is None and not public_keys:
        raise ValueError("noisy counts of an unknown key set need a threshold: tau='auto' or public_keys=True")
    if k is None:
        raise ValueError("noisy counts need a bound k on the keys of a text")
    return n + F.lit(float(sigma)) * gaussian(seed, *[F.coalesce(F.col(c), F.lit("")) for c in keys])


def _released(counts: DataFrame, sigma: float, tau, k, delta_key: float) -> DataFrame:
    """Drop keys under ``tau``."""
    if tau == "auto":
        from quill.operators.privacy import key_threshold

        tau = key_threshold(float(sigma), int(k or 1), delta_key)
    return counts if tau is None else counts.where(F.col("n") >= F.lit(float(tau)))


def _doc_items(toks: Column, order: int, k: int | None) -> Column:
    """A text's distinct n-gram keys; with ``k`` at most so many, the first in a
    hash order of (text, key), so the end of a long text counts like its start."""
    items = F.array_distinct(pair_keys(toks) if order == 2 else toks)
    if k is None:
        return items
    # The text's hash is repeated beside the keys: inside a lambda it would be computed for each key.
    drawn = F.zip_with(F.array_repeat(F.md5(F.array_join(toks, " ")), F.size(items)), items,
                       lambda h, x: F.struct(F.md5(F.concat(h, F.lit(":"), x)).alias("o"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(drawn), 1, int(k)), lambda s: s["x"])


def fit_ngram(df: DataFrame, text: str = "text", label: str | None = None, order: int = 2,
              k: int | None = None, sigma: float = 0.0, tau: float | str | None = None, seed=None,
              delta_key: float = 1e-6, public_keys: bool = False, beside: str | None = None) -> DataFrame:
    """Document-level n-gram counts with bounded contributions and noise.

    Each text contributes at most once to a key and to at most ``k`` distinct
    keys (chosen by a hash of text and key), so one document changes at most
    ``k`` counts by 1 (L2 sensitivity sqrt(k)).  Counts get ``N(0, sigma^2)``
    noise and keys under ``tau`` are dropped.  ``tau="auto"`` releases an
    unknown key set safely: ``1 + sigma sqrt(2 ln(k / delta_key))``, which
    costs an extra ``delta_key`` in the ledger.  Noise without a threshold is
    an error unless the caller says that the keys are public.  Without noise
    leave ``k`` and ``tau`` out: every key of every text counts.  Output
    ``(label?, prev?, token, n)`` with ``n`` a double.

    The bounding happens inside each row; the only shuffle is the count.  A
    text's distinct pairs hardly repeat within a task, so they are dealt out by
    pair and counted where they arrive: a partial count would hold nearly every
    pair of a task in memory.  A pair comes at most once a text.  Single tokens
    repeat and are counted partially.  ``beside`` names the label of another
    fit of the same texts: pairs are counted by it first, so both plans read
    the same shuffle, and added up where they are.
    """
    lab = _names(label)
    lkeep = ["label"] if lab else []
    ride = lkeep or (["label"] if beside and order == 2 else [])
    d = df.select(*[F.col(c).alias("label") for c in (lab or _names(beside if ride else None))], tokens(text).alias("_t"))
    x = d.select(*ride, F.explode(_doc_items(F.col("_t"), order, k)).alias("_k"))
    if order == 2:
        prev, tok = split_pair_key(F.col("_k"))
        x = x.select(*ride, prev.alias("prev"), tok.alias("token")).repartition("prev", "token")
        keys = lkeep + ["prev", "token"]
    else:
        x = x.select(*lkeep, F.col("_k").alias("token"))
        keys = lkeep + ["token"]
    if ride != lkeep:
        counts = x.groupBy("label", *keys).agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.sum("n").cast("double").alias("n"))
    else:
        counts = x.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"))
    counts = counts.withColumn("n", _noisy(F.col("n"), keys, sigma, tau, seed, k, public_keys))
    if sigma and seed is None:
        # Real noise is drawn once: a recomputed stage must not redraw it.
        counts = counts.checkpoint(eager=True)
    return _released(counts, sigma, tau, k, delta_key)


def _tagger(i: int, lab: Column):
    return lambda x: F.struct(F.lit(i).alias("m"), lab.alias("label"), x.alias("k"))


def fit_ngram_many(df: DataFrame, specs: dict, text: str = "text") -> dict[str, DataFrame]:
    """Several :func:`fit_ngram` tables over the same texts from one
    tokenisation and one shuffle.  ``specs`` maps a name to keyword arguments
    of :func:`fit_ngram` (``label``, ``order``, ``k``, ``sigma``, ``tau``,
    ``seed``, ``delta_key``, ``public_keys``).  The combined counts are checkpointed once, noise
    included, and each table is a filter of them."""
    names = list(specs)
    labels = sorted({sp["label"] for sp in specs.values() if sp.get("label")})
    d = df.select(*labels, tokens(text).alias("_t"))
    parts = []
    for i, nm in enumerate(names):
        sp = specs[nm]
        lab = F.col(sp["label"]).cast("string") if sp.get("label") else F.lit(None).cast("string")
        items = _doc_items(F.col("_t"), sp.get("order", 2), sp.get("k"))
        parts.append(F.transform(items, _tagger(i, lab)))
    x = d.select(F.explode(F.concat(*parts)).alias("_e")).select("_e.m", "_e.label", "_e.k")
    counts = x.groupBy("m", "label", "k").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pair = split_pair_key(F.col("k"))
    counts = counts.select("m", "label", "k", "n", pair[0].alias("prev"), pair[1].alias("token"))
    keys_of, n = [], F.col("n")
    for i, nm in enumerate(names):
        sp = specs[nm]
        keys = (["label"] if sp.get("label") else []) + (["prev", "token"] if sp.get("order", 2) == 2 else ["token"])
        keys_of.append(keys)
        own = _noisy(F.col("n"), [c if c != "token" or "prev" in keys else "k" for c in keys], sp.get("sigma", 0.0),
                     sp.get("tau"), sp.get("seed"), sp.get("k"), sp.get("public_keys", False))
        n = F.when(F.col("m") == i, own).otherwise(n) if sp.get("sigma") else n
    # Noise first: no exact private count is written.
    combined = counts.withColumn("n", n).checkpoint(eager=True)
    out = {}
    for i, (nm, keys) in enumerate(zip(names, keys_of, strict=True)):
        sp = specs[nm]
        c = combined.where(F.col("m") == i)
        c = c.select(*keys, "n") if "prev" in keys else c.select(
            *[F.col("k").alias("token") if x == "token" else F.col(x) for x in keys], "n")
        out[nm] = _released(c, sp.get("sigma", 0.0), sp.get("tau"), sp.get("k"), sp.get("delta_key", 1e-6))
    return out


def count_ngrams(df: DataFrame, text: str = "text", label: str | None = None, order: int = 2) -> DataFrame:
    """Plain occurrence counts ``(label?, prev?, token, n)`` (n a double)."""
    lab = _names(label)
    d = df.select(*[F.col(c).alias("label") for c in lab], tokens(text).alias("_t"))
    lkeep = ["label"] if lab else []
    items = pair_keys(F.col("_t")) if order == 2 else F.col("_t")
    x = d.select(*lkeep, F.explode(items).alias("_k"))
    # One string a pair up to the count: its parts are cut from the counted keys.
    counts = x.groupBy(*lkeep, "_k").agg(F.count(F.lit(1)).cast("double").alias("n"))
    prev, tok = split_pair_key(F.col("_k"))
    cols = [prev.alias("prev"), tok.alias("token")] if order == 2 else [F.col("_k").alias("token")]
    return counts.select(*lkeep, *cols, "n")


def marginalise(counts: DataFrame, over: str = "label") -> DataFrame:
    """Sum a labelled count table over its label (the label-free teacher)."""
    keys = [c for c in counts.columns if c not in (over, "n")]
    return counts.groupBy(*keys).agg(F.sum("n").alias("n"))


def ctx_key(prev: str = "prev") -> Column:
    """Non-null join key for a bigram context: the previous token, or '' for
    the start (a token is never empty)."""
    return F.coalesce(F.col(prev), F.lit(""))


@dataclass
class NgramModel:
    """Smoothed unigram (``bigrams=None``) or interpolated bigram model."""

    unigrams: DataFrame                 # (token, n)
    bigrams: DataFrame | None = None    # (prev, token, n)
    alpha: float = 1.0
    kappa: float = 1.0
    _totals: tuple[float, float] | None = None

    @classmethod
    def from_bigrams(cls, bigrams: DataFrame, alpha: float = 1.0, kappa: float = 1.0,
                     materialize: bool = True) -> "NgramModel":
        """A bigram model from a ``(prev, token, n)`` table.  The table is read by
        three joins and a totals job, so it is materialised once (reliable
        checkpoint) unless ``materialize=False``."""
        b = bigrams.select("prev", "token", "n")
        if materialize:
            b = b.checkpoint(eager=True)
        uni = b.groupBy("token").agg(F.sum("n").alias("n"))
        return cls(uni, b, alpha, kappa)

    @classmethod
    def unigram(cls, unigrams: DataFrame, alpha: float = 1.0, materialize: bool = True) -> "NgramModel":
        u = unigrams.select("token", "n")
        if materialize:
            u = u.checkpoint(eager=True)
        return cls(u, None, alpha, 1.0)

    def totals(self) -> tuple[float, float]:
        """Tokens counted and distinct tokens; one job, kept."""
        if self._totals is None:
            tot = self.unigrams.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("V")).first()
            self._totals = float(tot["N"] or 0.0), float(tot["V"] or 0)
        return self._totals

    def prob(self, pairs: DataFrame, name: str = "p") -> DataFrame:
        """Add ``name`` = p(token | prev) to a table of distinct ``(prev, token)``.

        The model tables grow with the corpus and are joined, not broadcast by
        force; AQE broadcasts them when small and splits hot tokens.  Context
        joins use the non-null key ``prev or ''`` (tokens are never empty)."""
        big_n, v = self.totals()
        a = self.alpha
        u = self.unigrams.select(F.col("token").alias("_ut"), F.col("n").alias("_c1"))
        d = pairs.join(u, F.col("token") == F.col("_ut"), "left").drop("_ut")
        p1 = (F.coalesce(F.col("_c1"), F.lit(0.0)) + F.lit(a)) / F.lit(big_n + a * (v + 1.0))
        if self.bigrams is None:
            return d.withColumn(name, p1).drop("_c1")
        b = self.bigrams.select(ctx_key("prev").alias("_bp"), F.col("token").alias("_bt"), F.col("n").alias("_c2"))
        ctx = self.bigrams.groupBy(ctx_key("prev").alias("_cp")).agg(F.sum("n").alias("_ch"))
        d = d.withColumn("_pk", ctx_key("prev"))
        d = d.join(b, (F.col("_pk") == F.col("_bp")) & (F.col("token") == F.col("_bt")), "left").drop("_bp", "_bt")
        d = d.join(ctx, F.col("_pk") == F.col("_cp"), "left").drop("_cp", "_pk")
        k = self.kappa
        p2 = (F.coalesce(F.col("_c2"), F.lit(0.0)) + F.lit(k) * p1) / (F.coalesce(F.col("_ch"), F.lit(0.0)) + F.lit(k))
        return d.withColumn(name, p2).drop("_c1", "_c2", "_ch")


@dataclass
class MixModel:
    """``lam * teacher + (1 - lam) * student``: the per-context minimiser of
    ``lam * KL(teacher || s) + (1 - lam) * CE(student data, s)`` at T = 1."""

    teacher: "NgramModel | MixModel"
    student: "NgramModel | MixModel"
    lam: float

    def prob(self, pairs: DataFrame, name: str = "p") -> DataFrame:
        d = self.teacher.prob(pairs, "_pt")
        d = self.student.prob(d, "_ps")
        return d.withColumn(name, F.lit(self.lam) * F.col("_pt") + F.lit(1.0 - self.lam) * F.col("_ps")).drop("_pt", "_ps")


def mle_mix(teacher: DataFrame, student: DataFrame, lam: float) -> DataFrame:
    """Distilled table ``(prev, token, p)``: ``lam * c_T(h,w)/c_T(h) + (1-lam) *
    c_S(h,w)/c_S(h)`` over the union of both key sets."""
    none = F.lit(0.0)
    t = teacher.select(ctx_key("prev").alias("_p"), F.col("token").alias("_t"), F.col("n").alias("_cT"), none.alias("_cS"))
    s = student.select(ctx_key("prev").alias("_p"), F.col("token").alias("_t"), none.alias("_cT"), F.col("n").alias("_cS"))
    # The pairs move once, to their context: sums by pair, sums by context and their join all stay there.
    both = t.unionByName(s).repartition("_p")
    pairs = both.groupBy("_p", "_t").agg(F.sum("_cT").alias("_cT"), F.sum("_cS").alias("_cS"))
    # From the pairs: a plan of its own columns would move the rows, and count the texts, once more.
    ctx = pairs.groupBy(F.col("_p").alias("_h")).agg(F.sum("_cT").alias("_hT"), F.sum("_cS").alias("_hS"))
    j = pairs.join(ctx, F.col("_p") == F.col("_h"))

    def share(c: str, h: str) -> Column:
        return F.when(F.col(h) != 0, F.col(c) / F.col(h)).otherwise(none)

    p = F.lit(lam) * share("_cT", "_hT") + F.lit(1.0 - lam) * share("_cS", "_hS")
    return j.select(F.when(F.col("_p") == "", F.lit(None)).otherwise(F.col("_p")).alias("prev"),
                    F.col("_t").alias("token"), p.alias("p"))


def distil(student_counts: DataFrame, teacher: DataFrame, lam: float) -> DataFrame:
    """Student by distillation: ``p = lam * teacher + (1 - lam) * empirical``
    per context over the union of both key sets (see :func:`mle_mix`); at
    T = 1 this is the per-context minimiser of the mixed KL / CE loss."""
    return mle_mix(teacher, student_counts, lam)


# ------------------------------------------------------------ candidates

def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rk",
          salts: int = 64, salt_key: str = "token") -> DataFrame:
    """Exact top ``k`` rows per group with their 1-based rank.  Two phases: the
    top ``k`` of each of ``salts`` hash slices of a group, then the top ``k``
    of those candidates, so a huge group never sits in one task."""
    by = list(by)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(salt_key)), F.lit(salts)))
    w1 = Window.partitionBy(*by, "_salt").orderBy(*order)
    part = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*by).orderBy(*order)
    return part.withColumn(name, F.row_number().over(w2)).where(F.col(name) <= k)


def candidate_lists(counts: DataFrame, by: Sequence[str], k: int, name: str = "cands") -> DataFrame:
    """Per context, the ``k`` best ``(n, token)`` candidates in candidate order
    plus the context's total count (for normalising)."""
    by = list(by)
    tot = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    top = top_k(counts, by, [F.col("n").desc(), F.col("token").asc()], k)
    lists = top.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rk", "n", "token"))).alias("_l"))
    lists = lists.select(*by, F.transform("_l", lambda x: F.struct(x["n"].alias("n"), x["token"].alias("token"))).alias(name))
    return join_on(lists, tot, by)


def top_p(counts: DataFrame, by: Sequence[str], p_num: int, p_den: int, name: str = "keep") -> DataFrame:
    """Nucleus filter: keep a candidate while the mass of the candidates ranked
    above it is below ``p = p_num / p_den`` of the group total (exact integer
    test ``p_den * higher < p_num * total``).  Running sums come from a
    range-partitioned rank, so a huge group is spread over tasks."""
    from quill.operators.rank import running_total

    by = list(by)
    tot = counts.groupBy(*by).agg(F.sum("n").alias("_tot"))
    ranked = running_total(counts, [F.col("n").desc(), F.col("token").asc()], F.col("n"), by=by, name="_higher")
    j = join_on(ranked, tot, by)
    return j.where(F.lit(p_den) * F.col("_higher") < F.lit(p_num) * F.col("_tot")).drop("_higher", "_tot")


def repetition_penalty(score: Column, seen: Column, r: float) -> Column:
    """Seen tokens: negative scores are multiplied by ``r``, positive divided."""
    return F.when(seen, F.when(score < 0, score * F.lit(r)).otherwise(score / F.lit(r))).otherwise(score)
