"""Records of several sources mixed to target shares of the total size.

Sizes are tokens of a public tokenizer.  The largest total at which every source can
reach its weight with its allowed repeats is taken.  Iterative proportional fitting
rakes the weights of the cells (source, language, topic) to the source weights and to
the corpus' own language and topic shares, within a fixed factor of the source-only
weight; the last step is always the source's, so its share holds exactly.  A document of
weight ``m`` is then taken ``floor(m * scale + u)`` times, ``u`` being a number in [0, 1)
drawn from its key; ``scale`` is calibrated for each source on a histogram of the places
where documents gain a copy, so the shares come out to about a thousandth of themselves.

Defined results: sources not named exactly as in the target take no part; a named
source without any token, or with no repeats allowed, cannot be met: it is reported with
share 0 and the others share its weight in proportion.  A null or negative weight counts
as 0, null repeats as 1; of a source named twice the weights add up and the greater
number of repeats holds.  Rows with null or empty text have no tokens and are never
taken.  Languages are compared in lower case by their first two letters, unknown ones
and null count as ``und``; topics other than the fixed ones as ``other``.  The number of
cells is thus bounded by the number of target rows times a constant.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.bpe import DEFAULT_VOCABULARY, count_column
from quillon.session import Scratch

#: Languages and document types that make cells.
LANGUAGES = ("vi", "en", "fr", "zh", "ja", "th", "lo", "km")
TOPICS = ("luat", "bo_luat", "nghi_dinh", "nghi_quyet", "quyet_dinh", "thong_tu", "chi_thi", "van_ban_hop_nhat")
#: The raked weight of a cell stays within this factor of the weight that its source alone would give.
REACH = 4.0
#: Histogram steps for one copy, and the greatest scale that is looked at: the raked weights are met at a scale of about one.
STEPS, HIGHEST = 2000, 4


def _bounded(value: Column, known: tuple[str, ...], other: str) -> Column:
    return F.when(value.isin(*known), value).otherwise(F.lit(other))


def rake_cells(tokens: np.ndarray, keys: list[tuple], weights: dict[str, float], caps: dict[str, int], wanted: dict[str, dict[str, float]] | None = None, rounds: int = 60) -> tuple[np.ndarray, float, list[tuple]]:
    """``(copies expected of each cell's rows, total, margins)``; ``keys`` are (source, language, topic).

    ``wanted`` may name shares of languages and topics; those not named share the rest as
    they do in the corpus.  ``margins`` are ``(axis, label, share asked for, share met)``.
    """
    source = np.array([k[0] for k in keys])
    held = {s: float(tokens[source == s].sum()) for s in weights}
    live = {s: w for s, w in weights.items() if w > 0 and held[s] > 0 and caps[s] > 0}
    if not live:
        return np.zeros(len(keys)), 0.0, []
    share = {s: w / sum(live.values()) for s, w in live.items()}
    total = min(held[s] * caps[s] / share[s] for s in live)
    cap = np.array([caps[s] if s in live else 0 for s in source], dtype=float)
    start = np.array([min(total * share[s] / held[s], caps[s]) if s in live else 0.0 for s in source])
    low, high = start / REACH, np.minimum(start * REACH, cap)
    m = start.copy()
    used = np.isin(source, list(live))
    margins, names = [], []
    for axis, name in ((1, "language"), (2, "topic")):
        labels = np.array([k[axis] for k in keys])
        own = {v: tokens[used & (labels == v)].sum() for v in sorted(set(labels[used]))}
        asked = {v: x for v, x in ((wanted or {}).get(name) or {}).items() if own.get(v, 0) > 0}
        left = sum(t for v, t in own.items() if v not in asked)
        spare = max(0.0, 1 - sum(asked.values())) if left else 0.0
        goals = {v: asked[v] if v in asked else spare * t / left for v, t in own.items()}
        for v, goal in goals.items():
            margins.append((used & (labels == v), total * goal / max(sum(goals.values()), 1e-12)))
            names.append((name, v))

    def to_source() -> None:
        for s in live:
            here = (source == s) & (tokens > 0)
            goal = total * share[s]
            for _ in range(50):  # fill up to the bounds
                got = (tokens[here] * m[here]).sum()
                if got <= 0 or abs(got - goal) <= 1e-9 * goal:
                    break
                m[here] = np.clip(m[here] * goal / got, low[here], high[here])

    for _ in range(rounds):
        for here, goal in margins:
            got = (tokens[here] * m[here]).sum()
            if got > 0:
                m[here] = np.clip(m[here] * goal / got, low[here], high[here])
        to_source()
    taken = max(float((tokens * m).sum()), 1e-12)
    return m, total, [(*n, float(goal / total), float((tokens[here] * m[here]).sum() / taken)) for n, (here, goal) in zip(names, margins)]


def rake(tokens: np.ndarray, keys: list[tuple], weights: dict[str, float], caps: dict[str, int], **how) -> tuple[np.ndarray, float]:
    """The copies and the total of :func:`rake_cells` alone."""
    return rake_cells(tokens, keys, weights, caps, **how)[:2]


class Mixture:
    """A calibrated mixture: ``rows`` and ``shares`` are plans over written tables."""

    def __init__(self, documents: DataFrame, target: DataFrame, path: str = DEFAULT_VOCABULARY, wanted: dict[str, dict[str, float]] | None = None):
        spark = documents.sparkSession
        self.scratch = Scratch(spark, "mixture")
        named_once = target.where("source is not null").groupBy("source")
        self.target = named_once.agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
        # only rows of named sources are counted
        named = documents.join(self.target.select(F.col("source").alias("named")).distinct(), F.col("source") == F.col("named"), "left_semi")
        lang = _bounded(F.lower(F.substring(F.trim("lang"), 1, 2)), LANGUAGES, "und")
        slim = named.select("doc_id", "source", lang.alias("language"), _bounded(F.col("loai"), TOPICS, "other").alias("topic"), "text")
        self.sized = self.scratch.save(count_column(slim, ["doc_id", "source", "language", "topic"], "text", path).where("n_tokens > 0"), "sized")
        goals = {r["source"]: (float(r["weight"]), int(r["max_repeats"])) for r in self.target.collect()}
        cells = self.sized.groupBy("source", "language", "topic").agg(F.sum("n_tokens").alias("tokens")).collect()
        keys = [(r["source"], r["language"], r["topic"]) for r in cells]
        tokens = np.array([r["tokens"] for r in cells], dtype=float)
        weights, caps = {s: g[0] for s, g in goals.items()}, {s: g[1] for s, g in goals.items()}
        m, self.total, self._margins = rake_cells(tokens, keys, weights, caps, wanted) if cells else (np.zeros(0), 0.0, [])
        table = [(*k, float(x), caps[k[0]]) for k, x in zip(keys, m) if x > 0]
        factors = spark.createDataFrame(table, "source string, language string, topic string, m double, cap int")
        u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
        self.weighted = self.scratch.save(self.sized.join(F.broadcast(factors), ["source", "language", "topic"]).select("doc_id", "source", "n_tokens", "m", "cap", u.alias("u")), "weighted")  # factors: at most 90 rows a source
        gains = self.weighted.select("source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("cap"))).alias("j"), "m", "u").select("source", self._place("j").alias("place"), "n_tokens")
        steps = gains.groupBy("source", "place").agg(F.sum("n_tokens").alias("gain"))  # at most STEPS * HIGHEST places a source
        live = {s for s in weights if weights[s] > 0 and caps[s] > 0 and any(k[0] == s for k in keys)}
        goals = spark.createDataFrame([(s, self.total * weights[s] / sum(weights[x] for x in live)) for s in live], "g_source string, goal double")
        reached = steps.withColumn("off", F.sum("gain").over(Window.partitionBy("source").orderBy("place"))).join(F.broadcast(goals), F.col("source") == F.col("g_source")).withColumn("off", F.abs(F.col("off") - F.col("goal")))  # one row a target source
        nearest = reached.groupBy("source").agg(F.min(F.struct("off", "place")).alias("best"), F.first("goal").alias("goal"))
        self.limits = self.scratch.save(nearest.select(F.col("source").alias("l_source"), F.when(F.col("goal") <= F.col("best.off"), F.lit(-1)).otherwise(F.col("best.place")).cast("long").alias("upto")), "limits")

    @staticmethod
    def _place(j: str) -> Column:
        """Histogram step at which a document gains its j-th copy: where scale * m + u reaches j."""
        return F.least(F.floor((F.col(j) - F.col("u")) / F.col("m") * STEPS), F.lit(STEPS * HIGHEST)).cast("long")

    def rows(self) -> DataFrame:
        """``(doc_id, source, copies, n_tokens)`` of the rows taken; size and cap are those of one copy."""
        held = self.weighted.join(F.broadcast(self.limits), F.col("source") == F.col("l_source"))  # one row a target source
        copies = F.aggregate(F.sequence(F.lit(1), F.col("cap")), F.lit(0), lambda n, j: n + F.when(F.least(F.floor((j - F.col("u")) / F.col("m") * STEPS), F.lit(STEPS * HIGHEST)) <= F.col("upto"), 1).otherwise(0))
        return held.select("doc_id", "source", copies.alias("copies"), "n_tokens").where("copies > 0")

    def margins(self) -> DataFrame:
        """How far the raking met the shares of languages and topics: ``(axis, label, asked, met)``.  They may differ, as a cell's weight stays within :data:`REACH`."""
        return self.limits.sparkSession.createDataFrame(self._margins, "axis string, label string, asked double, met double")

    def shares(self) -> DataFrame:
        """One row a target source: the share asked for, the one reached, and what was taken."""
        taken = self.rows().groupBy(F.col("source").alias("s")).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("rows_taken"), F.max("copies").alias("most_copies"))
        every = self.target.join(taken, F.col("source") == F.col("s"), "left").select("source", "weight", "max_repeats", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "rows_taken", "most_copies")))
        total = every.agg(F.sum("tokens").alias("all_tokens"))
        return every.crossJoin(F.broadcast(total)).select("source", "weight", "max_repeats", "tokens", "rows_taken", "most_copies", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("all_tokens")), F.lit(0.0)).alias("share"))  # total is one row
