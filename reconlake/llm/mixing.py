"""Mixing weights by iterative proportional fitting, and sampling by them.

Documents fall into cells (source, language, topic). The cells' token counts
are raked: in turn for each dimension, every cell is scaled so that the shares
of that dimension meet their targets, ROUNDS times over; shares that are still
off by over TOLERANCE are logged. What a cell should
hold of the token budget, divided by what it has, is the probability of its
documents, at most 1; `weight` says how often a kept document should be seen
to make up for that bound. With `fill`, no weight is left over: cells that
should hold more than they have are kept whole, what they hold is taken off
the targets, and the others are raked for the rest until no cell exceeds what
it has. A value whose target is beyond all its tokens gets all of them, the
other values of its dimension share what it lacks, and a warning is logged. Up to MAX_CELLS cells are raked so on the
driver; more by the same steps over the table of cells.

Only cells are aggregated and joined, never documents: their number follows
the number of sources, languages and topics. A round's sums are partial sums
on each task before the shuffle, so a source with a third of all rows is one
row like any other afterwards. After each round the cells are written to
the shared folder, which cuts their lineage.

A document is kept if the first 52 bits of md5(seed:doc_id) fall below its
probability; the same rows are kept on every run and cluster, and rows of one
id share their fate.

Nulls and odd rows: null source, language or topic are a value of their own;
texts without words have no tokens, take no part in the raking, and get the
probability of their cell (0 if the whole cell has no tokens). Empty tables
give empty results. Other columns pass through; columns named like the outputs
are replaced.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconlake.plans.lineage import discard, new_folder, written, written_to

ROUNDS = 12
TOLERANCE = 1e-3  # of a share, beyond which a warning is logged
MAX_CELLS = 200_000  # that come to the driver with `fill`; more are raked as a table, in a job for each round
LOG = logging.getLogger(__name__)
OUTPUTS = ("topic", "tokens", "probability", "weight", "sampled")


def n_words(text: Column) -> Column:
    """Number of words of `[^\\x20\\x09-\\x0D]+` as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def topic_of(text: Column) -> Column:
    """Coarse topic by the first mark that the text holds."""
    return (
        F.when(F.contains(text, F.lit("Licensed under")), "notice")
        .when(F.contains(text, F.lit(" | ")), "listing")
        .when(F.contains(text, F.lit("@")), "contact")
        .otherwise("prose")
    )


def _targets(cells: DataFrame, dim: str, shares: Mapping[str, float] | None, power: float) -> DataFrame:
    """Target share of each value of `dim`: `shares` where given, and values that it lacks split what it leaves in proportion to their tokens; without `shares`, proportional to tokens ** power."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("n"))
    if shares is None:
        raw = F.pow("n", F.lit(power))
    else:
        named = reduce(lambda e, kv: e.when(F.col(dim) == kv[0], F.lit(float(kv[1]))), shares.items(), F.when(F.lit(False), 0.0))
        left = max(0.0, 1.0 - sum(shares.values()))
        others = sums.where(named.isNull()).agg(F.sum("n").alias("s")).scalar()
        raw = F.coalesce(named, F.col("n") / others * left, F.lit(0.0))
    marked = sums.select(dim, raw.alias("raw"))
    return marked.select(dim, (F.col("raw") / marked.agg(F.sum("raw")).scalar()).alias("target"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """`cells` (dimensions, tokens > 0) with `share`, their raked part of the whole."""
    now = cells
    for dim, t in targets.items():
        now = now.join(t.withColumnRenamed("target", f"t_{dim}").withColumnRenamed(dim, "__v"), F.col(dim).eqNullSafe(F.col("__v"))).drop("__v")
    now = written(now.withColumn("share", F.col("tokens").cast("double")), "raked")
    for _ in range(rounds):
        for dim in targets:
            sums = now.groupBy(F.col(dim).alias("__v")).agg(F.sum("share").alias("__s"))
            scaled = F.when(F.col("__s") > 0, F.col("share") * F.col(f"t_{dim}") / F.col("__s")).otherwise(0.0)
            now = now.join(sums, F.col(dim).eqNullSafe(F.col("__v"))).withColumn("share", scaled).drop("__v", "__s")
        now = written(now, "raked")
    for dim in targets:
        sums = now.groupBy(dim).agg(F.sum("share").alias("s"), F.first(f"t_{dim}").alias("t"))
        off = sums.agg(F.max(F.abs(F.col("s") / sums.agg(F.sum("s")).scalar() - F.col("t"))).alias("off")).first()["off"]
        if off is not None and off > TOLERANCE:
            LOG.warning("%s: after %d rounds a share is off its target by %.2g; the targets contradict each other, or need more rounds", dim, rounds, off)
    return now.select(*cells.columns, "share")


def reachable(wanted: np.ndarray, have: np.ndarray) -> np.ndarray:
    """`wanted` tokens of each value, at most `have`; the others take what a value lacks in proportion to what they want."""
    out, full = wanted.astype(float), np.zeros(len(wanted), bool)
    while (out > have * (1 + 1e-12)).any():
        full |= out > have
        left, rest = wanted.sum() - have[full].sum(), wanted[~full].sum()
        out = np.where(full, have, wanted * (left / rest if rest > 0 else 0.0))
    return out


def filled(tokens: np.ndarray, codes: Sequence[np.ndarray], wanted: Sequence[np.ndarray], rounds: int = 500) -> np.ndarray:
    """What each cell should hold, at most its tokens, so that the sums of each dimension (by `codes`) are `wanted`."""
    share, full = tokens.astype(float), np.zeros(len(tokens), bool)
    while True:
        free = ~full
        left = [np.maximum(0.0, w - np.bincount(c[full], tokens[full], len(w))) for c, w in zip(codes, wanted)]
        for _ in range(rounds):
            before = share.copy()
            for c, w in zip(codes, left):
                sums = np.bincount(c[free], share[free], len(w))
                share[free] *= np.divide(w, sums, out=np.zeros(len(w)), where=sums > 0)[c[free]]
            if np.allclose(share, before, rtol=1e-9, atol=0):
                break
        over = free & (share > tokens * (1 + 1e-9))
        if not over.any():
            return np.minimum(share, tokens)
        full |= over
        share[full] = tokens[full]


def _warn_of_lack(dim: str, value: object, want: float, have: float) -> None:
    LOG.warning("%s %r: the target is %.0f tokens, all that there are is %.0f", dim, value, want, have)


def _filled_ratios(cells: DataFrame, targets: Mapping[str, DataFrame], budget: float) -> DataFrame:
    """`cells` with `ratio`, the part of its tokens that a cell should hold, at most 1."""
    rows = cells.limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        return _filled_table(cells, targets, budget)
    tokens = np.array([r["tokens"] for r in rows], float)
    codes, wanted = [], []
    for dim, t in targets.items():
        share = {r[dim]: r["target"] for r in t.collect()}
        at = {v: i for i, v in enumerate(share)}
        codes.append(np.array([at[r[dim]] for r in rows], np.int64))
        want, have = np.array(list(share.values()), float) * budget * tokens.sum(), np.bincount(codes[-1], tokens, len(at))
        for v, w, h in zip(share, want, have):
            if w > h * (1 + 1e-9):
                _warn_of_lack(dim, v, w, h)
        wanted.append(reachable(want, have))
    ratios = (filled(tokens, codes, wanted) / tokens).tolist() if rows else []
    found = cells.sparkSession.createDataFrame([(*r, x) for r, x in zip(rows, ratios)], f"{_ddl(cells)}, ratio double")
    return written(found, "raked")


def _reachable_table(values: DataFrame) -> DataFrame:
    """`values` (want, have) with `w`, as reachable(); the steps are as many as there are sets of values that lack."""
    now = written(values.withColumns({"w": F.col("want"), "full": F.lit(False)}), "wanted")
    while now.where(F.col("w") > F.col("have") * (1 + 1e-12)).limit(1).count():
        marked = now.withColumn("full", F.col("full") | (F.col("w") > F.col("have")))
        total, held, rest = marked.agg(
            F.sum("want"), F.coalesce(F.sum(F.when(F.col("full"), F.col("have"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~F.col("full"), F.col("want"))), F.lit(0.0))
        ).first()
        scale = (total - held) / rest if rest > 0 else 0.0
        now = written(marked.withColumn("w", F.when(F.col("full"), F.col("have")).otherwise(F.col("want") * scale)), "wanted")
    return now


def _filled_table(cells: DataFrame, targets: Mapping[str, DataFrame], budget: float, rounds: int = 500) -> DataFrame:
    """As the ratios of filled(), over the cells as a table: sums by dimension are joined to them, a round at a time."""
    spark, dims = cells.sparkSession, list(targets)
    whole = cells.agg(F.sum("tokens").cast("double")).first()[0]
    now = cells.withColumns({"share": F.col("tokens").cast("double"), "full": F.lit(False)})
    for dim, t in targets.items():
        have = cells.groupBy(F.col(dim).alias("__v")).agg(F.sum("tokens").cast("double").alias("have"))
        values = have.join(t, F.col("__v").eqNullSafe(F.col(dim))).select("__v", (F.col("target") * budget * whole).alias("want"), "have")
        values = _reachable_table(values)
        for r in values.where(F.col("want") > F.col("have") * (1 + 1e-9)).limit(20).collect():
            _warn_of_lack(dim, r["__v"], r["want"], r["have"])
        now = now.join(values.select("__v", F.col("w").alias(f"w_{dim}")), F.col(dim).eqNullSafe(F.col("__v"))).drop("__v")
    path = new_folder(spark, "raked")
    now = written_to(now, path)
    while True:
        for _ in range(rounds):
            step = now.withColumn("was", F.col("share"))
            for dim in dims:
                free, held = F.sum(F.when(~F.col("full"), F.col("share"))), F.sum(F.when(F.col("full"), F.col("tokens").cast("double")))
                sums = step.groupBy(F.col(dim).alias("__v")).agg(F.coalesce(free, F.lit(0.0)).alias("__s"), F.coalesce(held, F.lit(0.0)).alias("__f"))
                left = F.greatest(F.lit(0.0), F.col(f"w_{dim}") - F.col("__f"))
                scaled = F.when(F.col("full"), F.col("share")).when(F.col("__s") > 0, F.col("share") * left / F.col("__s")).otherwise(0.0)
                step = step.join(sums, F.col(dim).eqNullSafe(F.col("__v"))).withColumn("share", scaled).drop("__v", "__s", "__f")
            after = new_folder(spark, "raked")
            now = written_to(step, after)
            discard(spark, path)
            path = after
            still = now.where(F.abs(F.col("share") - F.col("was")) > 1e-9 * F.col("was")).limit(1).count()
            now = now.drop("was")
            if not still:
                break
        over = ~F.col("full") & (F.col("share") > F.col("tokens") * (1 + 1e-9))
        if not now.where(over).limit(1).count():
            return now.select(*cells.columns, (F.least("share", "tokens") / F.col("tokens")).alias("ratio"))
        after = new_folder(spark, "raked")
        marked = now.withColumn("full", F.col("full") | over).withColumn("share", F.when(F.col("full"), F.col("tokens").cast("double")).otherwise(F.col("share")))
        now = written_to(marked, after)
        discard(spark, path)
        path = after


def _ddl(cells: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema)


def uniform(seed: int, doc_id: Column) -> Column:
    """Number in [0, 1) fixed by seed and id."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def mix(
    docs: DataFrame,
    shares: Mapping[str, Mapping[str, float] | None],
    budget: float,
    seed: int = 42,
    text: str = "text",
    doc_id: str = "doc_id",
    topic: Column | None = None,
    power: float = 0.5,
    rounds: int = ROUNDS,
    fill: bool = False,
) -> DataFrame:
    """`docs` with topic, tokens, probability, weight and sampled.

    shares: for each dimension (columns of `docs`, or "topic") its target
    shares, or None for targets proportional to tokens ** power. budget: the
    part of all tokens that the sample should hold. fill: whether cells beyond
    probability 1 pass on to others what they can't hold.
    """
    dims = list(shares)
    if "tokens" in docs.columns and text not in docs.columns:
        featured = docs  # the caller has counted
    else:
        featured = docs.withColumns({"topic": topic_of(F.col(text)) if topic is None else topic, "tokens": n_words(F.col(text))})
    cells = written(featured.groupBy(*dims).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "cells")
    targets = {d: _targets(cells, d, shares[d], power) for d in dims}
    if fill:
        raked, ratio = _filled_ratios(cells, targets, budget), F.col("ratio")
    else:
        raked = rake(cells, targets, rounds)
        whole = raked.agg(F.sum("share").alias("s"), F.sum("tokens").alias("n"))
        sum_share, sum_tokens = whole.select("s").scalar(), whole.select("n").scalar()
        ratio = F.col("share") / sum_share * F.lit(budget) * sum_tokens / F.col("tokens")
    rates = raked.select(*[F.col(d).alias(f"__{d}") for d in dims], ratio.alias("__ratio"))
    same: Sequence[Column] = [featured[d].eqNullSafe(rates[f"__{d}"]) for d in dims]
    joined = featured.join(rates, reduce(lambda a, b: a & b, same), "left")
    p = F.least(F.coalesce("__ratio", F.lit(0.0)), F.lit(1.0))
    return joined.withColumns(
        {
            "probability": p,
            "weight": F.greatest(F.coalesce("__ratio", F.lit(0.0)), F.lit(1.0)),
            "sampled": uniform(seed, F.col(doc_id)) < p,
        }
    ).drop("__ratio", *[f"__{d}" for d in dims])
