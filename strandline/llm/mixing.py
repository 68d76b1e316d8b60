"""Mixing sources to target weights by Poisson replication, with native functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialize

SEED = 17
#: Without weights of its own, a source's target is its share to this power.
TEMPERATURE = 0.5
#: Means up to this come from one uniform; larger ones are sums of equal Poisson parts, so a distribution stays a short array.
MAX_RATE = 16.0


def uniform(*parts: Column | str) -> Column:
    """In [0, 1): the first 52 bits of the MD5 of the parts, which any engine can recompute."""
    joined = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_steps(rate: Column, terms: int = 64) -> Column:
    """P(X <= k) for k = 0, 1, ... of a Poisson variable with this mean (at most MAX_RATE)."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step)["all"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, n, rate, parts, steps): mean repetitions that give each source its target share of the rows.

    Target shares are the given weights (sources without one get weight zero) or
    the shares to the power of the temperature, scaled to sum to one. The mixed
    size equals the input's in expectation. A rate is shared by parts of at most
    MAX_RATE; steps are those of one part. Null is a source of its own. One row
    a source, after partial counts.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for name, w in sorted(weights.items()):
            weight = F.when(F.col("source") == name, float(w)).otherwise(weight)
    weighed = materialize(sizes.withColumn("w", weight), "mix-sizes")
    all_w, all_n = weighed.agg(F.sum("w"), F.sum("n")).first()
    rate = F.col("w") / F.lit(all_w) * F.lit(all_n) / F.col("n") if all_w else F.lit(0.0)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(MAX_RATE)).cast("int"))
    return weighed.select("source", "n", rate.alias("rate")).withColumn("parts", parts).withColumn("steps", poisson_steps(F.col("rate") / F.col("parts")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """docs' rows repeated by a hash-seeded Poisson count, in a global random order.

    Adds rate, n_copies, copy (from 0) and mix_key, the hash by which rows are
    range-partitioned and sorted; columns of docs with one of these four names
    are replaced, all others stay. A row's count depends on the seed and doc_id
    alone, so reruns and lost tasks repeat it. Counts of zero leave a row out:
    that is the method's sampling. Rows with a null doc_id share one hash;
    repeated rows repeat together. An empty table gives an empty result.
    """
    columns = [f"`{c}`" for c in docs.columns if c.lower() not in ("rate", "n_copies", "copy", "mix_key")]
    rates = materialize(source_rates(docs, weights, temperature), "mix-rates").select(
        F.col("source").alias("__mix_source"), F.col("rate").alias("__mix_rate"), F.col("parts").alias("__mix_parts"), F.col("steps").alias("__mix_steps")
    )
    own_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    below = lambda u: F.size(F.filter("__mix_steps", lambda c: u >= c))
    more = F.aggregate(F.sequence(F.lit(2), F.col("__mix_parts")), F.lit(0), lambda n, i: n + below(uniform(F.lit(seed), own_id, i)))
    count = below(F.col("__mix_u")) + F.when(F.col("__mix_parts") > 1, more).otherwise(0)
    counted = (
        docs.select(*columns).withColumn("__mix_u", uniform(F.lit(seed), own_id))
        .join(rates, F.col("source").eqNullSafe(F.col("__mix_source")))
        .withColumn("n_copies", count)
        .filter("n_copies > 0")
    )
    copies = counted.select(*columns, F.col("__mix_rate").alias("rate"), "n_copies", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"))
    keyed = copies.withColumn("mix_key", F.xxhash64(F.lit(seed), "doc_id", "copy"))
    return keyed.orderBy("mix_key", "doc_id", "copy")


ORACLE = f"""
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, pow(CAST(n AS DOUBLE), {TEMPERATURE}) AS w FROM sizes),
r AS (SELECT source, n, w / (SELECT sum(w) FROM w) * (SELECT sum(n) FROM w) / n AS rate FROM w),
q AS (SELECT *, greatest(1, CAST(ceil(rate / {MAX_RATE}) AS INTEGER)) AS parts FROM r),
k AS (SELECT source, i, exp(-rate / parts + CASE WHEN i = 0 THEN 0 ELSE i * ln(rate / parts) END - lgamma(i + 1)) AS p FROM q, range(0, 65) t(i)),
s AS (SELECT source, list(upto ORDER BY i) AS steps FROM (SELECT source, i, sum(p) OVER (PARTITION BY source ORDER BY i) AS upto FROM k) GROUP BY source),
e AS (SELECT q.source, q.rate, q.parts, s.steps FROM q JOIN s ON q.source IS NOT DISTINCT FROM s.source),
u AS (SELECT d.*, e.rate, e.steps, unnest(range(1, e.parts + 1)) AS part FROM documents d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
h AS (SELECT *, CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || CASE WHEN part = 1 THEN '' ELSE '|' || part END), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM u),
m AS (SELECT doc_id, text, lang, source, n_chars, rate, sum(len(list_filter(steps, lambda c: h.u >= c))) AS n_copies FROM h GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS rate, CAST(n_copies AS INTEGER) AS n_copies, CAST(unnest(range(0, CAST(n_copies AS BIGINT))) AS INTEGER) AS copy FROM m
"""
