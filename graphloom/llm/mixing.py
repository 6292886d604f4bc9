"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the output over its share of the input, both in characters. A document's
number of copies is the inverse of the Poisson distribution with that mean at a uniform number that is hashed from seed, id and text, so the
mix is the same in every run and independent of partitions. Copies are exploded and shuffled globally by a hash of their own: dealt by it among partitions, and sorted
by it there. (A range exchange would run the whole plan twice, to sample it.)

All of it is DataFrame code. The only thing broadcast is the table of rates, a row for each source, if it has at most
BROADCAST_SOURCES rows; otherwise it is joined by a shuffle.

Defined results: a null source is a source of its own. A null text has no characters; a source without characters has rate 0, and its
documents go. Equal rows draw the same number and are copied alike. Null ids are hashed as the empty string. An empty table gives an empty
result. Other columns are kept as they are; the result adds none to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

#: Exponent of a source's share of characters in its target weight: 1 keeps the mix, 0 gives all sources the same weight.
TEMPERATURE = 0.5
#: Characters of the output over those of the input.
BUDGET = 1.0
SEED = "mix-1"
#: Most sources whose rates are broadcast.
BROADCAST_SOURCES = 10_000
#: Largest mean that is inverted at once; a larger one is the sum of equal parts with numbers of their own.
PART = 16


def rates(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source", text_col: str = "text", temperature: float = TEMPERATURE, budget: float = BUDGET) -> DataFrame:
    """(source, n_docs, n_chars, weight, rate) over all documents.

    ``weights`` (source, weight: not negative) sets the targets; a source that it lacks has weight 0. By default a source's
    weight is its characters to the power ``temperature``. Weights are normalised over the sources found.
    """
    found = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("n_chars"))
    if weights is None:
        found = found.withColumn("weight", F.when(F.col("n_chars") > 0, F.pow(F.col("n_chars").cast("double"), F.lit(temperature))).otherwise(0.0))
    else:
        found = found.alias("f").join(weights.alias("w"), F.col("f.source").eqNullSafe(F.col("w.source")), "left")
        found = found.select("f.*", F.when(F.col("f.n_chars") > 0, F.coalesce("w.weight", F.lit(0.0)).cast("double")).otherwise(0.0).alias("weight"))
    total = found.agg(F.sum("n_chars").alias("chars"), F.sum("weight").alias("weights"))
    both = found.join(F.broadcast(total))
    share = F.col("weight") / F.col("weights")
    rate = F.when((F.col("n_chars") > 0) & (F.col("weights") > 0), F.lit(float(budget)) * share * F.col("chars") / F.col("n_chars")).otherwise(0.0)
    return both.select("source", "n_docs", "n_chars", (F.when(F.col("weights") > 0, share).otherwise(0.0)).alias("weight"), rate.alias("rate"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the hash of all parts; the same in any SQL with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _distribution(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, ... for a mean of at most PART, until they stand still in double precision."""
    most = PART + 10 * int(PART**0.5) + 30
    one = F.exp(-rate)
    start = F.struct(one.alias("p"), one.alias("sum"), F.array(one).alias("all"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), (a["sum"] + p).alias("sum"), F.concat(a["all"], F.array(a["sum"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda a: a["all"])


def copies(docs: DataFrame, source_rates: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """row (a struct of the columns, so that their names are free), id (as text), hash (of the text), rate and copies (int)."""
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    table = source_rates.select(F.col("source").alias("s"), "rate", parts.alias("parts"), let(F.col("rate") / parts, _distribution).alias("cdf"))
    table = written(table, "rates")
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    id_, hash_ = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).alias("source"), id_.alias("id"), hash_.alias("hash"))
    joined = rows.join(table, F.col("source").eqNullSafe(F.col("s")), "left")
    draw = lambda j: _uniform(F.lit(seed), F.col("id"), F.col("hash"), j.cast("string"))
    # The least k whose cumulative probability is above the number: as many entries as are not above it.
    inverse = lambda u: F.size(F.filter(F.col("cdf"), lambda c: c <= u))
    n = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda a, j: a + let(draw(j), inverse))
    return joined.select("row", "source", "id", "hash", "rate", F.when(F.col("rate") > 0, n).otherwise(0).alias("copies"))


def _placed(counted: DataFrame, seed: str) -> DataFrame:
    """Exploded copies: copy (int, from 0) and place, the hash by which they are shuffled."""
    out = counted.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    key = F.concat_ws("|", F.lit(seed + "-place"), "id", "hash", F.col("copy").cast("string"))
    return out.withColumn("place", F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long"))


def draws(docs: DataFrame, source_rates: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """A row for each copy in the mix: doc_id, source, rate, copy (from 0) and place (long), dealt among partitions by place and sorted there."""
    placed = _placed(copies(docs, source_rates, id_col, source_col, text_col, seed), seed)
    out = placed.select(F.col("row")[id_col].alias("doc_id"), "source", "rate", "copy", "place")
    return out.repartition("place").sortWithinPartitions("place", "doc_id", "copy")


def mix(docs: DataFrame, source_rates: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """The mixed table: each document as often as drawn, in a global random order, with the columns of ``docs``."""
    placed = _placed(copies(docs, source_rates, id_col, source_col, text_col, seed), seed)
    return placed.select("row", "place").repartition("place").sortWithinPartitions("place").select("row.*")


def draws_sql(temperature: float = TEMPERATURE, budget: float = BUDGET, seed: str = SEED, docs: str = "documents") -> str:
    """DuckDB SQL for ``draws`` with default weights (means up to PART)."""
    most = PART + 10 * int(PART**0.5) + 30
    return f"""
WITH RECURSIVE found AS (
  SELECT source, count(*) AS n_docs, coalesce(sum(length(text)), 0) AS n_chars,
         CASE WHEN coalesce(sum(length(text)), 0) > 0 THEN pow(sum(length(text))::DOUBLE, {temperature}) ELSE 0.0 END AS weight
  FROM {docs} GROUP BY source),
total AS (SELECT sum(n_chars)::DOUBLE AS chars, sum(weight) AS weights FROM found),
rates AS (
  SELECT source, CASE WHEN n_chars > 0 AND weights > 0 THEN {budget!r} * (weight / weights) * chars / n_chars ELSE 0.0 END AS rate FROM found, total),
steps AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM steps WHERE k < {most}),
cdf AS (SELECT source, rate, list(c ORDER BY k) AS cdf FROM steps GROUP BY source, rate),
drawn AS (
  SELECT d.doc_id, d.source, c.rate, md5(coalesce(d.text, '')) AS h,
         CASE WHEN c.rate > 0 THEN len(list_filter(c.cdf, lambda x: x <= ('0x' || substr(md5('{seed}|' || coalesce(d.doc_id::VARCHAR, '') || '|' || md5(coalesce(d.text, '')) || '|1'), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)!r})) ELSE 0 END AS n
  FROM {docs} d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source),
copies AS (SELECT doc_id, source, rate, h, unnest(range(0, n))::INTEGER AS copy FROM drawn)
SELECT doc_id, source, round(rate, 9) AS rate, copy,
       ('0x' || substr(md5('{seed}-place|' || coalesce(doc_id::VARCHAR, '') || '|' || h || '|' || copy::VARCHAR), 1, 13))::BIGINT AS place
FROM copies
"""
