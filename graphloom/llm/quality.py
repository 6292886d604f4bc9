"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Two multinomials over hashed uni- and bigrams are fitted: the raw one counts every document, the target one counts a
bounded number of trusted documents. A document's score is the sum of its n-grams' log ratios over their number plus a
constant (short texts are drawn towards 0). It is kept if the score reaches a fixed threshold and its base signals pass.

All of it is DataFrame code: no Python runs on executors.

Defined results: a null text has no words (all signals 0, base_failed true). Rows are judged one by one, so repeated
rows and repeated or null ids each get a row. An empty table gives an empty result; without trusted documents every log ratio
is 0 and only the base decides. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NONSPACE, let, words_of

#: Buckets of the hashed n-grams: bounds the model (2^14 doubles) whatever the corpus.
BUCKETS = 1 << 14
#: Trusted documents that are counted at most, the first by hash of their id.
TRUSTED = 50_000
#: Added to every bucket's count in both multinomials.
SMOOTHING = 1.0
#: Added to the number of n-grams when a score is normalised.
SHRINK = 50
#: Least score of a kept document, in nats a n-gram: just below the lowest of 20,544 documents labelled good (-0.0546), as junk reaches up to there.
THRESHOLD = -0.06


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 50).cast("int")  # the upper 14 bits


def _pairs(hashes: Column, step: int) -> Column:
    """Hash of each element with the one ``step`` further on; as many fewer elements."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, step + 1, n), lambda a, b: F.xxhash64(a, b))


def _covered(starts_of: Column, width: int) -> Column:
    """Words that the windows found twice or more cover, from the hashes of all windows in order."""
    by_hash = F.array_sort(F.transform(starts_of, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    near = lambda a, x, i: x["h"] == F.coalesce(F.get(a, i)["h"], F.bitwise_not(x["h"]))
    twice = lambda a: F.filter(a, lambda x, i: near(a, x, i - 1) | near(a, x, i + 1))
    starts = let(by_hash, lambda a: F.array_sort(F.transform(twice(a), lambda x: x["i"])))
    after = lambda s: F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0)))
    steps = let(starts, lambda s: F.zip_with(s, after(s), lambda a, b: F.coalesce(F.least(b - a, F.lit(width)), F.lit(width))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)


def repeated_window_words(fours: Column) -> Column:
    """Words covered by windows of 8 words that are found twice or more, from the hashes of all windows of 4 words.

    A window of 8 found twice holds 5 windows of 4 found twice; only texts with as many pay for the rest.
    """
    repeats = lambda h: F.size(h) - F.size(F.array_distinct(h))
    none = F.lit(0).cast("long")
    eights = lambda h: let(_pairs(h, 4), lambda e: F.when(repeats(e) == 0, none).otherwise(_covered(e, 8)))
    return F.when(repeats(fours) < 5, none).otherwise(eights(fours))


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", trusted_bound: int = TRUSTED) -> DataFrame:
    """The model: one row, ``w`` an array of BUCKETS log ratios.

    ``trusted`` has the ids of trusted documents; at most ``trusted_bound`` of them are counted, and that bound is what
    makes it safe to broadcast them. The raw counts are of all documents.
    """
    ids = trusted.select(F.col(id_col).alias("__id")).where(F.col(id_col).isNotNull()).distinct()
    ids = ids.orderBy(F.xxhash64("__id"), "__id").limit(trusted_bound).withColumn("__t", F.lit(1).cast("long"))
    rows = docs.select(F.col(id_col).alias("__id"), words_of(F.col(text_col)).alias("__w")).join(F.broadcast(ids), "__id", "left")
    grams = rows.select(F.coalesce("__t", F.lit(0).cast("long")).alias("t"), F.inline(F.arrays_zip(F.col("__w").alias("a"), F.slice("__w", 2, 2**31 - 1).alias("b"))))
    one = F.xxhash64("a")
    both = grams.select("t", one.alias("one"), F.when(F.col("b").isNotNull(), F.xxhash64(one, F.xxhash64("b"))).alias("two"))
    hashed = both.select("t", F.explode(F.array("one", "two")).alias("h")).where(F.col("h").isNotNull())
    counts = hashed.groupBy(_bucket(F.col("h")).alias("b")).agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
    full = docs.sparkSession.range(0, BUCKETS, 1, 1).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").na.fill(0, ["raw", "target"])
    packed = full.agg(F.sort_array(F.collect_list(F.struct("b", "raw", "target"))).alias("c"))

    def total(name: str) -> Column:
        return F.aggregate("c", F.lit(0).cast("double"), lambda a, x: a + x[name])

    share = lambda x, name, all_: F.log((x[name] + SMOOTHING) / (all_ + SMOOTHING * BUCKETS))
    ratio = lambda x: share(x, "target", F.col("t")) - share(x, "raw", F.col("r"))
    totals = packed.select("c", total("raw").alias("r"), total("target").alias("t"))
    return totals.select(F.transform("c", lambda x: F.when(F.col("t") == 0, F.lit(0.0)).otherwise(ratio(x))).alias("w"))


def weights(model: DataFrame) -> Column:
    """The model's log ratios as one literal: BUCKETS doubles pass through the driver, whatever the corpus."""
    w = model.first()["w"]
    return F.from_json(F.lit("[" + ",".join(repr(float(x)) for x in w) + "]"), "array<double>")


def _judged(docs: DataFrame, model: DataFrame, carried: list[str], text_col: str, threshold: float) -> DataFrame:
    """row (a struct of the carried columns, so that their names are free), and the results."""
    w = weights(model)
    rows = docs.select(F.struct(*carried).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), words_of(F.col(text_col)).alias("words"))
    pair = lambda h: F.struct(h.alias("one"), _pairs(h, 1).alias("two"))
    rows = rows.withColumn("h", let(F.transform("words", lambda x: F.xxhash64(x)), pair))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(NONSPACE))
    h = F.col("h")
    ratios = lambda hashes: F.aggregate(hashes, F.lit(0.0), lambda a, x: a + F.get(w, _bucket(x)))
    rows = rows.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(_pairs(h["two"], 2), repeated_window_words).alias("n_repeat_words"),
        ((ratios(h["one"]) + ratios(h["two"])) / (F.size(h["one"]) + F.size(h["two"]) + F.lit(float(SHRINK)))).alias("score"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def judge(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, score (double,
    nats a n-gram) and kept."""
    return _judged(docs, model, [id_col], text_col, threshold).select("row.*", *RESULTS)


def keep(docs: DataFrame, model: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns."""
    judged = _judged(docs, model, docs.columns, text_col, threshold)
    # A filter on the verdict would be pushed below the projection, and its parts computed anew for each mention; a generator is not.
    rows = judged.select(F.explode_outer(F.when(F.col("kept"), F.array("row"))).alias("row"))
    return rows.where(F.col("row").isNotNull()).select("row.*")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids labelled of good quality and not toxic."""
    return labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select(id_col)
