"""Phrase collocations by level-wise passes (Apriori).

Pass 1 counts words by language. Pass 2 emits 2-grams whose words are both frequent, pass 3 emits 3-grams whose two overlapping 2-grams are both
frequent, and the frequent 2-grams themselves. What is frequent is told to all tasks as a bitmap of hashes of a fixed size: a gram whose hash falls on a frequent one's is emitted
besides and counted in vain, so the bitmap prunes and the counts decide; results are exact, and the broadcast does not grow with the data. 2-grams are first counted by
64-bit hashes, which bound the counts from above, and by their words only where the hash is frequent. Cuts are scored by joins with the level tables.

Tasks count within batches of text before anything is shuffled. Keys are grams, so the hottest key has one row a batch; the ranking of a language takes its best rows in
salted parts first.

Scores are floor(1000000 * a * a / (l * r)) in 38-digit decimals, exact for counts below 10^15.

Defined results: a null text is empty, a null language is `und`. Each row counts, also if repeated, and whatever its id. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, written
from .rolling import mix, odd, word_hashes

#: Least count of a phrase; share, in hundredths of its count, from which a longer one replaces it; rows of a language.
LEAST, COVERED, TOP = 10, 50, 2000
#: Binary logarithm of the bits of a pass's bitmap (16 MB); bytes of text that are counted at a time; parts of a language's ranking.
BITS, BATCH, SALTS = 27, 4_000_000, 64
#: Stands between pieces: a capital letter, which no lower-cased word has.
GAP = "A"

_U = np.uint64


class _Grams:
    """Words of a batch of texts in order, by number; -1 is a gap between pieces."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        low = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        low = pc.replace_substring(pc.replace_substring_regex(low, r"[.,;:!?\x0A-\x0D]", f" {GAP} "), "\t", " ")
        lists = pc.split_pattern(pc.binary_join_element_wise(low, *(pa.scalar(x, pa.large_string()) for x in (f" {GAP}", ""))), " ")
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        number = np.full(len(names), -2, dtype=np.int64)  # -2: nothing, between two blanks
        real = [k for k, w in enumerate(names) if w not in ("", GAP)]
        number[real] = np.arange(len(real))
        number[[k for k, w in enumerate(names) if w == GAP]] = -1
        word = number[coded.indices.to_numpy()] if len(names) else np.empty(0, np.int64)
        tongue = pc.fill_null(langs, "und").dictionary_encode()
        count = np.diff(lists.offsets.to_numpy())
        lang = np.repeat(tongue.indices.to_numpy().astype(np.int64), count)
        held = word > -2
        self.word, self.lang = word[held], lang[held]
        self.words, self.langs = coded.dictionary.take(pa.array(real, pa.int64())), tongue.dictionary
        # Hash of a word in its language.
        own = word_hashes([names[k].encode().replace(b" ", b"\t") for k in real])
        tongues = word_hashes([x.encode().replace(b" ", b"\t") for x in self.langs.to_pylist()])
        with np.errstate(over="ignore"):
            self.hash = mix(own[self.word] + tongues[self.lang] * _U(0x9E3779B97F4A7C15)) if len(real) else np.zeros(len(self.word), _U)

    def pairs(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where 2-grams of frequent words start, and their hashes."""
        ok = (self.word >= 0) & has(frequent, self.hash)
        at = np.flatnonzero(ok[:-1] & ok[1:])
        a, b = odd(31, 2)
        with np.errstate(over="ignore"):
            return at, mix(self.hash[at] * a + self.hash[at + 1] * b)


def has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h >> _U(65 - (8 * len(bitmap)).bit_length())
    return (bitmap[(bit >> _U(3)).astype(np.int64)] >> (bit & _U(7)).astype(np.uint8)) & 1 == 1


def _lots(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[_Grams]:
    held, size = [], 0

    def flush() -> _Grams:
        t = pa.Table.from_batches(held)
        langs = pa.concat_arrays([x.cast(pa.string()) for x in t.column("lang").chunks])
        return _Grams(pa.concat_arrays([x.cast(pa.large_string()) for x in t.column("text").chunks]), langs)

    for batch in batches:
        lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:  # as many rows as there is room for, and one at least
            end = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + most - size, "right")))
            held.append(batch.slice(at, end - at))
            size += int(lengths[end - 1] - (lengths[at - 1] if at else 0)) + end - at
            at = end
            if size >= most or at < batch.num_rows:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _counted_words(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """-> (lang, phrase, h, n); a language's words in all have an empty phrase."""
        for g in _lots(batches, most):
            real = g.word >= 0
            key, first, n = np.unique(g.lang[real] * max(len(g.words), 1) + g.word[real], return_index=True, return_counts=True)
            at = np.flatnonzero(real)[first]
            every = np.bincount(g.lang[real], minlength=len(g.langs))
            some = np.flatnonzero(every)
            lang = np.concatenate([g.lang[at], some])
            phrase = pa.concat_arrays([g.words.take(pa.array(g.word[at])), pa.array([""] * len(some), g.words.type)])
            h = np.concatenate([g.hash[at], np.zeros(len(some), _U)])
            yield pa.record_batch([g.langs.take(pa.array(lang)), phrase.cast(pa.string()), pa.array(h.view(np.int64)), pa.array(np.concatenate([n, every[some]]).astype(np.int64))], names=["lang", "phrase", "h", "n"])

    return run


def _hashed_pairs(frequent, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """-> (h, n): 2-grams by hash."""
        bitmap = np.frombuffer(frequent.value, dtype=np.uint8)
        for g in _lots(batches, most):
            h, n = np.unique(g.pairs(bitmap)[1], return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return run


def _counted_grams(frequent, frequent_pairs, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """-> (lang, phrase, k, n) of frequent 2-grams and of 3-grams that consist of two."""
        words, pairs = (np.frombuffer(x.value, dtype=np.uint8) for x in (frequent, frequent_pairs))
        for g in _lots(batches, most):
            at, h = g.pairs(words)
            at = at[has(pairs, h)]
            d = max(len(g.words), 1)
            _, first, pair, n = np.unique((g.lang[at] * d + g.word[at]) * d + g.word[at + 1], return_index=True, return_inverse=True, return_counts=True)
            blank = pa.scalar(" ", g.words.type)
            spelled = lambda where, k: pc.binary_join_element_wise(*[g.words.take(pa.array(g.word[where + j])) for j in range(k)], blank)
            yield _gram_rows(g, at[first], spelled(at[first], 2), 2, n)
            two = np.flatnonzero(at[1:] == at[:-1] + 1)
            _, first, n = np.unique(pair[two] * d + g.word[at[two] + 2], return_index=True, return_counts=True)
            where = at[two[first]]
            yield _gram_rows(g, where, spelled(where, 3), 3, n)

    return run


def _gram_rows(g: _Grams, where: np.ndarray, phrase: pa.Array, k: int, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([g.langs.take(pa.array(g.lang[where])), phrase.cast(pa.string()), pa.array(np.full(len(where), k, np.int32)), pa.array(n.astype(np.int64))], names=["lang", "phrase", "k", "n"])


def _bitmap(spark: SparkSession, hashes: DataFrame):
    """The bitmap of the hashes ``h``, as a broadcast: 2^BITS bits, whatever the number of rows."""
    bit = F.shiftrightunsigned("h", 64 - BITS)
    parts = hashes.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 32768).alias("part")).agg(F.expr("bitmap_construct_agg(bit % 32768)").alias("bits"))
    out = bytearray(1 << (BITS - 3))
    for row in parts.collect():
        out[row["part"] * 4096 : row["part"] * 4096 + 4096] = row["bits"]
    return spark.sparkContext.broadcast(bytes(out))


def levels(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Tables (lang, phrase, n) of the words, with every language's count of all words at the empty phrase, and (lang, phrase, k, n) of 2- and 3-grams; all with n of at least ``least``,
    but for the totals."""
    spark = docs.sparkSession
    arrow_batches(spark, 1000)
    one = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counted = one.mapInArrow(_counted_words(BATCH), "lang string, phrase string, h long, n long").groupBy("lang", "phrase").agg(F.first("h").alias("h"), F.sum("n").alias("n"))
    words = written(counted.where((F.col("n") >= least) | (F.col("phrase") == "")), "words")
    frequent = _bitmap(spark, words.where("phrase <> ''"))
    hashed = one.mapInArrow(_hashed_pairs(frequent, BATCH), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    frequent_pairs = _bitmap(spark, hashed)
    grams = one.mapInArrow(_counted_grams(frequent, frequent_pairs, BATCH), "lang string, phrase string, k int, n long")
    grams = written(grams.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "grams")
    return words.select("lang", "phrase", "n"), grams


def _part(k: int, words: range) -> Column:
    """Words of the phrase of k words, joined by one space."""
    if len(words) == k:
        return F.col("phrase")
    return F.substring_index(F.col("phrase"), " ", len(words)) if words.start == 0 else F.substring_index(F.col("phrase"), " ", -len(words))


def scores(words: DataFrame, grams: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, k, a) with the l, r and score of their lowest cut."""
    parts = words.select("lang", "phrase", "n").where("phrase <> ''").unionByName(grams.where("k = 2").select("lang", "phrase", "n"))
    cuts = lambda k: F.array(*[F.struct(F.lit(c).alias("cut"), _part(k, range(c)).alias("left"), _part(k, range(c, k)).alias("right")) for c in range(1, k)])
    cut = grams.select("lang", "phrase", "k", F.col("n").alias("a"), F.explode(F.when(F.col("k") == 2, cuts(2)).otherwise(cuts(3))).alias("x")).select("lang", "phrase", "k", "a", "x.*")
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    scored = cut.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    square, product = "cast(a AS decimal(15, 0)) * cast(a AS decimal(15, 0))", "cast(l AS decimal(15, 0)) * cast(r AS decimal(15, 0))"
    # A score is at most a million, as a part is as frequent as the phrase at least.
    scored = scored.withColumn("score", F.expr(f"cast(cast(1000000 AS decimal(7, 0)) * ({square}) AS decimal(38, 0)) div ({product})"))
    lowest = scored.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    return lowest.select("lang", "phrase", "k", "a", "x.l", "x.r", "x.score")


def uncovered(candidates: DataFrame, share: int = COVERED) -> DataFrame:
    """The candidates but for those inside a longer candidate that has at least ``share`` hundredths of their occurrences."""
    longer = candidates.where("k = 3").select("lang", F.explode(F.array(_part(3, range(2)), _part(3, range(1, 3)))).alias("phrase"), F.col("a").alias("longer"))
    most = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    joined = candidates.join(most, ["lang", "phrase"], "left")
    return joined.where((F.col("k") == 3) | F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)).drop("longer")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    words, grams = levels(docs, text_col, lang_col, least)
    kept = uncovered(scores(words, grams))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = parted.withColumn("x", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("x") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = words.where("phrase = ''").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def sql(least: int = LEAST, share: int = COVERED, top: int = TOP) -> str:
    """The same in DuckDB."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cuts = " UNION ALL ".join(
        f"SELECT g.lang, g.phrase, g.k, g.n AS a, {c} AS cut, x.n AS l, y.n AS r FROM g JOIN g0 x ON x.lang = g.lang AND x.phrase = array_to_string(g.words[1:{c}], ' ') "
        f"JOIN g0 y ON y.lang = g.lang AND y.phrase = array_to_string(g.words[{c + 1}:{k}], ' ') WHERE g.k = {k}"
        for c, k in combinations((1, 2, 3), 2)
    )
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
spread AS (
  SELECT lang, 1 AS k, unnest(words) AS phrase FROM listed
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM listed
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) FROM listed),
g0 AS (SELECT lang, k, phrase, count(*) AS n FROM spread GROUP BY ALL HAVING count(*) >= {least}),
totals AS (SELECT lang, count(*) AS n FROM spread WHERE k = 1 GROUP BY lang),
g AS (SELECT *, string_split(phrase, ' ') AS words FROM g0 WHERE k > 1),
cuts AS ({cuts}),
scored AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS phrase, n FROM g WHERE k = 3),
most AS (SELECT lang, phrase, max(n) AS longer FROM longer GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN most USING (lang, phrase) WHERE k = 3 OR longer IS NULL OR 100 * longer < {share} * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, totals.n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {top}
"""
