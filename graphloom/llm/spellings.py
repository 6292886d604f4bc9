"""Spelling variants: words that differ by one code point, by two-dimensional range reporting.

Words of one length are points: their rank in alphabetical order, and their rank in the order of the words read backwards. For a word and an edit position, the
words with the same beginning are an interval of the first order, those with the same end an interval of the second; the points in both are the words that differ at
that position only. A wavelet tree reports them. Replaced code points are sought among words of the same length, inserted ones among words that are one longer;
deletions are insertions seen from the other word.

So that no task needs all words, edit positions are cut into regions: words that differ in a region agree before and behind it, and meet in the group of what they agree in.
At first there are two regions (same first half, same second half). Groups with more than GROUP words are dealt again with each region cut in two, until regions are one position
long; then a group's words differ by one code point in one place, of which there are 90 at most. Small groups share tasks. Pairs never leave a task: it passes on, for each word, how
many near words it has and the most frequent one.

Words are letters of a-z and U+00C0 to U+00FF, so a byte each.

Defined results: a null text has no words, a null id is written as an empty string; each row counts, also if repeated. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, written
from .wavelet import WaveletTree

#: Code points and occurrences of a word at least, how many times more frequent its form is; one occurrence in DROPPED loses a code point.
LENGTH, TIMES, RATIO, DROPPED = 7, 2, 10, 31
#: Words of a group from which its regions are cut; rows of a task, about; lengths that are dealt on their own; queries at a time; distinct words counted at a time; characters of a text at a time.
GROUP, TASK_ROWS, LENGTHS, QUERIES, HELD, PART = 20_000, 40_000, 64, 1 << 17, 400_000, 1 << 22

#: Letters as they are, A-Z in lower case, and blanks for the rest.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_NO_LETTER = re.compile(r"[^A-Za-zÀ-ÿ]")


def runs(text: str, most: int = PART) -> Iterator[list[bytes]]:
    """The runs of letters of a text, lower-cased, in Latin-1; a long text comes in parts, cut beside a run."""
    at = 0
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text):
            found = _NO_LETTER.search(text, end)
            end = found.start() if found else len(text)
        yield text[at:end].encode("latin-1", "replace").translate(_LETTERS).split()
        at = end


def _count(most: int, part_of: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text) -> (word, n)."""
        total: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                begun, held = zlib.crc32(f"{'' if doc is None else doc}:".encode()), Counter()
                for part in runs(text.as_py() or "", part_of):
                    held.update(w for w in part if len(w) >= LENGTH)
                for w, n in held.items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), begun)
                    if h % DROPPED == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < LENGTH:
                            continue
                    total[w] = total.get(w, 0) + n
                if len(total) >= most:
                    yield flush()
        if total:
            yield flush()

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of at least LENGTH code points and TIMES occurrences."""
    arrow_batches(docs.sparkSession, 4000)
    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return one.mapInArrow(_count(HELD, PART), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


class _Index:
    """Distinct words of one length m: a row of bytes each, in alphabetical order; the order read backwards; and the points of both."""

    def __init__(self, rows: np.ndarray, n: np.ndarray):
        self.m = rows.shape[1]
        order = np.argsort(_strings(rows, self.m), kind="stable")
        self.rows, self.n = np.ascontiguousarray(rows[order]), n[order]
        self.back = np.ascontiguousarray(self.rows[:, ::-1])
        self.by_end = np.argsort(_strings(self.back, self.m), kind="stable")
        self.ends = np.ascontiguousarray(self.back[self.by_end])
        rank = np.empty(len(rows), dtype=np.int64)
        rank[self.by_end] = np.arange(len(rows))
        self.rank, self.tree = rank, WaveletTree(rank)


def _strings(rows: np.ndarray, m: int) -> np.ndarray:
    """The first m bytes of each row, as strings that compare as a whole."""
    return np.ndarray(len(rows), dtype=f"S{m}", buffer=rows, strides=(rows.shape[1],))


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each two rows (of the shorter width)."""
    width = min(a.shape[1], b.shape[1])
    out = np.empty(len(a), dtype=np.int64)
    step = max(1, (32 << 20) // max(width, 1))
    for k in range(0, len(a), step):
        differ = a[k : k + step, :width] != b[k : k + step, :width]
        out[k : k + step] = np.where(differ.any(1), differ.argmax(1), width)
    return out


def _reach(words: np.ndarray, among: np.ndarray, same: bool) -> np.ndarray:
    """For each word the longest beginning that it shares with one of the sorted rows ``among`` (with another one, if these are its own, in the same order)."""
    if same:
        near = _alike(words[1:], words[:-1])
        out = np.zeros(len(words), dtype=np.int64)
        out[1:] = near
        out[:-1] = np.maximum(out[:-1], near)
        return out
    at = np.searchsorted(_strings(among, among.shape[1]), _strings(words, words.shape[1]))
    return np.maximum(*(np.where((p >= 0) & (p < len(among)), _alike(words, among[np.clip(p, 0, len(among) - 1)]), 0) for p in (at - 1, at)))


def _interval(rows: np.ndarray, words: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted rows begin as the words do, for m bytes."""
    if not m:
        return np.zeros(len(words), np.int64), np.full(len(words), len(rows), np.int64)
    cut, want = np.ascontiguousarray(_strings(rows, m)), np.ascontiguousarray(_strings(words, m))
    return np.searchsorted(cut, want, "left"), np.searchsorted(cut, want, "right")


def near(short: _Index, among: _Index, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of short, row of among) that differ by one edit at a position from ``begin`` to before ``end``: a replaced code point, if both have words of one length,
    or one that the second has more. Replacements come twice, once from either word; of equal code points in a row the first counts as the inserted one."""
    same = among is short
    length = short.m
    first = _reach(short.rows, among.rows, same)
    last = np.empty(len(short.rows), dtype=np.int64)
    last[short.by_end] = _reach(short.ends, among.ends, same)
    out: tuple = ([], [])
    low, high = np.maximum(begin, length - int(same) - last), np.minimum(first, min(end, length + 1 - int(same)) - 1)
    if not len(low) or low.min() > high.max():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    for i in range(int(low.min()), int(high.max()) + 1):
        who = np.flatnonzero((low <= i) & (i <= high))
        for k in range(0, len(who), QUERIES):
            w = who[k : k + QUERIES]
            lo, hi = _interval(among.rows, np.ascontiguousarray(short.rows[w]), i)
            least, most = _interval(among.ends, np.ascontiguousarray(short.back[w]), length - i - int(same))
            query, rank = among.tree.report(lo, hi, least, most)
            x, y = w[query], among.by_end[rank]
            if same:
                keep = x != y
            else:
                keep = np.ones(len(x), bool) if i == 0 else short.rows[x, i - 1] != among.rows[y, i]
            out[0].append(x[keep])
            out[1].append(y[keep])
    return tuple(np.concatenate(c) if c else np.empty(0, np.int64) for c in out)


_PARTIAL = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _rows(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), -1)


def _nearest(key: tuple, table: pa.Table) -> pa.Table:
    """Groups of words -> for each word how many near words it has in them, and the most frequent of these (the first in order, if several)."""
    length, begin, end, n = (table[c].to_numpy() for c in ("length", "begin", "end", "n"))
    words = [w.encode("latin-1") for w in table["word"].to_pylist()]
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.lexsort((size, end, begin, length))
    classes = np.stack([length, begin, end])[:, order]
    cuts = [0, *(np.flatnonzero((classes[:, 1:] != classes[:, :-1]).any(0)) + 1).tolist(), len(order)]
    outs: tuple = ([], [], [], [])

    def told(index: _Index, own: np.ndarray, other: _Index, others: np.ndarray) -> None:
        """Adds the counts and best of ``own`` rows, which are near to ``others``."""
        if not len(own):
            return
        by = np.lexsort((others, -other.n[others], own))  # rows are in order, so a lower row is a lesser word
        mine, theirs = own[by], others[by]
        at = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        outs[0].extend(x.tobytes().decode("latin-1") for x in index.rows[mine[at]])
        outs[1].append(np.diff(np.append(at, len(mine))))
        outs[2].append(other.n[theirs[at]])
        outs[3].extend(x.tobytes().decode("latin-1") for x in other.rows[theirs[at]])

    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        part, m = order[a:b], int(length[order[a]])
        sides = [part[size[part] == m], part[size[part] == m + 1]]
        if not len(sides[0]):
            continue
        span = int(begin[part[0]]), int(end[part[0]])
        short, long_ = (_Index(_rows([words[k] for k in s.tolist()]), n[s]) if len(s) else None for s in sides)
        x, y = near(short, short, *span)
        told(short, x, short, y)
        if long_ is not None:
            x, y = near(short, long_, *span)
            told(short, x, long_, y)
            told(long_, y, short, x)
    ints = lambda c: pa.array(np.concatenate(c).astype(np.int64) if c else np.empty(0, np.int64))
    return pa.table([pa.array(outs[0], pa.string()), ints(outs[1]), ints(outs[2]), pa.array(outs[3], pa.string())], schema=_PARTIAL)


def _grouped(members: DataFrame) -> DataFrame:
    """Adds the group's key: what a word has before and behind the region, for pairs of which the shorter word has ``length``."""
    behind = F.greatest(F.col("length") - F.col("end"), F.lit(0))
    key = F.concat_ws(" ", "length", "begin", "end", F.substring(F.col("word"), F.lit(1), F.col("begin")), F.right("word", behind))
    return members.withColumn("key", key)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) for the words (word, n) that have near ones: how many, and the most frequent of them with its number."""
    size = F.char_length("word")
    # A word stands among pairs whose shorter word is as long as it is, or one shorter.
    lengths = F.explode(F.array(size, size - 1))
    half = F.floor(F.col("length") / 2).cast("int")
    regions = F.array(F.struct(F.lit(0).alias("begin"), half.alias("end")), F.struct(half.alias("begin"), (F.col("length") + 1).alias("end")))
    now = words.select("word", "n", lengths.alias("length")).where(F.col("length") >= LENGTH).select("*", F.explode(regions).alias("x")).select("word", "n", "length", "x.*")
    ready = []
    while True:
        now = written(_grouped(now), "members")
        sizes = now.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
        large = written(sizes.where((F.col("members") > GROUP)).select("key"), "crowded")
        many = large.count()
        if not many:
            ready.append(now)
            break
        # Few of all groups are large; their number is bounded by the rows over GROUP.
        ready.append(now.join(large, "key", "left_anti").unionByName(now.join(large, "key").where(F.col("end") - F.col("begin") <= 1)))
        cut = now.join(large, "key").where(F.col("end") - F.col("begin") > 1)
        middle = F.floor((F.col("begin") + F.col("end")) / 2).cast("int")
        halves = F.array(F.struct(F.col("begin"), middle.alias("end")), F.struct(middle.alias("begin"), F.col("end")))
        now = cut.select("word", "n", "length", F.explode(halves).alias("x")).select("word", "n", "length", "x.*")
    every = ready[0]
    for r in ready[1:]:
        every = every.unionByName(r)
    # Words of one length share tasks, as many as their rows ask for; very long ones share theirs.
    kind = F.least("length", F.lit(LENGTHS))
    counts = {r["kind"]: r["n"] for r in every.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.element_at(F.create_map(*[F.lit(x).cast("int") for k, n in counts.items() for x in (k, -(-n // TASK_ROWS))]), kind) if counts else F.lit(1)
    dealt = every.withColumn("kind", kind).withColumn("part", F.pmod(F.xxhash64("key"), parts).cast("int"))
    found = dealt.select("kind", "part", "word", "n", "length", "begin", "end").groupBy("kind", "part").applyInArrow(_nearest, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("x")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("x.less")).alias("best_n"), F.col("x.best").alias("best"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each word: word, form, root, n, n_near, form_n."""
    words = written(vocabulary(docs, id_col, text_col), "vocabulary")
    is_form = F.col("best_n") >= F.col("n") * RATIO
    joined = words.join(neighbours(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    every = written(joined, "forms")
    # A form is RATIO times as frequent, so the way to the root has few steps; each round doubles the steps taken.
    roots = every.where("form is not null").select("word", F.col("form").alias("root"))
    steps = int(math.log(max(words.agg(F.max("n")).first()[0] or 1, 1), RATIO)) + 1
    for _ in range(math.ceil(math.log2(max(steps, 1)))):
        roots = written(roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return every.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def sql() -> str:
    """The same in DuckDB, by what words have left when a code point is deleted."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(0, 256) r(i)),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{upper}', '{lower}') AS run FROM documents),
held AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LENGTH} GROUP BY ALL),
hexed AS (SELECT run, n, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS x FROM held),
bytes AS (SELECT run, n, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT) AS b FROM hexed),
hashed AS (SELECT run, n, xor(list_reduce(b, lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, crc),
spelled AS (SELECT CASE WHEN h % {DROPPED} = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(n) >= {TIMES}),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, c.word, c.n FROM words w JOIN cut c ON c.rest = w.word
  UNION SELECT c.word, w.word, w.n FROM words w JOIN cut c ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n FROM near GROUP BY word),
forms AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {RATIO} * words.n THEN other END AS form, CASE WHEN other_n >= {RATIO} * words.n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
way AS (
  SELECT word, form AS root FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT way.word, forms.form FROM way JOIN forms ON forms.word = way.root WHERE forms.form IS NOT NULL),
roots AS (SELECT way.word, way.root FROM way JOIN forms ON forms.word = way.root WHERE forms.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near::BIGINT AS n_near, form_n FROM forms LEFT JOIN roots USING (word)
"""
