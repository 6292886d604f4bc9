"""License scans: TF-IDF cosine of headers and licence files to license templates, and inheritance from the nearest ancestor directory.

A text is looked at as a whole (a licence file), by passages (neighbouring blocks of lines that hold words of licenses: a header), by blocks (lines up to an empty
one) and by lines. Each is a sparse vector of term frequency and inverse document frequency, which is counted over all texts for all words, hashed into
BUCKETS. It is compared with each template by cosine: the full texts, their blocks, and one-line notices. A text's own license is
that of its largest piece that reaches the threshold, so that a shared clause does not decide for a file as a whole. A file without one inherits from the nearest
directory above it that holds a licence file, by joins on path prefixes.

All of it is DataFrame code. What is broadcast is bounded: BUCKETS weights, and a weight for each word of the templates.

Pieces that cannot reach the threshold are not vectorised: by Cauchy-Schwarz the cosine to a template is at most the share of the template's length
that lies on the words they share, so a piece that has only a template's common words is below it (``needed_words``). Nothing else is skipped.

Defined results: null texts and paths are empty; an empty path has no directory. Ties go to the higher cosine, then the first template by name, then the first
piece. Rows are judged one by one, so repeated rows and null ids each get a row. If a directory holds several licence files, the one
with the highest cosine counts, then the least path. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let
from .license_texts import TEMPLATES

#: Least cosine of a piece that is a license.
THRESHOLD = 0.6
#: Buckets of hashed words with a document frequency.
BUCKETS = 1 << 16
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
#: What separates blocks: a line without a letter or digit.
BLANK = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)([.\-_][^/]*)?$"
#: Pieces, the largest first.
PIECES = ("file", "passage", "block", "line")
#: Copies of a directory's license among which the files of the directory are dealt.
SALTS = 32


def _terms(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def notices(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> list[tuple[str, str]]:
    """(identifier, text) of each template, its blocks where it has several, and its SPDX line; by identifier."""
    out = []
    for name in sorted(templates):
        for text in templates[name]:
            blocks = re.split(r"\n\s*\n", text)
            out += [(name, t) for t in ([text, *blocks] if len(blocks) > 1 else [text])]
        out.append((name, f"SPDX-License-Identifier: {name}"))
    return out


def vocabulary(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> list[str]:
    return sorted({w for _, t in notices(templates) for w in _terms(t)})


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


class Weights:
    """Inverse document frequencies: of each bucket, and of the templates' words."""

    def __init__(self, by_bucket: list[float], by_word: dict[str, float]):
        self.by_bucket, self.by_word = by_bucket, by_word


def line_terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): in how many of all texts a word of the bucket occurs; bucket null: the number of texts."""
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    # Each word of a text counts once; so does a bucket, should two of its words share one.
    words = F.array_distinct(F.split(text, r"[^a-z0-9.]+|\.(?![0-9])|(?<![0-9])\."))
    own = F.array_distinct(F.transform(words, bucket))
    each = docs.select(F.explode(F.concat(own, F.array(F.lit(None).cast("int")))).alias("bucket"))
    return each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def weights(frequencies: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> Weights:
    """Inverse document frequency ln((1 + all) / (1 + n)) + 1; at most BUCKETS numbers pass through the driver."""
    n = {r["bucket"]: r["n"] for r in frequencies.collect()}
    all_ = n.get(None, 0)
    by_bucket = [round(math.log((1 + all_) / (1 + n.get(b, 0))) + 1, 6) for b in range(BUCKETS)]
    words = frequencies.sparkSession.createDataFrame([(w,) for w in vocabulary(templates)], "w string").select("w", bucket(F.col("w")).alias("b")).collect()
    return Weights(by_bucket, {r["w"]: by_bucket[r["b"]] for r in words})


def _vectors(idf: dict[str, float], templates: dict[str, tuple[str, ...]]) -> list[tuple[str, dict[str, float]]]:
    """(identifier, unit vector) of each notice."""
    out = []
    for name, notice in notices(templates):
        vector = {w: c * idf[w] for w, c in Counter(_terms(notice)).items()}
        size = math.sqrt(sum(v * v for v in vector.values()))
        out.append((name, {w: v / size for w, v in vector.items()}))
    return out


def needed_words(idf: dict[str, float], templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """Words of which a piece must hold one to reach the threshold (above 0): of each notice all but its most common ones, whose joint length is below it."""
    needed = set()
    for _, vector in _vectors(idf, templates):
        joint = 0.0
        for w, v in sorted(vector.items(), key=lambda x: (idf[x[0]], x[0])):
            joint += v * v
            if joint >= (threshold - 1e-6) ** 2:  # cosines are rounded
                needed.add(w)
    return sorted(needed)


def _holds(text: Column, words: list[str]) -> Column:
    """Whether one of the words may be among the terms; a term such as 2.0 ends where a letter begins, and the next term begins there."""
    by_sign = {c: [w[1:] for w in words if w[0] == c] for c in sorted({w[0] for w in words})}
    end = lambda rest: re.escape(rest) + ("(?![0-9])" if "." in rest else "(?![a-z0-9])")
    # Most words of a text fail at their first sign; a sign before them is read faster than a look-behind.
    branches = "|".join(f"{c}(?:{'|'.join(map(end, rest))})" for c, rest in by_sign.items())
    return F.concat(F.lit(" "), F.lower(text)).rlike(f"[^a-z](?=[{''.join(by_sign)}])(?:{branches})")


def pieces(text: Column, holds) -> Column:
    """The pieces of a text that hold a needed word, as structs of kind (0 to 3), place and text."""
    plain = F.translate(text, "\x01", " ")
    # An array of one element holds the blocks, so that they are searched once.
    parts = F.transform(F.split(plain, BLANK, -1), lambda b: F.struct(b.alias("text"), holds(b).alias("hit")))
    passages = lambda p: F.split(F.array_join(F.transform(p, lambda x: F.when(x["hit"], F.concat(x["text"], F.lit("\n\n"))).otherwise(F.lit("\x01"))), ""), "\x01+", -1)
    named = lambda kind, found: F.transform(found, lambda t, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), t.alias("text")))

    def every(p: Column) -> Column:
        blocks = F.transform(F.filter(p, lambda x: x["hit"]), lambda x: x["text"])
        lines = F.filter(F.flatten(F.transform(blocks, lambda b: F.split(b, "\n", -1))), holds)
        return F.concat(named(0, F.array(text)), named(1, F.filter(passages(p), lambda x: F.length(x) > 0)), named(2, blocks), named(3, lines))

    return let(parts, every)


def scan(files: DataFrame, idf: Weights, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The rows' id and own license: license, cosine (double), piece (file, passage, block or line) and line (the number of its first line, from 0); nulls where
    no piece reaches the threshold."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    needed, vectors, known = needed_words(idf.by_word, templates, threshold), _vectors(idf.by_word, templates), sorted(idf.by_word)
    literal = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    table = literal(idf.by_bucket, "array<double>")
    weigh = lambda t: F.get(table, bucket(t))
    # For each known word its weight in each notice, times its own.
    matrix = literal([[round(v.get(w, 0.0) * idf.by_word[w], 12) for _, v in vectors] for w in known], "array<array<double>>")
    words, names = literal(known, "array<string>"), literal([n for n, _ in vectors], "array<string>")
    zero = literal([0.0] * len(vectors), "array<double>")

    def norm(terms: Column) -> Column:
        """Length of the vector of weighted term counts, from runs of equal terms: the n-th of a run adds n^2 - (n - 1)^2 squares."""
        start = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"))
        run = lambda a, t: F.when(a["t"] == t, a["n"] + 1).otherwise(1)
        add = lambda a, t: F.struct(t.alias("t"), run(a, t).alias("n"), (a["sum"] + let(weigh(t), lambda w: (2 * run(a, t) - 1) * w * w)).alias("sum"))
        return F.aggregate(F.array_sort(terms), start, add, lambda a: F.sqrt(a["sum"]))

    def dots(terms: Column) -> Column:
        times = lambda t: F.size(F.filter(terms, lambda x: x == t)).cast("double")
        row = lambda t: F.struct(times(t).alias("n"), F.get(matrix, (F.array_position(words, t) - 1).cast("int")).alias("w"))
        add = lambda a, t: let(row(t), lambda r: F.zip_with(a, r["w"], lambda x, w: x + r["n"] * w))
        return F.aggregate(F.array_intersect(terms, words), zero, add)

    lightest = min(idf.by_bucket)
    squared = literal([round(x * x, 9) for x in idf.by_bucket], "array<double>")

    def compared(terms: Column, products: Column) -> Column:
        """(minus the cosine, license) of the nearest notice. Where even a short norm gives no cosine of the threshold, 0: the norm is at least that of as many
        words of the least weight, and at least that of words that occur once."""
        near = lambda size: F.array_min(F.zip_with(products, names, lambda d, n: F.struct((-F.round(d / size, 9)).alias("minus"), n.alias("license"))))
        far = F.struct(F.lit(0.0).alias("minus"), F.lit("").alias("license"))
        top, enough = F.array_max(products), threshold * (1 - 1e-6)
        once = F.sqrt(F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.get(squared, bucket(t))))
        return F.when(top < enough * lightest * F.sqrt(F.size(terms)), far).when(top < enough * once, far).otherwise(let(norm(terms), near))

    def best(piece: Column) -> Column:
        both = lambda terms: F.struct(terms.alias("terms"), dots(terms).alias("dots"))
        least = let(let(line_terms(piece["text"]), both), lambda x: compared(x["terms"], x["dots"]))
        return let(least, lambda m: F.struct(piece["kind"].alias("kind"), m["minus"].alias("minus"), m["license"].alias("license"), piece["place"].alias("place"), piece["text"].alias("text")))

    holds = lambda t: _holds(t, needed)
    # Only the few rows with such a word are vectorised, but all rows stay.
    hits = F.filter(F.transform(pieces(text, holds), best), lambda x: -x["minus"] >= threshold)
    top = F.when(holds(text), F.array_min(hits))
    # The best piece goes through a generator: a projection above it would compute it anew for each of its fields.
    out = files.select(F.col(id_col), text.alias("__t"), F.explode(F.array(top)).alias("__b"))
    text = F.col("__t")
    before = F.substr(text, F.lit(1), F.greatest(F.instr(text, F.substring_index(F.col("__b.text"), "\n", 1)) - 1, F.lit(0)))
    kind = F.get(literal(list(PIECES), "array<string>"), F.col("__b.kind"))
    line = F.when(F.col("__b.kind") == 0, F.lit(0)).when(F.col("__b.kind").isNotNull(), F.regexp_count(before, F.lit("\n")))
    return out.select(id_col, F.col("__b.license").alias("license"), (-F.col("__b.minus")).alias("cosine"), kind.alias("piece"), line.alias("line"))


def ancestors(path: Column) -> Column:
    """Directories above a path, nearest first; the top directory is the empty string. None for an empty path."""
    parts = F.split(F.regexp_replace(path, "/+", "/"), "/")
    n = F.size(parts) - 1
    up = F.transform(F.sequence(F.lit(1), n + 1), lambda k: F.array_join(F.slice(parts, 1, n + 1 - k), "/"))
    return F.when(F.length(path) > 0, up).otherwise(F.array().cast("array<string>"))


def inherit(scanned: DataFrame, path_col: str = "path", licence_file: Column | None = None) -> DataFrame:
    """Adds to rows with path, license and cosine: effective (own or inherited license), origin (own, inherited or null), from_path.

    ``licence_file`` tells which rows are licence files (by default by name); those with a license stand for their directory.
    Distinct directories, not files, are joined with their ancestors, so a directory that holds a third of all files is one row; its files are dealt among
    SALTS copies of its license.
    """
    is_file = F.coalesce(F.col(path_col), F.lit("")).rlike(LICENCE_FILE) if licence_file is None else licence_file
    rows = scanned.withColumn("__ups", ancestors(F.coalesce(F.col(path_col), F.lit("")))).withColumn("__dir", F.try_element_at("__ups", F.lit(1)))
    holders = rows.where(is_file & F.col("license").isNotNull() & F.col("__dir").isNotNull())
    best = F.min(F.struct((-F.col("cosine")).alias("c"), F.col(path_col).alias("p"), F.col("license").alias("l")))
    holders = holders.groupBy(F.col("__dir").alias("__up")).agg(best.alias("__h"))
    dirs = rows.where("license is null and __dir is not null").select("__dir", "__ups").distinct()
    near = dirs.select("__dir", F.posexplode("__ups").alias("__k", "__up")).join(holders, "__up")
    nearest = near.groupBy("__dir").agg(F.min(F.struct("__k", "__h")).alias("__n")).select(F.col("__dir").alias("__d"), F.col("__n.__h").alias("__h"))
    nearest = nearest.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(path_col, F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    # Rows that inherit nothing have a key of their own, as nulls would meet in one task.
    key = F.when(F.col("license").isNull() & F.col("__dir").isNotNull(), F.col("__dir")).otherwise(F.concat(F.lit("\x00"), F.xxhash64(path_col).cast("string")))
    out = rows.withColumn("__key", key).join(nearest, (F.col("__key") == F.col("__d")) & (F.col("__salt") == F.col("__s")), "left")
    own = F.col("license").isNotNull()
    return out.select(
        *scanned.columns,
        F.coalesce("license", "__h.l").alias("effective"),
        F.when(own, F.lit("own")).when(F.col("__h").isNotNull(), F.lit("inherited")).alias("origin"),
        F.when(~own, F.col("__h.p")).alias("from_path"),
    )
