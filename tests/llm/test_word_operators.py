"""Operators 11, 12, 13 against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns; the wavelet tree; the crowd of operator 8."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import bytepair, chosenpath, collocations, queries, spellings
from graphloom.llm.wavelet import WaveletTree

from .test_text_operators import LOREM, jaccard_brute, sentence

SCHEMA = "doc_id long, text string, lang string, word string, n string, block string, decoded string, h string"
SF = "/root/testdata/sf0.001"


def table(spark, rows):
    return spark.createDataFrame([(i, t, x, "clash", "n", "b", "d", "h") for i, t, x in rows], SCHEMA)


def spelled(seed, n):
    """Words of which many differ by one letter."""
    r = np.random.default_rng(seed)
    out = []
    for k in r.integers(0, 12, n):
        w = list(f"{LOREM[k]}{LOREM[(k * 7) % 24]}été")
        if r.random() < 0.5:
            at = int(r.integers(0, len(w)))
            w[at : at + 1] = [["", "x", "yz"[: int(r.integers(1, 3))], w[at] * 2][int(r.integers(0, 4))]]
        out.append("".join(w))
    return " ".join(out)


ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \t\n ", None), (None, "alpha beta, gamma. " * 30, "en"), (5, spelled(1, 400), "fr"), (5, spelled(1, 400), "fr"), (6, spelled(2, 300), None),
    (7, "a b a b a b. " * 40 + "one\ttwo  three;four\r\nfive", "en"), (8, sentence(3, 4000), "de"), (9, "x" * 5000 + " " + "x" * 5001 + " " + "ab" * 700 + " " + "ab" * 700, "en"), (10, "x" * 5000 + " " + "x" * 5001, "en"),
    (11, "ÀÉÎ×÷ÿßàéî ÀÉÎ×÷ÿßàéî Ā漢字 tail's don't I'LL we've  12,345.67    \x00\x1c end   ", "en"), (12, "the same phrase here and the same phrase there. " * 25, "en"), (13, "A" * 50 + "!" * 60 + "\n" * 40 + " " * 90, "und"),
]


def test_wavelet_tree_reports_what_lies_in_a_rectangle():
    r = np.random.default_rng(5)
    for n in (1, 2, 7, 300):
        values = r.permutation(n)
        tree = WaveletTree(values)
        lo, hi, least, most = (r.integers(0, n + 1, 200) for _ in range(4))
        got = {(int(q), int(v)) for q, v in zip(*tree.report(lo, hi, least, most))}
        want = {(q, int(v)) for q in range(200) for v in values[lo[q] : max(lo[q], hi[q])] if least[q] <= v < most[q]}
        assert got == want


def near_words(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_brute(rows):
    count = Counter()
    for doc, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [x for x in words if x != w and near_words(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [20_000, 3])
def test_variants_equal_brute_force(spark, monkeypatch, group):
    """Also where groups are cut until their regions are one position long."""
    monkeypatch.setattr(spellings, "GROUP", group)
    monkeypatch.setattr(spellings, "HELD", 50)
    monkeypatch.setattr(spellings, "PART", 1000)
    chain = [(20, f"{'motherly ' * 1000} {'motherlx ' * 100} {'motherxx ' * 10} motherxxx", "en"), (21, "motherxxx", None)]
    rows = ODD + chain + [(30 + k, spelled(k, 200), "en") for k in range(3, 6)]
    got = sorted((tuple(r) for r in spellings.variants(table(spark, rows)).collect()), key=str)
    assert got == variants_brute(rows)
    assert any(form is not None and form != root for _, form, root, *_ in got)


def test_variants_of_nothing(spark):
    assert spellings.variants(table(spark, [])).count() == 0
    assert spellings.variants(table(spark, [(1, None, None), (2, "short", "en")])).count() == 0


@pytest.mark.parametrize("block", [12_000_000, 2000])
def test_byte_pairs_equal_the_library(spark, monkeypatch, block):
    import public_tokenizers
    import tiktoken

    monkeypatch.setattr(bytepair, "BLOCK", block)
    monkeypatch.setattr(bytepair, "PIECES", 1 << (20 if block > 2000 else 9))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytepair.ranks(path), special_tokens={})
    rows = ODD + [(40, "".join(map(chr, [*range(1, 0x300), *range(0x2000, 0x2100), 0x1F600, 0x10FFFF])), "en"), (41, " a" * 9000, "en")]
    both = bytepair.decode(bytepair.encode(table(spark, rows), path, public_tokenizers.PATTERN).withColumnRenamed("doc_id", "block"), path).collect()
    key = lambda x: (str(x[0]), x[1])
    want = [(i, np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes(), (t or "").encode()) for i, t, _ in rows]
    assert sorted(((r["block"], bytes(r.ids), bytes(r.decoded)) for r in both), key=key) == sorted(want, key=key)


def test_byte_pairs_of_nothing_and_of_no_ids(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert bytepair.encode(table(spark, []), path, public_tokenizers.PATTERN).count() == 0
    ids = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(np.array([15496, 4_000_000_000, 995], dtype="<u4").tobytes()))], "doc_id long, ids binary")
    assert [r.decoded and bytes(r.decoded) for r in bytepair.decode(ids, path).orderBy("doc_id").collect()] == [None, bytearray(b""), b"Hello world"]


def phrases_brute(rows, least, top):
    counts = {}
    for _, text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        f, n = counts.setdefault(lang or "und", (Counter(), Counter()))
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            n["n"] += len(ws)
            for k in (1, 2, 3):
                f.update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, (f, n) in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in found.items():
            if any(len(x) > len(g) and 100 * b >= 50 * a and any(x[k : k + len(g)] == g for k in range(len(x) - len(g) + 1)) for x, b in found.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, g, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, n["n"], -score))
    return sorted(out)


@pytest.mark.parametrize("batch", [5_000_000, 100])
def test_phrases_equal_brute_force(spark, monkeypatch, batch):
    """Also with a bitmap so small that nearly all grams fall on frequent ones."""
    monkeypatch.setattr(collocations, "BATCH", batch)
    monkeypatch.setattr(collocations, "BITS", 27 if batch > 100 else 18)
    rows = ODD + [(50, "new york city. " * 50 + "new york. " * 30 + "old york " * 12, None), (51, "zeta eta\ttheta " * 60, "de"), (52, "é è, é è " * 9, "fr")]
    for top in (2000, 5):
        got = sorted(tuple(r) for r in collocations.mine(table(spark, rows), top=top).collect())
        assert got == phrases_brute(rows, 10, top)


def test_phrases_of_nothing(spark):
    assert collocations.mine(table(spark, [])).count() == 0
    assert collocations.mine(table(spark, [(1, None, None), (2, "a b", "en")])).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    words = spark.createDataFrame([("en", "a", 3 * 10**14 + 7), ("en", "b", 9 * 10**14 + 11)], "lang string, phrase string, n long")
    grams = spark.createDataFrame([("en", "a b", 2, 2 * 10**14 + 3)], "lang string, phrase string, k int, n long")
    row = collocations.scores(words, grams).first()
    assert row.score == 10**6 * row.a * row.a // (row.l * row.r) == 10**6 * (2 * 10**14 + 3) ** 2 // ((3 * 10**14 + 7) * (9 * 10**14 + 11))


def test_queries_have_the_columns_asked_for(spark):
    made = queries.queries()
    assert made["op11_spelling_variants"](spark, SF).dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert made["op12_byte_bpe"](spark, SF).dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert [x for x, _ in made["op13_collocations"](spark, SF).dtypes] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def crowd(n, words, seed):
    """Texts of which most pairs are about 0.8 alike: each has a few words of its own."""
    r = np.random.default_rng(seed)
    base = sentence(seed, words).split()
    out = []
    for k in range(n):
        own = list(base)
        for at in r.choice(words, max(1, words // 90), replace=False):
            own[at] = f"own{seed}w{k}x{at}"
        out.append((1000 * seed + k, " ".join(own)))
    return out


def test_crowds_lose_no_link(spark, monkeypatch):
    """A crowd around the threshold, which no split parts; near copies, for which one stands; and texts that share half, which are split."""
    monkeypatch.setattr(chosenpath, "SPLIT", 16)
    half = sentence(77, 80)
    rows = crowd(60, 100, 5) + crowd(50, 300, 6) + [(9000 + k, half + " " + sentence(500 + k, 60)) for k in range(70)] + [(9100 + k, half + " " + sentence(500 + k, 59)) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in chosenpath.classes(docs).collect())
    assert got == sorted(jaccard_brute(rows))
