"""Relations inside one document at a time, over Arrow batches: patterns, nearness and shared sentences in time that grows with the text and its mentions.

A document's relations need its own text and mentions only, so nothing is shuffled. Patterns are tried on stretches between commas and stops that hold their words, names are looked for by
an automaton, near mentions by their sorted places.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Patterns by relation with the types of their two groups (fixed values).
PATTERNS = (
    ("WORKS_FOR", r"(\w+\s\w+)\s+(?:is|was|are|were)\s+(?:the\s+)?(\w+)\s+of\s+([^,.]+)", "PERSON", "ORG"),
    ("WORKS_FOR", r"(\w+\s\w+)\s+(?:works?|worked)\s+for\s+([^,.]+)", "PERSON", "ORG"),
    ("WORKS_FOR", r"(\w+\s\w+)\s+from\s+([^,.]+)", "PERSON", "ORG"),
    ("WORKS_FOR", r"([^,.]+)\s+(?:employee|staff|worker|executive)\s+(\w+\s\w+)", "ORG", "PERSON"),
    ("LOCATED_IN", r"([^,.]+)\s+in\s+([^,.]+)", "ENTITY", "PLACE"),
    ("LOCATED_IN", r"([^,.]+)\s+at\s+([^,.]+)", "ENTITY", "PLACE"),
    ("LOCATED_IN", r"([^,.]+)\s+located\s+in\s+([^,.]+)", "ENTITY", "PLACE"),
    ("LOCATED_IN", r"([^,.]+)\s+based\s+in\s+([^,.]+)", "ENTITY", "PLACE"),
    ("HAS_ROLE", r"(\w+\s\w+)\s+(?:is|was|are|were)\s+(?:the\s+)?(\w+)", "PERSON", "ROLE"),
    ("HAS_ROLE", r"(\w+\s\w+)\s*,\s*(\w+(?:\s+\w+)*)", "PERSON", "ROLE"),
    ("HAS_ROLE", r"the\s+(\w+)\s+(\w+\s\w+)", "ROLE", "PERSON"),
    ("PARTICIPATED_IN", r"(\w+\s\w+)\s+(?:attended|participated|joined)\s+([^,.]+)", "PERSON", "EVENT"),
    ("PARTICIPATED_IN", r"([^,.]+)\s+(?:with|by)\s+(\w+\s\w+)", "EVENT", "PERSON"),
)
#: Words of which a stretch of text must hold one of each group for a pattern to match in it. None: a comma parts its groups; an empty list: a word's end is enough.
WORDS = (
    ({"is", "was", "are", "were"}, {"of"}), ({"work", "works", "worked"}, {"for"}), ({"from"},), ({"employee", "staff", "worker", "executive"},), ({"in"},), ({"at"},), ({"located"}, {"in"}), ({"based"}, {"in"}),
    ({"is", "was", "are", "were"},), None, (), ({"attended", "participated", "joined"},), ({"with", "by"},),
)
#: Letters beyond ASCII that are i, k or s in another case.
FOLDED = re.compile("[\u0130\u0131\u017f\u212a]")
#: Characters between two mentions that are near, and what a mention is.
NEAR = 50
MENTION = ("pos", "text", "type", "role", "start_char", "end_char")

_PATTERNS = tuple(re.compile("(?i)" + p) for _, p, _, _ in PATTERNS)
_OPEN = "([^,.]+)"
#: What comes after the first group of patterns that begin with any stretch: they match where that is found behind a character.
_REST = tuple(re.compile("(?i)" + p[len(_OPEN) :]) if p.startswith(_OPEN) else None for _, p, _, _ in PATTERNS)
_CUES = frozenset(w for groups in WORDS for g in groups or () for w in g)
_BY_WORD = {w: tuple(k for k, groups in enumerate(WORDS) if groups and w in groups[0]) for w in _CUES}
_SENTENCE = re.compile(r"[.!?]+")


@cache
def kind_of(a: str | None, b: str | None, role_a: bool = False, role_b: bool = False) -> str:
    """The type that two mention types suggest; HAS_ROLE where one is a person and the other has a role."""
    if a is not None and b is not None:
        both = {a, b}
        if both == {"PERSON", "ORG"}:
            return "WORKS_FOR"
        if "PLACE" in both and both & {"PERSON", "ORG", "EVENT"}:
            return "LOCATED_IN"
        if both == {"PERSON", "EVENT"}:
            return "PARTICIPATED_IN"
    return "HAS_ROLE" if (a == "PERSON" and role_b) or (b == "PERSON" and role_a) else "RELATED_TO"


class _Names:
    """The distinct (text, type) of a document with their places, and two indexes: an automaton that finds them in texts, and their texts end to end, in which texts are found."""

    def __init__(self, mentions: list[tuple], lower: bool):
        import ahocorasick

        places: dict[tuple, list[int]] = {}
        for m in mentions:
            if m[1] is not None:
                places.setdefault((m[1], m[2]), []).append(m[0])
        self.names = [(min(p), text, kind, text.lower() if lower else text) for (text, kind), p in places.items()]
        self.places = [sorted(p) for p in places.values()]
        self.by_text: dict[str, list[int]] = {}
        for k, name in enumerate(self.names):
            self.by_text.setdefault(name[3], []).append(k)
        self.automaton = ahocorasick.Automaton()
        for text, ks in self.by_text.items():
            if text:
                self.automaton.add_word(text, ks)
        self.some = len(self.automaton) > 0
        if self.some:
            self.automaton.make_automaton()
        self.joined, self.starts, at = "\x00".join(n[3] for n in self.names), [], 0
        for n in self.names:
            self.starts.append(at)
            at += len(n[3]) + 1

    def inside(self, text: str) -> set[int]:
        """Names that a text holds."""
        found = set(self.by_text.get("", ()))
        if self.some:
            for _, ks in self.automaton.iter(text):
                found.update(ks)
        return found

    def around(self, text: str) -> set[int]:
        """Names that hold a text."""
        if not text:
            return set(range(len(self.names)))
        if "\x00" in text:
            return {k for k, n in enumerate(self.names) if text in n[3]}
        found, at = set(), self.joined.find(text)
        while at >= 0:
            k = bisect_right(self.starts, at) - 1
            found.add(k)
            at = self.joined.find(text, self.starts[k] + len(self.names[k][3]) + 1)
        return found

    def fitting(self, want: str, kind: str) -> tuple | None:
        """The name of a type that is the text, or else the first that holds it or is held by it."""
        best = None
        for k in self.inside(want) | self.around(want):
            pos, text, own, low = self.names[k]
            if kind == "ENTITY" or own == kind:
                key = (low != want, pos, text, own or "")
                if best is None or key < best[0]:
                    best = (key, (text, own, pos))
        return best and best[1]


def _found(k: int, stretch: str) -> Iterator[tuple[int, re.Match]]:
    """All matches of a pattern. One that begins with any stretch is tried only where its rest is found, as each other start would be tried in vain."""
    if (rest := _REST[k]) is None:
        for m in _PATTERNS[k].finditer(stretch):
            yield k, m
        return
    at = 0
    while rest.search(stretch, at + 1):
        m = _PATTERNS[k].match(stretch, at)
        yield k, m
        at = m.end()


def _matches(text: str) -> Iterator[tuple[int, re.Match]]:
    """All matches of all patterns. Only one pattern's matches hold a comma, and none a stop."""
    every = [k for k, groups in enumerate(WORDS) if groups is not None] if FOLDED.search(text) else None
    for piece in text.split("."):
        stretches = piece.split(",")
        if len(stretches) > 1:
            yield from _found(9, piece)
        for stretch in stretches:
            low = stretch.lower()
            ks = every
            if ks is None:
                ks = [10] if "the" in low else []
                words = low.split()
                for w in _CUES.intersection(words):
                    ks += [k for k in _BY_WORD[w] if k not in ks and all(not g.isdisjoint(words) for g in WORDS[k])]
            for k in ks:
                yield from _found(k, stretch)


def _row(kind: str, a: tuple, b: tuple, confidence: float, evidence: str, seq: int) -> tuple:
    """a, b: text, type, pos. An organisation that a person works for is the object."""
    swap = kind == "WORKS_FOR" and a[1] == "ORG" and b[1] == "PERSON"
    x, y = (b, a) if swap else (a, b)
    return x[0], y[0], kind, confidence, evidence, x[1], y[1], a[2], b[2], seq


def by_patterns(text: str, mentions: list[tuple]) -> Iterator[tuple]:
    if not mentions:
        return
    names, known = _Names(mentions, True), {}

    def fitting(want: str, kind: str):
        key = want.strip(" ").lower(), kind
        if key not in known:
            known[key] = names.fitting(*key)
        return known[key]

    for k, m in _matches(text):
        kind, _, type_a, type_b = PATTERNS[k]
        if (a := fitting(m[1], type_a)) and (b := fitting(m[2], type_b)) and a[2] != b[2]:
            yield _row(kind, a, b, 0.8, m[0], 0)


def by_nearness(mentions: list[tuple]) -> Iterator[tuple]:
    placed = sorted((m for m in mentions if m[4] is not None and m[5] is not None), key=lambda m: (m[4], m[0]))
    starts = [m[4] for m in placed]
    for pos, text, kind, role, _, end in placed:
        for j in range(bisect_right(starts, end), bisect_left(starts, end + NEAR)):
            other = placed[j]
            yield _row(kind_of(kind, other[2], role is not None, other[3] is not None), (text, kind, pos), (other[1], other[2], other[0]), 0.6 - (other[4] - end) / 100.0, "proximity", 1)


def by_sentence(text: str, mentions: list[tuple]) -> Iterator[tuple]:
    """Each pair of names once, at its first places and in its first sentence."""
    if not mentions:
        return
    names, done = _Names(mentions, False), set()
    for sentence in _SENTENCE.split(text):
        held = names.inside(sentence)
        for a in held:
            first = names.places[a][0]
            for b in held:
                if (a, b) not in done and first < names.places[b][-1]:
                    done.add((a, b))
                    (_, x, kx, _), (_, y, ky, _), places = names.names[a], names.names[b], names.places[b]
                    yield _row(kind_of(kx, ky), (x, kx, first), (y, ky, places[bisect_right(places, first)]), 0.5, sentence.strip(" "), 2)


def _firsts(mentions: list[tuple]) -> list[tuple]:
    """The first of mentions that differ by their number alone: names that stand at one place many times make pairs of equal rows, of which the first ones' is the best."""
    first: dict[tuple, tuple] = {}
    for m in mentions:
        key = m[1], m[2], m[3] is not None, m[4], m[5]
        if key not in first or m[0] < first[key][0]:
            first[key] = m
    return list(first.values())


def _of_document(text: str, mentions: list[tuple], parts: tuple[str, ...], once: bool = False) -> Iterator[tuple]:
    """Relations of a document; with ``once`` some that are not the best of equal ones may be left out."""
    if "patterns" in parts:
        yield from by_patterns(text, mentions)
    if "nearness" in parts:
        yield from by_nearness(_firsts(mentions) if once else mentions)
    if "sentences" in parts:
        yield from by_sentence(text, mentions)


_COLUMNS = ("subject", "object", "relation", "confidence", "evidence", "subject_type", "object_type", "pos1", "pos2", "seq")
_TYPES = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
#: Rows of a batch that is passed on.
ROWS = 20_000


def _run(parts: tuple[str, ...], once: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(ids: list, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * len(_COLUMNS)
            return pa.record_batch([pa.array(ids, kind), *(pa.array(c, t) for c, t in zip(cols, _TYPES))], names=["doc_id", *_COLUMNS])

        for batch in batches:
            lists, kind = batch.column("mentions"), batch.column("doc_id").type
            offsets, flat = lists.offsets.to_pylist(), lists.values
            columns = [flat.field(c).to_pylist() for c in MENTION]
            ids, rows = [], []
            for k, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"))):
                mentions = list(zip(*(c[offsets[k] : offsets[k + 1]] for c in columns)))
                found = _of_document(text.as_py() or "", mentions, parts, once)
                if once:
                    best: dict[tuple, tuple] = {}
                    for row in found:
                        have = best.get(row[:3])
                        if have is None or (-row[3], row[9], row[7], row[8]) < (-have[3], have[9], have[7], have[8]):
                            best[row[:3]] = row
                    found = best.values()
                for row in found:
                    rows.append(row)
                    ids.append(doc)
                    if len(rows) >= ROWS:
                        yield batch_of(ids, rows, kind)
                        ids, rows = [], []
            yield batch_of(ids, rows, kind)

    return run


def related(lists: DataFrame, parts: tuple[str, ...] = ("patterns", "nearness", "sentences"), once: bool = True) -> DataFrame:
    """Relations of documents (doc_id, text, mentions: a list of MENTION): doc_id, subject, object, relation, confidence, evidence, subject_type, object_type, pos1, pos2, seq (the part).

    With ``once`` the most confident of equal (subject, object, relation) of a document; of equals the first part's and first places'. A null text is empty, a null list too.
    """
    kind = dict(lists.dtypes)["doc_id"]
    return lists.select("doc_id", "text", "mentions").mapInArrow(
        _run(parts, once), f"doc_id {kind}, subject string, object string, relation string, confidence double, evidence string, subject_type string, object_type string, pos1 int, pos2 int, seq int"
    )
