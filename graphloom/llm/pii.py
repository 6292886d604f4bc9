"""Personal data: base patterns, and a linear-chain conditional random field over word shapes that adds spans.

The field is trained from a small labelled table (by default ``labelled_table``, sentences made by a rule from contexts and values) on the driver, by gradient
ascent on the exact likelihood; only its weights, some thousand numbers, are sent out. Documents are decoded in numpy batches by Viterbi. A word whose
shape makes "outside" optimal whatever its neighbours' labels splits the chain exactly, so only the short stretches between
such words need decoding.

Two rules stand around the field. Before it, only words with a digit, an @, a spelt-out sign or at least LONG_WORD letters, and their neighbours, are decoded (``is_marked``): decoding all
words takes four times as long. After it, a span must hold as many digits as its kind needs, and a card pass its checksum (``plausible``), as base matches must.

Base spans stay; a span of the field is added where it overlaps none of them. Base patterns are searched in time linear in the text, also where it is unbroken.

Defined results: a null text is empty (no spans; a redacted null stays null). Rows are judged one by one, so repeated rows and
repeated or null ids each get a row. Empty and very long texts are treated alike, and so are very long words. An empty table gives an empty result.
Other columns are not read, or are kept as they are by ``redact``.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches

#: Base kinds in the order in which spans with equal starts are listed.
BASE = ("email", "ip", "card", "phone")
#: Kinds that the field can add, after the base kinds.
KINDS = (*BASE, "secret", "ssn", "iban")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9.]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, leftmost and without overlap: from each @ to both sides."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        free = domain.end() if domain else at + 1
        if domain:
            yield begin, free
        at = text.find("@", free)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+) in the stretches of digits and dots, by their runs of digits."""
    for stretch in _DOTTED.finditer(text):
        if stretch.end() - stretch.start() < 7:
            continue
        runs, at = [], stretch.start()
        for run in stretch.group().split("."):
            runs.append((at, at + len(run)))
            at += len(run) + 1
        k = 0
        while k + 3 < len(runs):
            if all(a < b for a, b in runs[k : k + 4]):
                yield runs[k][0], runs[k + 3][1]
                k += 4
            else:
                k += 1


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by start and then kind. Each kind is matched leftmost and without overlap on its own."""
    out: list[Span] = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for a, b in _addresses(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in text[a:b].split(".")):
                out.append((a, 1, b))
        for m in _CARD.finditer(text):
            digits = re.sub("[ -]", "", m.group()) if m.end() - m.start() < 64 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


#: Contexts of the labelled table: <kind> is where a value stands. Word forms matter, not meanings (fixed values).
CONTEXTS = (
    "write to <email> or call <phone> before noon", "Mail <email> and <email> today", "reach me at <email> or in the office", "his address is <email> he said", "contact <email> for the keys",
    "schreib an <email> bis Montag", "escribe a <email> hoy", "envoyez à <email> ce soir", "From: <email>", "the host <ip> answered and <ip> did not", "From <ip> to <ip> all was well", "node <ip> is up",
    "connexion de <ip> refusée", "paid with <card> on Monday", "card <card> or <card> was used", "the number <card> has expired", "die Karte <card> ist gesperrt", "Call <phone> or <phone> now",
    "phone <phone> at any time", "Fax: <phone> in the evening", "Tel. <phone>", "llama al <phone> por favor", "unter <phone> erreichbar", "set token = <secret> in the file", "the api_key = <secret> is old",
    "export SECRET <secret> here", "password: <secret> was changed", "use <secret> as the key", "with <secret> here", "AWS_ACCESS_KEY_ID <secret> was found", "Authorization: Bearer <secret>",
    "the <secret> is set and <secret> too", "From <secret> there", "key <secret> here", "it is <secret> I believe", "<secret>", "SSN <ssn> on file", "social security number <ssn> was given", "her number is <ssn> and his is <ssn>", "IBAN <iban> bitte", "pay to <iban> this week",
    "account <iban> is closed", "virement sur <iban> demain", "the password: <phrase> was changed", "use <phrase> as the key", "set token = <phrase> in the file", "my password is <phrase> since May", "password <phrase> for the host",
    "api_key = <phrase> and no other", "secret: <phrase>", "the key <phrase> is old", "Authorization: Bearer <phrase>",
)
#: Sentences in which nothing is anybody's (fixed values).
PLAIN = (
    "the quick brown fox jumps over the lazy dog and sleeps", "Of the things that were said, none was true. Nothing else", "In 1998 there were 24 cases, 3 of them in May 2004", "version 2.0 of the License , Version 3.14.159 and 1.2.3 of it",
    "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "about 1,200 people and 35% of $400 or 12.50 euro",
    "a | b | c | d | ee, | ff. | gg", "THE!! BIG!! SALE!! IS!! ON!! NOW!!", "buy*** now### and%%% save&&& more$$$ here", "see page 12-14, room B12, gate 7A and flight LH4410", "Die Häuser stehen für immer, und das Gemüse wächst über Nacht",
    "L'été est là, où ça déçoit; être ou ne pas être", "El niño comió piñas y después durmió, ¿verdad?", "http://www.example.com/en/7817?page=2 and https://example.org/a", "id 20240131 and number 15 of 1000000 in row 42",
    "(see below) or [1] and {x} = y + z - 3 * 4", "at 10:45 on 2024-01-31 or 31.01.2024 in E1F2A3B", "abc.de abc.de abc.de and hel,lo hel,lo hel,lo hel,lo", "Abc.de Abc.de Abc.de wh/at wh/at a-b a-b c_d c_d", "one two three 1 2 3 four five 6.7 eight",
    "look at the dot on the map at noon", "we met at home and at work, dot by dot", "the dot at the end of the line is small", "a dot com company was sold at a loss", "ISBN 978-3-16-148410-0 and ISSN 2049-3630", "order 4711-0815 of 3 May, 2 kg at 9.99",
    "from 1914-18 to 1939-45 and 2001-2010", "pages 120-125 and 210-216, plate 3-4", "x86_64 and utf8 on win32 or python3.11", "COVID19 and MP3 or H2O in A4", "chapter 3.2.1 and section 4.5.6", "room 101 to 105 at 7 pm on 12 June 1987",
    "the internationalization of counterrevolutionaries was incomprehensibly slow", "Donaudampfschifffahrtsgesellschaft und Rechtsschutzversicherungsgesellschaften", "the key responsibilities of a password administrator are misunderstandings",
    "set aside uncharacteristically long words in the file", "anticonstitutionnellement et les intergouvernementalisations", "the password was changed and the secret is out", "use uninterrupted characterizations as the example", "electroencefalografista y otorrinolaringólogo de hoy",
    "thinonateringenenst ereaanthearnation erinthandoreshinger atterantionthe whstheingere", "UNCHARACTERISTICALLY LOUD INTERNATIONALIZATION IS HERE", "token bearers, secretaries and keynotes",
    "From straightforwardness to unquestionablenesses there", "it is characteristically warm I believe", "with disproportionateness and here, antidisestablishmentarian. Nothing more", "erer,### counterintuitively%%% there&&& hyperresponsiveness### so", "Lo. Otorrinolaringológico y. De", "Les. Institutionnellement de la", "42 6 13 2 8 15 4 23 16 42", "between 1.5 and 2.5 million in 2010 2011 2012", "the score was 3-2 and then 4-4", "from 08:00 to 17:30 on weekdays", "call 911 or dial 112 now", "part no. 12-345 or 67-890 in stock", "the code E404 and error 500",
)
#: Rounds of values put into the contexts, and what chooses them.
ROUNDS, SEED = 6, 11


def made_value(kind: str, r: random.Random) -> str:
    """A value of a kind, in one of the forms that it is written in."""
    some = lambda signs, n: "".join(r.choice(signs) for _ in range(n))
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    d = lambda n: some(digits, n)
    name = lambda: some("bcdfglmnprst", 1) + some("aeiou", 1) + some("lmnrst", 1) + some("aeiou", r.randint(0, 1))
    if kind == "email":
        who = name() + r.choice(["", "." + name(), "_" + d(2), d(1)])
        host, tld = r.choice(["example", "mail", name() + name()]), r.choice(["com", "org", "net", "de"])
        dot = r.choice([("@", "."), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" at ", " dot "), ("@", ".")])
        return f"{who}{dot[0]}{host}{dot[1]}{tld}"
    if kind == "ip":
        return ".".join(str(r.randint(0, 255)) for _ in range(4)) if r.random() < 0.6 else ":".join(some("0123456789abcdef", r.randint(1, 4)) for _ in range(8))
    if kind == "card":
        gap = r.choice([" ", "-", ""])
        return gap.join(d(4) for _ in range(4)) if r.random() < 0.7 else gap.join((d(4), d(6), d(5)))
    if kind == "phone":
        return r.choice([
            f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+{d(2)}-{d(2)}-{d(6)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(6)}", f"{d(3)}.{d(3)}.{d(4)}",
            f"00{d(2)} {d(2)} {d(6)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}",
        ])
    if kind == "phrase":
        return some(r.choice([lower, upper, lower + upper]), r.randint(16, 30))
    if kind == "ssn":
        return f"{d(3)}-{d(2)}-{d(4)}"
    if kind == "iban":
        flat = some(upper, 2) + d(2) + r.choice([d(18), some(upper, 4) + d(14), d(20)])
        return flat if r.random() < 0.5 else " ".join(flat[k : k + 4] for k in range(0, len(flat), 4))
    hexed = some("0123456789abcdef", r.choice([18, 32, 40, 64]))
    mixed = some(lower + upper + digits, r.choice([16, 24, 36])) + d(1) + some(lower + upper, 2) + d(1)
    return r.choice([f'"{hexed}"', hexed, "AKIA" + some(upper + digits, 15) + d(1), "AKIA" + some(upper, r.randint(5, 10)) + d(1) + some(upper, 7), "ghp_" + mixed, "sk-" + mixed, mixed, f"password={hexed}", f"pass={mixed}", f"key-{hexed[:16]}"])


def made_sentences(contexts: tuple[str, ...], plain: tuple[str, ...], rounds: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(sentence, spans): each context ``rounds`` times with new values, and the plain sentences."""
    r, out = random.Random(seed), [(p, []) for p in plain]
    for _ in range(rounds):
        for context in contexts:
            text, spans = "", []
            for k, piece in enumerate(re.split(r"<(\w+)>", context)):
                value = made_value(piece, r) if k % 2 else piece
                if k % 2:
                    spans.append((len(text), len(text) + len(value), "secret" if piece == "phrase" else piece))
                text += value
            out.append((text, spans))
    return out


def labelled_table(contexts: tuple[str, ...] = CONTEXTS, plain: tuple[str, ...] = PLAIN, rounds: int = ROUNDS, seed: int = SEED) -> pd.DataFrame:
    """The sentences as rows: sentence, position, word, label (O, or B- or I- and a kind)."""
    rows = []
    for k, (text, spans) in enumerate(made_sentences(contexts, plain, rounds, seed)):
        begun = set()
        for j, w in enumerate(_WORD.finditer(text)):
            span = next((x for x in spans if w.start() < x[1] and x[0] < w.end()), None)
            rows.append((k, j, w[0], ("I-" if span in begun else "B-") + span[2] if span else "O"))
            begun.add(span)
    return pd.DataFrame(rows, columns=["sentence", "position", "word", "label"])


LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


#: Words that tell what stands beside them.
CUES = frozenset("at dot com org net de mail email phone tel. fax: call token password: password api_key secret key bearer iban ssn social security number card account host node ip = from from: pay".split())
#: Letters of a long word.
LONG_WORD = 15
#: Signs of a shape beyond which it is named by a hash of the whole.
LONG_SHAPE = 24


def shape(word: str) -> str:
    """The form of a word: classes of its characters (X x 9, other signs as they are; not ASCII counts as a letter), runs of up to
    2, 4 and more. Long forms are named by a hash of the whole form."""
    out = []
    for m in re.finditer(r"([A-Z])+|([a-z\x80-\U0010FFFF])+|([0-9])+|(.)", word):
        n = m.end() - m.start()
        c = "X" if m[1] else "x" if m[2] else "9" if m[3] else m[4]
        out.append(c if n == 1 else c + "234"[(n > 2) + (n > 4)] if c != "x" else "x2")
    s = "".join(out)
    # Alternating letters and digits are one form, whatever their order.
    mixed = re.sub(r"(?:[Xx]2?|9|X[234]|9[234]){6,}", "H", s) if re.search("9", s) and re.search("x", s) else s
    return mixed if len(mixed) <= LONG_SHAPE else "long-" + hashlib.md5(mixed.encode()).hexdigest()[:8]


def word_features(word: str) -> tuple[str, ...]:
    """Features of a word alone: its shape, and coarse ones that carry over to shapes not seen in training."""
    s = shape(word)
    found = ["s=" + s, "plain" if re.fullmatch(r"[\W_]*X?[23]?4?(x2?)?[\W_]*", s) and not re.search(r"[@+(\[=\"]", s) else "odd"]
    n = sum("0" <= c <= "9" for c in word)
    found.append("digits" + str(min(n, 20) // 4) if n else "no-digits")
    low = word.lower().rstrip(",;.") or word
    if low in CUES:
        found.append("w=" + low)
    if "@" in word:
        found.append("at-sign")
    if n and word.count(".") == 3:
        found.append("dots3")
    if word.count(":") >= 5:
        found.append("colons")
    if "H" in s:
        found.append("mixed" + str(min(len(word), 47) // 8))
    if n and len(low) >= 15 and low.isalnum():
        found.append("code")
    if len(low) >= LONG_WORD and low.isalpha():
        found.append("long-word")
    if n and re.match(r"[A-Z]{2}[0-9]{2}", word):
        found.append("country-code")
    if "(at)" in low or "[at]" in low:
        found.append("at-word")
    if "(dot)" in low or "[dot]" in low:
        found.append("dot-word")
    return tuple(found)


def is_marked(features: tuple[str, ...]) -> int:
    """Whether a word holds a digit, an @, a spelt-out sign or many letters: only such words and their neighbours are decoded. 2 for a bare "dot", which reaches three words back."""
    if "w=dot" in features:
        return 2
    return int("no-digits" not in features or any(f in features for f in ("at-sign", "at-word", "dot-word", "long-word")))


class Field:
    """Weights of the trained field: emissions by feature of the word before, the word and the word after; transitions."""

    def __init__(self, features: dict[str, int], emit: np.ndarray, move: np.ndarray, begin: np.ndarray):
        self.features, self.emit, self.move, self.begin = features, emit, move, begin
        # What a label other than outside can gain by the labels before and after: a word whose own score loses more is outside.
        before = np.maximum((move[:, 1:] - move[:, :1]).max(0), begin[1:] - begin[0])
        self.margin = before + np.maximum((move[1:] - move[:1]).max(1), 0)

    def columns(self, word: str) -> np.ndarray:
        """Scores of the labels, 3 x labels: what a word gives to itself, to the next word and to the one before."""
        found = [self.features[f] for f in word_features(word) if f in self.features]
        if not found:
            return np.zeros((3, len(LABELS)))
        rows = np.array(found) * 3
        return np.stack([self.emit[rows + k].sum(0) for k in range(3)])


def _expected(score: np.ndarray, size: np.ndarray, move: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of labels and summed marginals of pairs, of all sentences at once: score is sentences x words x labels, padded behind ``size``."""
    n, t, m = score.shape
    a, b, scale = np.empty((n, t, m)), np.ones((n, t, m)), np.ones((n, t))
    e, mv = np.exp(score - score.max(2, keepdims=True)), np.exp(move)
    for k in range(t):
        x = e[:, k] * (np.exp(begin) if not k else a[:, k - 1] @ mv)
        scale[:, k] = x.sum(1)
        a[:, k] = x / scale[:, k, None]
    for k in range(t - 2, -1, -1):
        inside = (k + 1 < size)[:, None]
        b[:, k] = np.where(inside, (e[:, k + 1] * b[:, k + 1] / scale[:, k + 1, None]) @ mv.T, 1.0)
    pairs = np.zeros((m, m))
    for k in range(1, t):
        rows = k < size
        pairs += mv * (a[rows, k - 1].T @ (e[rows, k] * b[rows, k] / scale[rows, k, None]))
    return a * b, pairs


def train(table: pd.DataFrame | None = None, rounds: int = 150, rate: float = 0.3, decay: float = 0.01) -> Field:
    """Gradient ascent (with a step for each weight) on the likelihood of the labelled table, which is small by contract."""
    return _trained(rounds, rate, decay) if table is None else _train(table, rounds, rate, decay)


@lru_cache(maxsize=1)
def _trained(rounds: int, rate: float, decay: float) -> Field:
    return _train(labelled_table(), rounds, rate, decay)


def _train(table: pd.DataFrame, rounds: int, rate: float, decay: float) -> Field:
    sentences = [(g["word"].tolist(), [LABELS.index(x) for x in g["label"]]) for _, g in table.sort_values(["sentence", "position"]).groupby("sentence")]
    features: dict[str, int] = {}
    for words, _ in sentences:
        for w in words:
            for f in word_features(w):
                features.setdefault(f, len(features))
    m, n, t = len(LABELS), len(sentences), max(len(w) for w, _ in sentences)
    size = np.array([len(w) for w, _ in sentences])
    real = np.arange(t) < size[:, None]
    row = np.cumsum(real).reshape(n, t) - 1  # of the real words, which are all that is held
    held, gold = np.zeros((int(size.sum()), 3 * len(features)), dtype=np.float32), np.zeros((n, t, m))
    seen, first = np.zeros((m, m)), np.zeros(m)
    for i, (words, labels) in enumerate(sentences):
        first[labels[0]] += 1
        for j, w in enumerate(words):
            gold[i, j, labels[j]] = 1
            if j:
                seen[labels[j - 1], labels[j]] += 1
            for f in word_features(w):
                # What a word gives to itself, to the next word and to the one before.
                for k, at in ((0, j), (1, j + 1), (2, j - 1)):
                    if 0 <= at < len(words):
                        held[row[i, at], 3 * features[f] + k] = 1
    emit, move, begin = np.zeros((held.shape[1], m)), np.zeros((m, m)), np.zeros(m)
    grown = [np.full_like(x, 1e-8) for x in (emit, move, begin)]
    for _ in range(rounds):
        score = np.zeros((n, t, m))
        score[real] = held @ emit.astype(np.float32)
        p, pairs = _expected(score, size, move, begin)
        step = [(held.T @ (gold - p)[real].astype(np.float32)).astype(float), seen - pairs, first - p[:, 0].sum(0)]
        for x, d, g in zip((emit, move, begin), step, grown):
            d -= decay * x
            g += d * d
            x += rate * d / np.sqrt(g)
    # Inside labels follow only their own kind.
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            begin[j] = -50.0
            for i, frm in enumerate(LABELS):
                if frm[2:] != to[2:]:
                    move[i, j] = -50.0
    return Field(features, emit, move, begin)


def viterbi(score: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best labels of equally long stretches: score is stretches x words x labels, with what stands around a stretch already in it."""
    n, t, m = score.shape
    best, back = score[:, 0], np.zeros((n, t, m), dtype=np.int8)
    for k in range(1, t):
        x = best[:, :, None] + move
        back[:, k] = x.argmax(1)
        best = x.max(1) + score[:, k]
    out = np.zeros((n, t), dtype=np.int64)
    out[:, -1] = best.argmax(1)
    for k in range(t - 1, 0, -1):
        out[:, k - 1] = back[np.arange(n), k, out[:, k]]
    return out


def plausible(kind: int, piece: str) -> bool:
    """What a span must hold whatever its shape, as base matches must pass a count or a checksum: a card its digits and Luhn's sum, others a number of digits, a secret one digit or many letters."""
    digits = "".join(c for c in piece if "0" <= c <= "9")
    if KINDS[kind] == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    least = {"ip": 4, "phone": 7, "secret": 4, "ssn": 9, "iban": 12}.get(KINDS[kind], 0)
    if KINDS[kind] == "secret" and len(piece) >= LONG_WORD:
        least = 0
    low = piece.lower()
    return len(digits) >= least and (KINDS[kind] != "email" or "@" in low or "(at)" in low or "[at]" in low or ("at" in low and "dot" in low))


#: Forms and words that a decoder keeps before it begins anew, bytes of a word that is kept, and of the texts that are decoded at a time.
KEPT_FORMS, KEPT_WORDS, KEPT_BYTES, SLICE = 20_000, 300_000, 64, 4 << 20


class Decoder:
    """Finds the field's spans in texts; keeps what it has computed for distinct words, up to bounds."""

    def __init__(self, field: Field):
        self.field = field
        self._empty()

    def _empty(self) -> None:
        self.code: dict[bytes, int] = {}
        self.forms: dict[tuple, int] = {}
        self.table, self.marks = np.empty((1024, 3, len(LABELS))), np.empty(1024, dtype=np.int8)

    def __missing(self, word: bytes) -> int:
        text = word.decode()
        core = text.rstrip(".,")
        if core.isalpha() and core[1:].islower() and text.count(".") < 3 and core.lower() not in CUES:
            # All such words have the features of a short one, or of a long one.
            text = ("A" if "A" <= core[0] <= "Z" else "a") + ("bc"[: len(core) - 1] if len(core) < LONG_WORD else "b" * (LONG_WORD - 1)) + text[len(core) :]
        key = word_features(text)
        k = self.forms.get(key)
        if k is None:
            k = self.forms[key] = len(self.forms)
            if k == len(self.table):
                self.table, self.marks = np.concatenate([self.table, np.empty_like(self.table)]), np.concatenate([self.marks, np.empty_like(self.marks)])
            self.table[k], self.marks[k] = self.field.columns(text), is_marked(key)
        if len(word) <= KEPT_BYTES:
            self.code[word] = k
        return k

    def codes(self, words: list[bytes]) -> np.ndarray:
        get, out = self.code.get, np.empty(len(words), dtype=np.int64)
        found = [get(w, -1) for w in words]
        for j, k in enumerate(found):
            if k < 0:
                k2 = get(words[j], -1)
                found[j] = self.__missing(words[j]) if k2 < 0 else k2
        out[:] = found
        return out

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """The field's spans of each text: start, kind, end in code points, by start."""
        out: list[list[Span]] = []
        at = 0
        while at < len(texts):
            end, held = at + 1, len(texts[at])
            while end < len(texts) and held + len(texts[end]) <= SLICE:
                held, end = held + len(texts[end]), end + 1
            if len(self.forms) > KEPT_FORMS or len(self.code) > KEPT_WORDS:
                self._empty()
            out += self._spans(texts[at:end])
            at = end
        return out

    def _spans(self, texts: list[str]) -> list[list[Span]]:
        out: list[list[Span]] = [[] for _ in texts]
        each = [self.codes(t.encode().split()) for t in texts]
        lengths = np.array([len(c) for c in each])
        code = np.concatenate(each) if len(each) else np.empty(0, dtype=np.int64)
        if not len(code):
            return out
        table = self.table[: len(self.forms)]
        own = np.repeat(np.arange(len(texts)), lengths)
        # Which words may be inside: the most that their own form, the one before and the one after can give to any label.
        gain = [table[:, k, 1:] - table[:, k, :1] for k in range(3)]
        own_most, after_most, before_most = (gain[0] + self.field.margin).max(1), gain[1].max(1), gain[2].max(1)
        most, same = own_most[code], own[1:] == own[:-1]
        most[1:] += np.where(same, after_most[code[:-1]], 0.0)
        most[:-1] += np.where(same, before_most[code[1:]], 0.0)
        marks = self.marks[code]
        near = marks > 0
        near = near | np.append(near[1:] & same, False) | np.append(False, near[:-1] & same)
        for back in (2, 3):  # from a bare "dot"
            near[:-back] |= (marks[back:] == 2) & (own[back:] == own[:-back])
        spots = np.flatnonzero((most > 0) & near)
        if not len(spots):
            return out
        # Exact scores for those words, by their real neighbours.
        score = table[code[spots], 0].copy()
        before = np.maximum(spots - 1, 0)
        has = (spots > 0) & (own[before] == own[spots])
        score[has] += table[code[before[has]], 1]
        after = np.minimum(spots + 1, len(code) - 1)
        has_next = (spots + 1 < len(code)) & (own[after] == own[spots])
        score[has_next] += table[code[after[has_next]], 2]
        still = ((score[:, 1:] - score[:, :1]) + self.field.margin > 0).any(1)
        spots, score = spots[still], score[still]
        if not len(spots):
            return out
        new = np.concatenate([[True], (np.diff(spots) > 1) | (np.diff(own[spots]) != 0)])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(spots)))
        # Before a stretch stands an outside word or the text's begin; after it an outside word or nothing.
        move, begin, final = self.field.move, self.field.begin, first + length - 1
        head = (spots[first] == 0) | (own[np.maximum(spots[first] - 1, 0)] != own[spots[first]])
        tail = (spots[final] + 1 == len(code)) | (own[np.minimum(spots[final] + 1, len(code) - 1)] != own[spots[final]])
        score[first] += np.where(head[:, None], begin, move[0])
        score[final] += np.where(tail[:, None], 0.0, move[:, 0])
        labels = np.zeros(len(spots), dtype=np.int64)
        for n in np.unique(length):
            for part in np.array_split(first[length == n], max(1, int((length == n).sum() * n) // 200_000)):
                at = part[:, None] + np.arange(n)
                labels[at] = viterbi(score[at], move)
        starts_at = np.concatenate([[0], np.cumsum(lengths)])
        marked = spots[labels > 0]
        kinds = dict(zip(spots.tolist(), labels.tolist()))
        for doc in np.unique(own[marked]):
            words = [m.span() for m in _WORD.finditer(texts[doc])]
            mine = marked[(marked >= starts_at[doc]) & (marked < starts_at[doc + 1])]
            spans: list[list[int]] = []
            last = -2
            for w in mine.tolist():
                label = LABELS[kinds[w]]
                a, b = words[w - starts_at[doc]]
                k = KINDS.index(label[2:])
                if label[0] == "I" and spans and w == last + 1 and spans[-1][1] == k:
                    spans[-1][2] = b
                else:
                    spans.append([a, k, b])
                last = w
            for a, k, b in spans:
                piece = texts[doc][a:b]
                left = len(piece) - len(piece.lstrip("\"',;"))
                right = len(piece.rstrip("\"',;.!?"))
                if left < right and plausible(k, piece[left:right]):
                    out[doc].append((a + left, k, a + right))
        return out


def _join(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _added(base: list[Span], more: list[Span]) -> list[Span]:
    """Base spans and those of ``more`` that overlap none of them, by start and then kind."""
    return sorted([*base, *(m for m in more if not any(m[0] < b[2] and b[0] < m[2] for b in base))])


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or stretch of overlapping spans, replaced by the kind in brackets."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], "<", KINDS[k].upper(), ">"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _finder(field: Field, want_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(field)
        for batch in batches:
            raw = batch.column("text").to_pylist()
            texts = [x or "" for x in raw]
            base = [base_spans(t) for t in texts]
            every = [_added(b, m) for b, m in zip(base, decoder.spans(texts))]
            text = [None if x is None else redacted(x, s) for x, s in zip(raw, every)] if want_text else [None] * len(raw)
            cols = [[_join(b) for b in base], [_join(s) for s in every], text]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, pa.string()) for c in cols)], names=["row", "base", "spans", "redacted"])

    return run


def _found(docs: DataFrame, columns: list[str], text_col: str, field: Field | None, want_text: bool) -> DataFrame:
    """row (a struct of the columns, so that their names are free), base, spans, redacted."""
    arrow_batches(docs.sparkSession)
    row = F.struct(*columns) if columns else F.struct(F.lit(None).cast("string").alias("none"))
    one = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    strings = [T.StructField(c, T.StringType()) for c in ("base", "spans", "redacted")]
    return one.mapInArrow(_finder(field or train(), want_text), T.StructType([one.schema["row"], *strings]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """Per row: the id, base and spans (strings ``kind:start:end`` by start and then kind, comma-joined; code points, end exclusive)."""
    return _found(docs, [id_col], text_col, field, False).select("row.*", "base", "spans")


def redact(docs: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """The table with each span in its text replaced by its kind in angle brackets; other columns as they are."""
    found = _found(docs, [c for c in docs.columns if c != text_col], text_col, field, True)
    return found.select(*[F.col("redacted").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
