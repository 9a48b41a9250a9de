"""Personal data: boosted trees choose among candidate spans.

Base rules (email, ip, card, phone) always stand. Beside them, high-recall generators
propose further, overlapping spans: written-out addresses, IPv6, every run of digit
groups that could be a card or a phone, long mixed tokens that could be a secret.
Gradient-boosted trees score each candidate by its format and by the words around
it; per-kind thresholds, calibrated on a held-out part of the training set for
precision, select the spans that are added, the better ones first. The training set
is made here from seeded templates, in which every ordinary format stands for
personal data and for look-alikes, alone and beside other numbers.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts_to_python

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans: those of the base rules, and secrets such as access tokens.
ADDED = (*KINDS, "secret")

# Base rules (fixed patterns of the contract). What cannot begin a match is skipped
# by look-behinds and possessive runs, so that long runs cost no more than their length.
_EMAIL_TAIL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        head = _EMAIL_HEAD.match(text[done:at][::-1]).end()
        if head and (m := _EMAIL_TAIL.match(text, at + 1)):
            out.append((at - head, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]


def _cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d)]


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]


BASE = dict(zip(KINDS, (_emails, _ips, _cards, _phones)))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [(k, a, z) for k in KINDS for a, z in BASE[k](text)]


# Generators: high recall, spans may overlap. Possessive runs and look-behinds keep them linear.
_AT, _DOT = r"(?:@|\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20)", r"(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20)"
PATTERNS = {
    "email": re.compile(rf"(?<![\w.%+-])[\w.%+-]{{1,64}}+{_AT}[\w-]{{1,63}}+(?:{_DOT}[\w-]{{1,63}}+)+"),
    "ip": re.compile(r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}|[0-9]{1,3}(?:[.\x20]{1,3}[0-9]{1,3}){3})(?![\w:])"),
    "secret": re.compile(r"(?<![\w/+.-])(?=[A-Za-z_/+-]*+[0-9]|[A-Za-z]{2,4}_|[A-Z]{16})[A-Za-z0-9_/+-]{16,512}+={0,2}(?![\w/+-])"),
}
#: Digit groups with one to three separators between them.
_RUN = re.compile(r"[0-9]++(?:[\x20./()_-]{1,3}[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
#: Digits of cards and phones, and the most digit groups of a phone.
CARD_DIGITS, PHONE_DIGITS, PHONE_GROUPS = (13, 19), (7, 15), 6


def _of_run(text: str, at: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Spans of consecutive digit groups that could be an address, a card or a phone: a bounded number for each group."""
    groups = [m.span() for m in _GROUP.finditer(text, at, end)]
    for i, (a, _) in enumerate(groups):
        lead = a
        while lead and a - lead < 2 and text[lead - 1] in "+(":
            lead -= 1
        word = text[lead - 1 : lead] if lead else ""
        glued = word.isalpha() or word == "_"
        n = 0
        if i + 3 < len(groups) and all(text[groups[k][1] : groups[k + 1][0]] == "." for k in range(i, i + 3)) and groups[i + 3][1] - a <= 15:
            yield "ip", a, groups[i + 3][1]
        for k in range(i, len(groups)):
            n += groups[k][1] - groups[k][0]
            if n > CARD_DIGITS[1]:
                break
            z = groups[k][1]
            if text[z : z + 1].isalpha():
                continue
            if n >= CARD_DIGITS[0] and not glued:
                yield "card", a, z
            if PHONE_DIGITS[0] <= n <= PHONE_DIGITS[1] and k - i < PHONE_GROUPS and not glued and (k > i or lead < a or text[a] == "0"):
                yield "phone", lead, z


def candidates(text: str) -> list[tuple[str, int, int]]:
    """All spans that the generators propose."""
    out = [(kind, *m.span()) for kind, p in PATTERNS.items() for m in p.finditer(text)]
    for m in _RUN.finditer(text):
        if m.end() - m.start() >= PHONE_DIGITS[0]:
            out += _of_run(text, *m.span())
    return list(dict.fromkeys(out))


#: Words that speak for or against a kind when they stand shortly before a span (fixed values).
CUES = {
    "email": ("mail", "e-mail", "contact", "write", "adresse", "correo"),
    "ip": ("ip", "host", "server", "address", "addr", "from", "ping", "login"),
    "card": ("card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta", "payment"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "ring", "telefon", "portable", "llame"),
    "secret": ("key", "token", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "apikey", "api_key", "access_key"),
    "other": ("order", "invoice", "version", "ver", "isbn", "page", "no", "nr", "id", "ticket", "art", "section", "chapter", "release", "build", "serial", "total", "year", "sha", "checksum", "commit", "hash", "file", "path"),
}
_WORDS = re.compile(r"[^\W\d_][\w-]*")
_SEPARATED = re.compile(r"[0-9][\x20./()_-]{0,3}$")


def features(text: str, kind: str, a: int, z: int) -> list[float]:
    """Format of a span, and the words and characters around it."""
    s = text[a:z]
    groups = _GROUP.findall(s)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    near = [w.lower() for w in _WORDS.findall(text[max(0, a - 40) : a])[-3:]]
    before, after = text[a - 1 : a], text[z : z + 1]
    lead = text[max(0, a - 4) : a].rstrip("\"'`\x20")
    low = s.lower()
    counts = [s.count(c) for c in set(s)] if kind == "secret" else []
    return [
        float(ADDED.index(kind)),
        len(s),
        len(digits),
        len(groups),
        max(sizes),
        min(sizes),
        sizes[0],
        sizes[-1],
        float(luhn(digits)) if digits else 0.0,
        s.startswith("+"),
        s.startswith("00"),
        s.startswith("0"),
        "(" in s,
        s.count("."),
        s.count("-"),
        s.count(" "),
        s.count("/"),
        s.count(":"),
        "::" in s,
        "@" in s,
        " at " in low,
        "[at]" in low.replace(" ", "") or "(at)" in low.replace(" ", ""),
        len(re.split(r"[.\x20]", s.rstrip(")]} "))[-1]) if kind == "email" else 0,
        all(int(g[:4]) <= 255 for g in groups) if groups else 0,
        sum(c in "abcdefABCDEF" for c in s),
        max((3 - k for k, w in enumerate(reversed(near)) if w in CUES[kind]), default=0),
        max((3 - k for k, w in enumerate(reversed(near)) if w in CUES["other"]), default=0),
        any(w in CUES[k] for w in near for k in ADDED if k != kind),
        before in ("$", "€", "£", "#"),
        before.isalnum(),
        after in ("%", "$", "€", "=", "*"),
        bool(text[max(0, a - 8) : a].strip()),
        bool(_SEPARATED.search(text[max(0, a - 4) : a])),  # further digits right before and after
        bool(re.match(r"[\x20./()_-]{0,3}[0-9]", text[z : z + 4])),
        lead.endswith(("=", ":")) or lead.endswith("=>"),
        -sum(c / len(s) * np.log2(c / len(s)) for c in counts) if counts else 0.0,
        sum(c.islower() for c in s) / len(s) if kind == "secret" else 0.0,
        sum(c.isupper() for c in s) / len(s) if kind == "secret" else 0.0,
        len(set(sizes)),
        s.count("(") != s.count(")"),
    ]


class Trees:
    """Gradient-boosted regression trees for a 0/1 label, on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 5, rate: float = 0.25, bins: int = 24, l2: float = 1.0):
        self.depth, self.trees = depth, []
        self.prior = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        coded = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        score = np.full(len(y), self.prior)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), int)
            which, at = np.full(2**depth - 1, -1), np.zeros(2**depth - 1)
            for level in range(depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    best = (1e-9, -1, 0)
                    if len(rows) >= 10:
                        gs, hs = g[rows].sum(), h[rows].sum()
                        for j, c in enumerate(cuts):
                            if len(c):
                                gl = np.cumsum(np.bincount(coded[rows, j], g[rows], len(c) + 1))[:-1]
                                hl = np.cumsum(np.bincount(coded[rows, j], h[rows], len(c) + 1))[:-1]
                                gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                                b = int(gain.argmax())
                                if gain[b] > best[0]:
                                    best = (float(gain[b]), j, b)
                    if best[1] >= 0:
                        which[k], at[k] = best[1], cuts[best[1]][best[2]]
                        node[rows] = 2 * k + 1 + (coded[rows, best[1]] > best[2])
                    else:
                        node[rows] = 2 * k + 1
            leaf = node - (2**depth - 1)
            value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
            score += value[leaf]
            self.trees.append((which, at, value))

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for which, at, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                j = which[node]
                node = 2 * node + 1 + ((j >= 0) & (x[rows, j] > at[node]))
            score += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-score))


def _examples(n: int, seed: int) -> Iterator[tuple[str, set[tuple[str, int, int]]]]:
    """(text, its personal data): ordinary formats and look-alikes, alone and beside each other, in made-up prose."""
    r = random.Random(seed)
    parts = ["an", "the", "re", "ion", "er", "st", "lo", "ka", "mi", "ous", "é", "ü", "ñ", "ße", "que", "zu", "Ha", "O"]
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    some = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def card(valid: bool) -> str:
        d = number(r.choice([12, 14, 15, 15, 15, 15, 18]))
        check = next(c for c in "0123456789" if luhn(d + c))
        d += check if valid else r.choice([c for c in "0123456789" if c != check])
        sizes = r.choice([[19], [19], [4] * 5, [4, 6, 5, 9]])
        out, at = [], 0
        for k in sizes:
            out.append(d[at : at + k])
            at += k
        return r.choice(["", " ", " ", "-", "-", ".", "/", "_", "  "]).join(x for x in out if x)

    def phone() -> str:
        return r.choice([
            f"({number(3)}) {number(3)}-{number(4)}", f"00{r.choice(['49', '33', '34', '44', '1'])} {number(3)} {number(r.randint(5, 7))}", f"0{number(2)}/{number(4)}-{number(3)}", f"0{number(3)} {number(3)} {number(4)}",
            f"+{r.choice(['1', '44', '49', '33', '34', '352'])} {r.choice(['(', ''])}{number(3)}{r.choice([')', ''])} {number(3)}-{number(4)}".replace("+1 (", "+1 ("), f"+{number(2)}{number(9)}", f"0{number(9)}", f"0{number(r.randint(2, 4))}{r.choice([' ', '/', '-', ' / '])}{number(r.randint(5, 8))}", f"0{number(r.randint(1, 3))} {number(r.randint(2, 4))} {number(r.randint(2, 4))} {number(r.randint(2, 3))}", f"{r.randint(200, 999)}-{number(3)}-{number(4)}", f"{r.randint(200, 999)}.{number(3)}.{number(4)}", f"+{number(2)} {number(2)} {number(2)} {number(2)} {number(2)}",
        ])

    def good(kind: str) -> str:
        if kind == "email":
            at, dot = r.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), ("@", "."), ("@", ".")])
            return f"{word()}{r.choice(['.', '_', '', '-'])}{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'info'])}"
        if kind == "ip":
            return r.choice([":".join(f"{r.randrange(65536):x}" for _ in range(8)), f"2001:db8::{r.randrange(65536):x}:{r.randrange(65536):x}", f"fe80::{r.randrange(65536):x}:{r.randrange(65536):x}:{r.randrange(65536):x}", ".".join(str(r.randrange(256)) for _ in range(4))])
        if kind == "card":
            return card(True)
        if kind == "phone":
            return phone()
        return r.choice([some("0123456789abcdef", r.choice([32, 40, 64])), some(base62, r.randint(15, 63)) + number(1), some(base62, r.randint(15, 63)) + number(1), some(base62 + "0123456789" * r.randint(2, 20), r.randint(16, 48)), "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "sk_live_" + some(base62, 24), "ghp_" + some(base62, 36), some(base62 + "+/", 43) + "="])

    def alike(kind: str) -> str:
        """What looks like the kind and isn't."""
        if kind == "email":
            return r.choice([f"{word()} at {word()}. {word()}", f"{word()} at {word()}.{word()} {word()}", f"{word()}@{word()}.{number(1)}"])
        if kind == "ip":
            return r.choice([f"{r.randrange(24)}:{r.randrange(10, 60)}:{r.randrange(10, 60)}", " ".join(number(r.randint(1, 3)) for _ in range(4)), "::", f"{number(2)}:{number(2)}:{number(2)}:{number(2)}", f"{number(1)}.{number(2)}. {number(1)}.{number(2)}"])
        if kind == "card":
            return card(False)
        if kind == "phone":
            return r.choice([f"{r.randint(1900, 2030)}-{number(2)}-{number(2)}", f"{number(2)}.{number(2)}.{r.randint(1900, 2030)}", f"{number(3)}-{number(2)}", f"{number(2)} {number(3)} {number(3)}", f"{number(1)}.{number(2)}", f"978-{number(1)}-{number(4)}-{number(4)}", f"{number(1)}.{number(3)}.{number(3)}", f"{number(4)} {number(4)}", f"{number(2)}-{number(2)}, {number(2)}-{number(2)}", f"{number(2)}/{number(2)}/{r.randint(1900, 2030)} {number(2)}.{number(2)}"])
        return r.choice(["-".join(some("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), f"{word()}/{word()}/{word()}{number(3)}/{word()}", f"{word()}_{word()}_{number(4)}_{word()}{word()}", f"{word()}-{word()}-{word()}-{number(2)}-{word()}", some("0123456789abcdef", r.choice([40, 64]))])

    for _ in range(n):
        kind, sure = r.choice(ADDED), r.random() < 0.5
        text, truth = f"{word()} {word()}{r.choice(['', '.', ','])} ", set()
        cue = r.random()
        if kind == "secret" and (sure or r.random() < 0.3):  # a secret is one by what it is called
            text += r.choice([f'{r.choice(CUES["secret"])} = "', f"{r.choice(CUES['secret'])}: ", f"{r.choice(CUES['secret'])}=", f"{r.choice(CUES['secret'])} "]) if sure else f"{r.choice(['sha', 'checksum', 'commit', 'hash', 'id', 'file', word()])}{r.choice([': ', ' ', '='])}"
        elif cue < (0.4 if sure else 0.1):
            text += f"{r.choice(CUES[kind])}{r.choice([': ', ' ', '. ', ' is '])}"
        elif cue < (0.42 if sure else 0.5):
            text += f"{r.choice(CUES['other'])}{r.choice([': ', ' ', '. '])}"
        else:
            text += f"{word()} "
        made = good(kind) if sure else alike(kind)
        for k in range(r.choice([1, 1, 1, 2, 3])):
            if sure:
                truth.add((kind, len(text), len(text) + len(made)))
            text += made + r.choice([" ", " ", ", ", '" ', "; ", ". ", ") "])
            if kind in ("email", "secret"):
                break
            sure = r.random() < 0.5 if k == 0 else sure  # what stands beside it
            if r.random() < 0.3:
                made = good(kind) if sure else alike(kind)
            elif sure:
                kind = r.choice(("card", "phone", "ip"))
                made = good(kind)
            else:
                made = alike(kind)
        yield f"{text}{word()} {word()}.", truth


#: Examples from which the trees are trained and calibrated, and the precision that thresholds are set for.
TRAIN_ROWS, PRECISION, SEED = 12000, 0.99, 5


def _labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels, kinds and examples of the candidates in n examples; a span that misses the right bounds is an example against it."""
    x, y, kinds, of = [], [], [], []
    for k, (text, truth) in enumerate(_examples(n, seed)):
        for c in candidates(text):
            x.append(features(text, *c))
            y.append(float(c in truth))
            kinds.append(c[0])
            of.append(k)
    return np.array(x, float), np.array(y), np.array(kinds), np.array(of)


@functools.cache
def trained(rows: int = TRAIN_ROWS, precision: float = PRECISION, seed: int = SEED) -> tuple[Trees, dict[str, float]]:
    """Trees, and for each kind the least score that holds the precision on the held-out third of the examples."""
    x, y, kinds, of = _labelled(rows, seed)
    held = of % 3 == 0
    trees = Trees(x[~held], y[~held])
    score = trees.predict(x[held])
    least = {}
    for k in ADDED:
        mine = kinds[held] == k
        order = np.argsort(-score[mine])
        hits = np.cumsum(y[held][mine][order]) / np.arange(1, mine.sum() + 1)
        ok = np.flatnonzero(hits >= precision)
        least[k] = max(0.5, float(score[mine][order][ok[-1]])) if len(ok) else 2.0
    return trees, least


class _Spans:
    """Spans without overlaps, in order: whether another fits is found by bisection."""

    def __init__(self):
        self.starts, self.ends = [], []

    def add(self, a: int, z: int) -> bool:
        k = bisect.bisect_right(self.starts, a)
        if k and self.ends[k - 1] > a or k < len(self.starts) and self.starts[k] < z:
            return False
        self.starts.insert(k, a)
        self.ends.insert(k, z)
        return True


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], model) -> list[list[tuple[str, int, int, float]]]:
    """Candidates that the trees select, the best first; they do not overlap each other.

    One that overlaps a base span is added only if it holds the whole of it and more.
    """
    trees, least = model
    found, x = [], []
    for i, text in enumerate(texts):
        more = candidates(text)
        if not more:
            continue
        taken = sorted({(a, z) for _, a, z in base[i]})
        starts, reach = [a for a, _ in taken], list(itertools.accumulate((z for _, z in taken), max))
        for kind, a, z in more:
            k = bisect.bisect_left(starts, z) - 1  # base spans that begin before z
            fine = True
            while k >= 0 and reach[k] > a:
                s, e = taken[k]
                if e > a and not (a <= s and e <= z and (a, z) != (s, e)):
                    fine = False
                    break
                k -= 1
            if fine:
                found.append((i, kind, a, z))
                x.append(features(text, kind, a, z))
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    if found:
        score = trees.predict(np.array(x, float))
        chosen: dict[int, _Spans] = {}
        for k in np.argsort(-score, kind="stable"):
            i, kind, a, z = found[k]
            if score[k] >= least[kind] and chosen.setdefault(i, _Spans()).add(a, z):
                out[i].append((kind, a, z, float(score[k])))
    return out


SPAN = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model=None) -> DataFrame:
    """(id, spans, redacted): all spans by kind and start, and the text with each replaced by its kind.

    Places count code points, ends are exclusive. A null text counts as empty and has no
    spans. Each row stands for itself; other columns are not read. No shuffle; the trees
    (a few kB) are shipped with the function.
    """
    texts_to_python(docs.sparkSession)
    kind_of = dict(docs.dtypes)[id_col]
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = [x or "" for x in b.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                rows, redacted = [], []
                for t, known, more in zip(texts, base, added_spans(texts, base, model)):
                    every = [(k, a, z, True, 1.0) for k, a, z in known] + [(k, a, z, False, s) for k, a, z, s in more]
                    every.sort(key=lambda s: (ADDED.index(s[0]), s[1], s[2]))
                    rows.append([dict(zip(("kind", "start", "end", "base", "score"), s)) for s in every])
                    done, out = 0, []
                    for k, a, z, *_ in sorted(every, key=lambda s: (s[1], -s[2])):
                        if z > done:
                            out += [t[done : max(a, done)], f"<{k.upper()}>"]
                            done = z
                    redacted.append("".join(out) + t[done:])
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind), pa.array(redacted, pa.string())], ["id", "spans", "redacted"])

    out = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")).mapInArrow(run, f"id {kind_of}, spans {SPAN}, redacted string")
    return out.withColumnRenamed("id", id_col)


def listed(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
