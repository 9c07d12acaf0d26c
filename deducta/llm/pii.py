"""Personal data by candidate gradient boosting.

Exact patterns give the base spans, which always stay.  High-recall generators propose further,
overlapping spans; boosted trees in numpy score them by format and context; a threshold calibrated
for each generator selects those to redact, the most likely first, where no base span lies.

* A null or empty text has no span.  Positions are code points, ends exclusive.
* Base kinds: email, ip, card, phone.  Added kinds: email, phone, key (secrets), iban, ssn, ip6.
* Every pattern is scanned, and the candidates are selected, in time linear in the text, however long;
  memory is the text, a byte for each of its characters and its spans.
* Repeated rows are treated alike; a null doc_id keeps its row; other columns are not read.

The trees are trained here on invented examples from a fixed seed (``examples``): formats that the
base patterns miss, and look-alikes such as versions, dates, amounts, identifiers and hyphenated words.
Scale: nothing is shuffled; the model is some kilobytes and goes to every executor.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

KINDS = ("email", "ip", "card", "phone", "key", "iban", "ssn", "ip6")
Span = tuple[str, int, int]

# ---------------------------------------------------------------- base spans

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_SPACED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches of the pattern, found from each @ so that long runs cost no more than once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield "email", start, match.end()
            free = match.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def _addresses(text: str) -> Iterator[Span]:
    """Each four parts of a chain of dotted numbers."""
    for chain in _DOTTED.finditer(text):
        parts, at = chain[0].split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0")[:4] or 0) <= 255 for x in four):
                yield "ip", at, end
            at = end + 1


def base_spans(text: str) -> list[Span]:
    """The spans that always stay, by kind and then start."""
    out = list(_emails(text)) if "@" in text else []
    out += _addresses(text)
    for m in _SPACED.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# ---------------------------------------------------------------- candidates

_AT = re.compile(r"\s{0,2}(?:\[at\]|\(at\)|\{at\}|\sat\s)\s{0,2}", re.I)
_LEFT = re.compile(r"[A-Za-z0-9._+-]{1,64}$")
_RIGHT = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\s{0,2}(?:\[dot\]|\(dot\)|\{dot\}|\sdot\s)\s{0,2}|\.)[A-Za-z0-9-]{1,63}){1,4}", re.I)
_DIGITS = re.compile(r"(?<![0-9])[+(]{0,2}[0-9](?:[ ().\-/]{0,2}[0-9]){6,30}(?![0-9])")
_KEY = re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])")
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Fa-f:])")


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data, by the generator's kind; they may overlap."""
    out = []
    if "at" in text or "AT" in text:
        for m in _AT.finditer(text):
            right = _RIGHT.match(text, m.end())
            left = _LEFT.search(text[max(0, m.start() - 64) : m.start()]) if right else None
            if left:
                out.append(("email", m.start() - len(left[0]), right.end()))
    out += [("phone", m.start(), m.end()) for m in _DIGITS.finditer(text)]
    out += [("key", m.start(), m.end()) for m in _KEY.finditer(text)]
    out += [("iban", m.start(), m.end()) for m in _IBAN.finditer(text)]
    out += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)]
    if "::" in text or text.count(":") > 2:
        out += [("ip6", m.start(), m.end()) for m in _IP6.finditer(text)]
    return out


_NEAR = 28
_CUES = tuple(
    re.compile(x, re.I)
    for x in (
        r"tel|phone|call|fax|mobil|cell|whatsapp|ring",
        r"mail|contact|write|reach|address",
        r"token|key|secret|passw|api|auth|bearer|credential",
        r"ssn|social|tax",
        r"iban|account|bank|konto|compte|cuenta",
        r"isbn|version|v\.|section|page|licen|copyright|order|invoice|sku|part|serial|date|chapter|figure",
        r"ip\b|host|server|router|peer|addr",
        r"commit|sha|md5|hash|digest|checksum|revision|uuid|build",
    )
)


def _mod97(text: str) -> bool:
    x = text.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def features(text: str, span: Span) -> list[float]:
    """Format of the candidate and context on both sides."""
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - _NEAR) : a], text[b : b + 12]
    n = len(s)
    digits = [c for c in s if c.isdigit()]
    letters = [c for c in s if c.isalpha()]
    counts = [s.count(c) for c in set(s)]
    groups = re.split(r"[^A-Za-z0-9]+", s.strip("+() "))
    turns = sum((x.isdigit() != y.isdigit()) for x, y in zip(s, s[1:], strict=False))
    return [
        float(KINDS.index(kind)),
        n,
        len(digits),
        len(letters),
        sum(c.isupper() for c in letters),
        turns,
        len(groups),
        max(map(len, groups)),
        min(map(len, groups)),
        -sum(c / n * math.log2(c / n) for c in counts),
        s.count("-"),
        s.count("."),
        s.count(" "),
        s.count("("),
        s.count("/") + s.count("="),
        s.count(":"),
        float(s.startswith("+")),
        float(len(groups[-1]) == 4),
        float(all(c in "0123456789abcdefABCDEF" for c in s)),
        float(kind == "phone" and luhn("".join(digits))),
        float(kind == "iban" and _mod97(s)),
        float(bool(re.search(r"\[|\(at|dot", s, re.I))),
        float(before[-1:] in "\"'`"),
        float(bool(re.search(r"[=:]\s*[\"'`]?$", before))),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum() or after[:1] == "%"),
        float(before[-1:] in ("$", "€", "£", "#", "/", "_")),
        *(float(bool(c.search(before))) for c in _CUES),
    ]


# ---------------------------------------------------------------- boosted trees


@dataclass
class Trees:
    """Boosted regression trees of one depth: the split of every inner node, the value of every leaf."""

    column: np.ndarray  # trees x inner nodes
    limit: np.ndarray
    leaf: np.ndarray  # trees x leaves
    bias: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for column, limit, leaf in zip(self.column, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, column[node]] > limit[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, penalty: float = 1.0) -> Trees:
    """Second-order gradient boosting of logistic loss; splits are sought among quantiles of each feature."""
    limits = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, 17)[:-1])) for c in range(x.shape[1])]
    bins = np.stack([np.searchsorted(limits[c], x[:, c], "left") for c in range(x.shape[1])], axis=1)  # > limit k: bin over k
    width = max(map(len, limits)) + 1
    prior = float(np.log(y.mean() / (1 - y.mean())))
    score, inner = np.full(len(y), prior), 2**depth - 1
    columns, cuts, leaves = [], [], []
    offsets = np.arange(x.shape[1]) * width
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        column, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            if len(rows) > 1:
                flat = (bins[rows] + offsets).ravel()
                size = width * x.shape[1]
                hist = [np.bincount(flat, np.repeat(v[rows], x.shape[1]), minlength=size).reshape(-1, width) for v in (g, h)]
                left_g, left_h = (np.cumsum(v, axis=1)[:, :-1] for v in hist)
                all_g, all_h = g[rows].sum(), h[rows].sum()
                gain = left_g**2 / (left_h + penalty) + (all_g - left_g) ** 2 / (all_h - left_h + penalty) - all_g**2 / (all_h + penalty)
                for c, values in enumerate(limits):
                    gain[c, len(values) :] = -1
                best = int(gain.argmax())
                if gain.flat[best] > 1e-6:
                    column[at], cut[at] = best // (width - 1), limits[best // (width - 1)][best % (width - 1)]
            rows_all = node == at
            node[rows_all] = 2 * at + 1 + (x[rows_all, column[at]] > cut[at])
        place = node - inner
        value = -rate * np.bincount(place, g, minlength=inner + 1) / (np.bincount(place, h, minlength=inner + 1) + penalty)
        score = score + value[place]
        columns.append(column)
        cuts.append(cut)
        leaves.append(value)
    return Trees(np.array(columns), np.array(cuts), np.array(leaves), prior, depth)


def examples(count: int = 6000, seed: int = 7) -> list[tuple[str, Span, bool]]:
    """Invented texts with one candidate each, and whether it is personal data."""
    r = random.Random(seed)
    syllables = "an ber cha dor el fin gar hol is jun kel lo mar nor os pel quin ras sten tor ul ver wil yan zed".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    some = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))

    def iban() -> str:
        body = num(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        flat = f"DE{check:02d}{body}"
        return flat if r.random() < 0.5 else " ".join(flat[k : k + 4] for k in range(0, len(flat), 4))

    at, dot = (lambda: r.choice([" [at] ", " (at) ", "[at]", " at "])), (lambda: r.choice([" [dot] ", " (dot) ", "[dot]", " dot ", "."]))
    good = {
        "email": (lambda: f"{word()}{r.choice(['.', '', '_'])}{word()}{at()}{word()}{dot()}{r.choice(['com', 'org', 'net', 'example', 'de'])}", ["email", "mail me:", "contact", "write to", ""]),
        "phone": (lambda: r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(3)} {num(7)}", f"+{num(2)} {num(3)} {num(3)} {num(4)}"]), ["tel", "phone:", "call", "fax", "mobile"]),
        "key": (lambda: r.choice([hexes(40), hexes(32), some(32), "sk_" + some(29), some(r.randint(60, 1500))]), ['token = "', "api key: ", 'secret="', "password ", "Authorization: Bearer "]),
        "iban": (iban, ["IBAN", "account", "bank", "konto", ""]),
        "ssn": (lambda: f"{num(3)}-{num(2)}-{num(4)}", ["SSN", "social security", "tax id", "ssn:"]),
        "ip6": (lambda: ":".join(hexes(4) for _ in range(8)), ["ip", "host", "server", "from", ""]),
    }
    bad = {
        "email": (lambda: r.choice([f"{word()} at {word()}.{word().capitalize()}", f"{word()} at {word()}.{word().upper()}", f"{word()} at {num(1)}.{num(1)}"]), ["looking", "we met", "is", "ends"]),
        "phone": (lambda: r.choice([f"20{num(2)}-{num(2)}-{num(2)} {num(2)}", num(16), num(16), num(16), num(9), f"{num(3)}.{num(3)}.{num(3)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(4)} {num(4)} {num(4)}", f"{num(2)}.{num(2)}.{num(2)}.{num(2)}", num(12)]), ["isbn", "order", "invoice", "part", "", "version", "page", word(), word(), "date"]),
        "key": (lambda: r.choice(["-".join(word() for _ in range(6)), "".join(word() for _ in range(5)), "/".join(word() for _ in range(5)), hexes(40), "=" * 30, "-" * 25, num(24), r.choice("=-_") * r.randint(60, 1500), r.choice("-/_").join(word() for _ in range(r.randint(12, 200)))]), ["commit ", "sha ", "md5 ", "see ", "", "path ", word() + " "]),
        "iban": (lambda: f"{r.choice(['AB', 'XK', 'PN', 'SN'])}{num(2)} {some(4).upper()} {some(4).upper()} {some(4).upper()}", ["part", "serial", "sku", ""]),
        "ssn": (lambda: f"{num(3)}-{num(2)}-{num(4)}", ["part", "order", "sku", "section", word()]),
        "ip6": (lambda: r.choice([f"{num(2)}:{num(2)}:{num(2)}", "::", f"{num(1)}::{num(1)}", f"{hexes(2)}:{hexes(2)}:{hexes(2)}"]), ["date", "at", "page", word(), "std"]),
    }
    out = []
    while len(out) < count:
        positive = r.random() < 0.5
        table = good if positive else bad
        kind = r.choice(list(table))
        make, cues = table[kind]
        lead = " ".join(word() for _ in range(r.randint(1, 5))) + " " + r.choice(cues)
        lead += "" if lead.endswith(('"', " ")) else " "
        text = lead + make() + ('"' if lead.endswith('"') else r.choice([" ", ".", ", ", ""])) + " ".join(word() for _ in range(3))
        found = [c for c in candidates(text) if c[0] == kind and c[2] > len(lead)]
        if found:
            out.append((text, max(found, key=lambda c: c[2] - c[1]), positive))
    return out


@dataclass
class Model:
    trees: Trees
    limits: dict[str, float]  # by kind: the least probability that is redacted

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Selected candidates that overlap neither a base span nor a likelier candidate."""
        found = candidates(text)
        if not found:
            return []
        taken = bytearray(len(text))  # 1 where a span lies: each candidate costs its own length
        for _, a, b in base:
            taken[a:b] = b"\1" * (b - a)
        found = [c for c in found if taken.find(1, c[1], c[2]) < 0]
        if not found:
            return []
        p = np.concatenate([self.trees.probability(np.array([features(text, c) for c in found[k : k + 4096]], float)) for k in range(0, len(found), 4096)])
        out: list[Span] = []
        for k in np.lexsort((np.arange(len(found)), -p)).tolist():
            c = found[k]
            if p[k] >= self.limits.get(c[0], 2.0) and taken.find(1, c[1], c[2]) < 0:
                out.append(c)
                taken[c[1] : c[2]] = b"\1" * (c[2] - c[1])
        return out

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans), each by kind as listed and then start."""
        base = base_spans(text)
        return base, sorted(base + self.added(text, base), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


@lru_cache(maxsize=1)
def train(precision: float = 0.99) -> Model:
    """Trees on two thirds of the examples; thresholds that reach the precision on the rest, by kind."""
    rows = examples()
    x = np.array([features(t, s) for t, s, _ in rows], float)
    y = np.array([p for _, _, p in rows], float)
    fit = np.arange(len(rows)) % 3 > 0
    trees = boost(x[fit], y[fit])
    p = trees.probability(x)
    limits = {}
    for k, kind in enumerate(KINDS):
        at = np.flatnonzero(~fit & (x[:, 0] == k))
        order = at[np.argsort(-p[at], kind="stable")]
        good = np.cumsum(y[order]) >= precision * np.arange(1, len(order) + 1)
        if good.any():
            limits[kind] = max(0.5, float(p[order[np.flatnonzero(good)[-1]]]))
    return Model(trees, limits)


# ---------------------------------------------------------------- documents


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _find_batches(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names, kinds = zip(*(c.split() for c in FOUND.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base, every = model.spans(cell.as_py() or "")
                counts = [sum(s[0] == k for s in base) for k in KINDS[:4]]
                rows.append((doc_id, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(base)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if t == "string" else pa.int64()) for c, t in zip(columns, kinds, strict=True)], list(names))

    return run


def find(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, for every document."""
    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_find_batches(train()), FOUND)


def redact_text(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans by their union's first kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced in ``text``; other columns and rows as they are."""
    short_batches(docs.sparkSession)
    model = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            texts = [t if t is None else redact_text(t, model.spans(t)[1]) for t in batch.column(k).to_pylist()]
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)
