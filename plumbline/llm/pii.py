"""Personal data by candidate gradient boosting.

High-recall generators propose spans, which may overlap; boosted trees score each proposal from its format and context;
a proposal is redacted if its score reaches its kind's threshold, calibrated on held-out synthetic text for precision.
Spans of the base patterns always stay. The trees are trained here, from a seed, on synthetic sentences.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Batches, batch, texts

KINDS = ("email", "ip", "card", "phone", "secret")
_RANK = {k: i for i, k in enumerate(KINDS)}
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is entered at its beginning alone: where that fails, so does each later place in it
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return _NO_DIGIT.sub("", text)


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: the pattern has one @, so each @ is tried with all that may stand before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """What the base patterns find, by start, then kind."""
    if not _ANY.search(text):
        return []
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], _RANK[s[0]], s[2]))


# Generators beyond the base patterns: what opens a text to one (cheap), its pattern, its kind.
_SEPARATED = r"(?:[ .-]|\) ?)"
_AT = re.compile(r"@|\(at\)|\[at\]| at ", re.I | re.A).search
_ADDRESS = r"(?<![A-Za-z0-9._%+-])(?=([A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|@| at ) ?[A-Za-z0-9-]++"
_GENERATORS: tuple[tuple[Callable[[str], object], re.Pattern, str], ...] = (
    # each beginning of a local part has a proposal, as the longest may swallow the next one's; with blanks around dots and without
    (_AT, re.compile(rf"{_ADDRESS}(?: ?(?:\(dot\)|\[dot\]|\.| dot ) ?[A-Za-z0-9-]++)++))", re.I | re.A), "email"),
    (_AT, re.compile(rf"{_ADDRESS}(?:(?: ?(?:\(dot\)|\[dot\]) ?|\.| dot )[A-Za-z0-9-]++)++))", re.I | re.A), "email"),
    (lambda t: ":" in t, re.compile(r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){4,7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])"), "ip"),
    (lambda t: True, re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,18}(?![0-9])"), "card"),
    (lambda t: True, re.compile(rf"(?<![0-9+.,])(?:\(?[0-9]{{2,4}}{_SEPARATED})(?:[0-9]{{2,4}}[ .-]){{1,3}}[0-9]{{2,4}}(?![0-9.,]?[0-9])"), "phone"),
    (lambda t: True, re.compile(r"(?<![0-9])0[1-9][0-9]{7,10}(?![0-9])"), "phone"),
    (lambda t: True, re.compile(r"(?<![0-9A-Za-z_/+-])(?=[A-Za-z_/+-]*[0-9])[0-9A-Za-z_/+-]{20,}(?![0-9A-Za-z_/+-])"), "secret"),
)
_HAS_DIGIT = re.compile(r"[0-9]")


def proposals(text: str) -> list[Span]:
    out = []
    digit = bool(_HAS_DIGIT.search(text))
    for opens, pattern, kind in _GENERATORS:
        if (digit or kind == "email") and opens(text):
            out += [(kind, *m.span(pattern.groups)) for m in pattern.finditer(text)]
    return list(dict.fromkeys(out))


_WORDS = {
    "email": re.compile(r"mail|contact|write|reach|@", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|from", re.I),
    "card": re.compile(r"card|visa|master|credit|debit|payment|pay|charge|iban|account|acct", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|cell|fax|dial|ring|sms|contact|whatsapp", re.I),
    "secret": re.compile(r"token|secret|key|passw|pwd|bearer|auth|credential", re.I),
}
_PLAIN = re.compile(r"order|invoice|isbn|version|date|page|total|price|commit|sha|build|serial|part|id\b|no\.|ref", re.I)
_SPELT = re.compile(r"[(\[](?:at|dot)[)\]]| dot ", re.I | re.A)
_TOP = re.compile(r"[. )\]](?:com|org|net|edu|gov|info|io|[a-z]{2})$", re.I | re.A)
_PLAIN_LOCAL = re.compile(r"[A-Za-z]+(?: ?[@(\[]| at )", re.I | re.A)
N_FEATURES = 29


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    own, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 1]
    d = _digits(own)
    groups = [len(g) for g in re.findall(r"[0-9]+", own)]
    lead = before[-1:]
    return [
        *(float(kind == k) for k in KINDS),
        float(len(own)), float(len(d)), len(d) / len(own), float(luhn(d)), float(len(groups)),
        float(max(groups, default=0)), float(min(groups, default=0)), float(groups.count(4)), float(groups[:1] == [4] or groups[:1] == [3]),
        float(d[:1] in ("3", "4", "5", "6")), float("(" in own), float(own.count("-") + own.count(" ")), float(own.count(".")),
        float(bool(_WORDS[kind].search(before))), float(bool(_PLAIN.search(before))), float(lead.isalnum() or lead in ("#", "$", "€")),
        float(after.isalnum() or after in ("%", "/")), len(set(own)) / len(own), float(bool(re.search(r"(?:19|20)[0-9]{2}", own))),
        float(kind == "email" and "@" in own), float(kind == "email" and bool(_SPELT.search(own))), float(kind == "email" and bool(_TOP.search(own))),
        float(kind == "email" and (". " in own or " ." in own)), float(kind == "email" and bool(_PLAIN_LOCAL.match(own))),
    ]


@dataclass(frozen=True)
class Boosted:
    """Trees of depth two as arrays: feature and cut of the root and of both children, four leaves each."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    bias: float
    thresholds: dict[str, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        right = x[:, self.feature[:, 0]] > self.cut[:, 0]
        child = np.where(right, 2, 1)
        t = np.arange(len(self.feature))
        low = x[np.arange(len(x))[:, None], self.feature[t, child]] > self.cut[t, child]
        z = self.bias + self.leaf[t, 2 * right + low].sum(axis=1)
        return 1 / (1 + np.exp(-z))


def _best_cut(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    best = (-1.0, 0, np.inf)
    for f in range(x.shape[1]):
        for c in np.unique(np.quantile(x[:, f], np.linspace(0.03, 0.97, 24), method="lower")) if len(x) else ():
            r = x[:, f] > c
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (r, ~r))
            if gain > best[0]:
                best = (gain, f, float(c))
    return best[1], best[2]


def boost(x: np.ndarray, y: np.ndarray, trees: int = 30, rate: float = 0.3) -> Boosted:
    """Second-order boosting of the logistic loss."""
    bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    z = np.full(len(y), bias)
    feature, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        f, c = _best_cut(x, g, h)
        right = x[:, f] > c
        node, cut, leaf = [f], [c], [0.0] * 4
        for side in (False, True):
            s = right == side
            f2, c2 = _best_cut(x[s], g[s], h[s])
            node.append(f2)
            cut.append(c2)
            low = x[:, f2] > c2
            for hi in (False, True):
                m = s & (low == hi)
                leaf[2 * side + hi] = rate * g[m].sum() / (h[m].sum() + 1)
                z[m] += leaf[2 * side + hi]
        feature.append(node)
        cuts.append(cut)
        leaves.append(leaf)
    return Boosted(np.array(feature), np.array(cuts), np.array(leaves), bias, {})


def _synthetic(n: int, seed: int) -> Iterator[tuple[str, list[Span]]]:
    """Sentences with one number-like thing each, and the personal spans in them."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9)))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    top = lambda: rng.choice(("com", "org", "net", "edu", "de", "io"))
    coded = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-") for _ in range(k - 1)) + num(1)

    def card(valid: bool) -> str:
        d = rng.choice("3456") + num(14)
        d += next(c for c in "0123456789" if luhn(d + c) == valid)
        return rng.choice([d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))])

    personal = (
        ("card", lambda: card(True), ("card", "pay with", "visa", "")), ("card", lambda: card(False), ("card number", "credit card")),
        ("phone", lambda: f"({num(3)}) {num(3)}-{num(4)}", ("call", "phone", "")), ("phone", lambda: f"{num(3)}-{num(3)}-{num(4)}", ("tel", "mobile", "")),
        ("phone", lambda: f"0{rng.choice('123456789')}{num(8)}", ("phone", "call me at")), ("phone", lambda: " ".join(["0" + num(1), *(num(2) for _ in range(4))]), ("tel", "fax", "")),
        ("email", lambda: f"{word()} at {word()} dot com", ("mail", "write to", "")), ("email", lambda: f"{word()}[at]{word()}[dot]org", ("contact", "")),
        ("ip", lambda: ":".join(hexes(4) for _ in range(8)), ("host", "from", "")), ("secret", lambda: hexes(40), ("token =", 'token = "', "api key:", "secret", "password:")),
        ("email", lambda: f"{word()}.{word()} at {word()}.{top()}", ("mail", "contact", "")), ("email", lambda: f"{word()}.{word()} @ {word()}.{word()}.{top()}", ("write to", "")),
        ("email", lambda: f"{word()} at {word()}.{top()}", ("mail", "write to", "contact")), ("email", lambda: rng.choice((f"{word()} at {word()} dot {top()}", f"{word()}[at]{word()}[dot]{top()}", f"{word()} (at) {word()} (dot) {top()}")).upper(), ("mail", "contact", "")),
        ("email", lambda: f"{word()} @ {word()} . {top()}", ("mail", "")), ("secret", lambda: rng.choice((hexes, coded))(rng.randint(201, 700)), ("token =", 'token = "', "api key:", "secret", "password:")),
    )
    plain = (
        (lambda: num(16), ("order", "serial", "", "total")), (lambda: card(False), ("", "invoice", "ref")), (lambda: f"{rng.randint(1900, 2099)}-{num(2)}-{num(2)}", ("date", "")),
        (lambda: f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", ("isbn",)), (lambda: f"{num(2)}.{num(2)}.{rng.randint(1900, 2099)}", ("date", "")), (lambda: hexes(40), ("commit", "sha", "build", "")),
        (lambda: f"{num(3)} {num(3)} {num(3)}", ("total", "", "page")), (lambda: ":".join(num(2) for _ in range(6)), ("date", "")), (lambda: "/".join(word() for _ in range(5)) + num(2), ("", "page")),
        (lambda: f"0{num(9)}", ("id", "serial", "order")), (lambda: f"{num(2)}-{num(2)}-{num(2)}-{num(2)}", ("part", "")),
        (lambda: f"{word()} at {word()}. {word().title()}", ("", "contact", "reach")), (lambda: f"{word()} {rng.choice(('at', '@'))} {num(2)}.{num(2)}", ("", "price", "contact")), (lambda: f"{word()} at {word()}.{top()}", ("",)),
        (lambda: rng.choice((hexes, coded))(rng.randint(201, 700)), ("commit", "sha", "build", "")), (lambda: "/".join(word() for _ in range(60)) + num(2), ("", "page")),
    )
    for _ in range(n):
        left, right = " ".join(word() for _ in range(rng.randint(6, 9))), " ".join(word() for _ in range(3))
        if rng.random() < 0.5:
            kind, make, hints = rng.choice(personal)
        else:
            kind, (make, hints) = "", rng.choice(plain)
        hint, own = rng.choice(hints), make()
        lead = f"{left} {hint}{'' if hint.endswith(chr(34)) or not hint else ' '}"
        yield f"{lead}{own}{rng.choice(['', '.', ',', ' '])} {right}", [(kind, len(lead), len(lead) + len(own))] if kind else []


@functools.lru_cache(maxsize=4)
def trained(n: int = 3000, seed: int = 11, precision: float = 0.97) -> Boosted:
    def examples(seed: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
        x, y, kinds = [], [], []
        for text, truth in _synthetic(n, seed):
            for s in proposals(text):
                x.append(features(text, s))
                y.append(float(any(t[0] == s[0] and s[1] < t[2] and t[1] < s[2] and (s[0] != "email" or s == t) for t in truth)))
                kinds.append(s[0])
        return np.array(x), np.array(y), kinds

    model = boost(*examples(seed)[:2])
    x, y, kinds = examples(seed + 1)
    score, kinds = model.score(x), np.array(kinds)
    limits = {}
    for k in KINDS:
        own = kinds == k
        order = np.argsort(-score[own], kind="stable")
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= precision)
        limits[k] = float(max(0.5, score[own][order][good[-1]])) if len(good) else 2.0
    return Boosted(model.feature, model.cut, model.leaf, model.bias, limits)


def held_out_rates(model: Boosted | None = None, n: int = 3000, seed: int = 99) -> dict[str, tuple[float, float]]:
    """Precision and recall of the added spans by kind, on synthetic sentences that neither training nor calibration saw.
    A span is right if it covers the true one and at most a character more at each side."""
    model, right, said, there = model or trained(), Counter(), Counter(), Counter()
    sentences = list(_synthetic(n, seed))
    for (text, truth), (_, found) in zip(sentences, all_spans([t for t, _ in sentences], model)):
        near = lambda a, b: a[0] == b[0] and b[1] - 1 <= a[1] <= b[1] and b[2] <= a[2] <= b[2] + 1
        said.update(k for k, *_ in found)
        there.update(k for k, *_ in truth)
        right.update(t[0] for t in truth if any(near(s, t) for s in found))
    return {k: (right[k] / max(said[k], 1), right[k] / max(there[k], 1)) for k in KINDS}


def all_spans(own: list[str], model: Boosted) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text. Proposals are taken by score where they overlap nothing taken before."""
    base = [base_spans(t) for t in own]
    found = [(i, s) for i, t in enumerate(own) for s in proposals(t)]
    x = np.array([features(own[i], s) for i, s in found], np.float64).reshape(len(found), N_FEATURES)
    score = model.score(x) if len(found) else np.zeros(0)
    best: dict[int, list[tuple[float, Span]]] = {}
    for (i, s), v in zip(found, score.tolist()):
        if v >= model.thresholds[s[0]]:
            best.setdefault(i, []).append((v, s))
    out = []
    for i, mine in enumerate(base):
        every = mine
        if i in best:
            taken = _Taken(mine)
            every = sorted(mine + [s for _, s in sorted(best[i], key=lambda b: (-b[0], b[1])) if taken.add(s)], key=lambda s: (s[1], _RANK[s[0]], s[2]))
        out.append((mine, every))
    return out


class _Taken:
    """Which code points are taken, kept as a sorted list of disjoint spans."""

    def __init__(self, spans: list[Span]):
        self.spans: list[tuple[int, int]] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.spans and a <= self.spans[-1][1]:
                self.spans[-1] = (self.spans[-1][0], max(b, self.spans[-1][1]))
            else:
                self.spans.append((a, b))

    def add(self, span: Span) -> bool:
        from bisect import bisect_left, insort

        _, a, b = span
        i = bisect_left(self.spans, (a, a))
        if i and self.spans[i - 1][1] > a or i < len(self.spans) and self.spans[i][0] < b:
            return False
        insort(self.spans, (a, b))
        return True


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_FIELDS = [("doc_id", "long"), ("n_email", "long"), ("n_ip", "long"), ("n_card", "long"), ("n_phone", "long"), ("base_sha256", "string"), ("spans", "string")]
_SCHEMA = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in _FIELDS])


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Boosted | None = None) -> DataFrame:
    """doc_id, numbers of base spans by kind, a digest of them, and all spans (code points, end exclusive).

    A null text is an empty one; a null id stays null; repeated rows are read again; texts and spans of any length are read
    whole; of overlapping proposals the likelier is taken, of equally likely ones the first by kind and place; other columns
    are not read; an empty table gives no rows. Narrow: no shuffle.
    """
    model = model or trained()
    slim = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = all_spans(texts(rows), model)
            counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in KINDS[:4]]
            yield batch(_SCHEMA, [rows.column(0), *counts, [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], [joined(e) for _, e in found]])

    return slim.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in _FIELDS))


def redacted(text: str, spans: list[Span]) -> str:
    """Spans become their kind in brackets; overlapping ones become one, named by the first."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", model: Boosted | None = None) -> DataFrame:
    """df with all spans of the texts replaced and, if there is such a column, the number of code points brought up to date.

    A null text stays null; repeated rows are redacted alike; columns of any name stay; an empty table stays empty. Narrow."""
    model, schema = model or trained(), df.schema
    has_chars = chars_col in df.columns

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            own = rows.column(text_col).to_pylist()
            new = [None if t is None else redacted(t, e) if e else t for t, (_, e) in zip(own, all_spans([t or "" for t in own], model))]
            columns = dict(zip(rows.schema.names, rows.columns))
            columns[text_col] = pa.array(new, rows.schema.field(text_col).type)
            if has_chars:
                old = rows.column(chars_col).to_pylist()
                columns[chars_col] = pa.array([n if a == b else len(b) for n, a, b in zip(old, own, new)], rows.schema.field(chars_col).type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return df.mapInArrow(run, schema)
