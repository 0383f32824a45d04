"""Personal data: base patterns, and candidates that boosted trees judge by format and context.

The base patterns (email, ip, card, phone) always count. High-recall generators propose further, overlapping spans:
written-out mail addresses, IPv6 addresses (full, or with ``::`` anywhere), card numbers with other separators, phone numbers without a plus sign.
Histogram gradient-boosted trees score each candidate from its format and the words around it; the scores are
calibrated on a held-out part of the training examples, and a kind's threshold is the lowest calibrated probability
that keeps the wanted precision there. Candidates that touch a base span are dropped, save IPv6 addresses that end in it.

No table labels spans, so the examples come from three places. From candidates in all documents (``evidence``) on which two independent views agree: the format (a card's check sum, a valid address, a date where a phone number
might be) and the words before it; where they differ or have nothing to say, a candidate stays without a label, so
neither a phone number without a plus sign nor anything else is taught to be rejected for having no base form. From base spans,
which are personal data beyond doubt, written in a form that only the generators propose, between the words around them.
And from rules (``examples``), for forms that the documents lack. Every third document is held out of the fit; calibration and
thresholds come from the held-out part, ``Judge.measured`` from its labelled candidates alone, neither rewritten nor made up,
and only for kinds with at least ``LEAST`` of them. Features are taken in the tasks, and every labelled candidate counts: its features
fall into at most ``BINS`` bins each, and the driver fits, calibrates and measures on the number of candidates in each
combination of bins (``cells``). Bins are halved until there are at most ``CELLS`` combinations. No label of one origin weighs more than
``MOST`` candidates together, or the forms that the documents lack would be lost among millions of others.

Kinds, in order: ``email``, ``ip``, ``card``, ``phone``. Defined edge cases: a null text is empty; a very long text is
scanned whole, in linear time; an empty table gives no rows (the examples are then those made by rule); rows without an
id and repeated rows are scanned each; other columns are left alone, and ``redact`` keeps them.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmill.llm import gbdt
from weftmill.llm.common import arrow_schema, drop, materialize, per_text, slices, texts
from weftmill.llm.secretscan import listed

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]++(?:(?:\.[0-9]++){3})?+")  # a run of digits is passed over whole where no address starts
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int, int]]:
    """Leftmost non-overlapping addresses, found from each @ so that the time is linear."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def scan(text: str) -> list[tuple[int, int, int]]:
    """Base finds as ``(start, kind number, end)`` in order."""
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if "." in m[0] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


_AT = re.compile(r"(?:\(at\)|\[at\]|\{at\}| at )[ ]?[A-Za-z0-9-]++(?:(?:[ ]?(?:\(dot\)|\[dot\]|\{dot\})[ ]?| dot |\.)[A-Za-z0-9-]++)+")
_V6_HEAD = re.compile(r"(?<![0-9A-Za-z_])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}\Z")
_V6_TAIL = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){0,6}(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])|[0-9A-Fa-f]{1,4}(?![0-9A-Za-z_]))")
_GENERATORS = (
    (1, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[./_ -][0-9]{4}){2,3}(?:[./_ -][0-9]{1,3})?(?![0-9])")),
    (3, re.compile(r"(?<![0-9+.])(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ ./-]{1,2}[0-9]{2,4}){2,4}(?![0-9])")),
)
_CONTEXT = (
    frozenset("mail email e-mail contact write address reach".split()),
    frozenset("ip ipv6 host server address gateway client".split()),
    frozenset("card visa credit debit mastercard payment number".split()),
    frozenset("phone tel telephone call mobile cell fax contact whatsapp dial".split()),
)
_AGAINST = frozenset("version date order invoice page isbn id total time chapter section figure score lat lon serial model revision at".split())
_WORD = re.compile(r"[A-Za-z-]+")


def _written_out(text: str) -> list[tuple[int, int, int]]:
    """Written-out mail addresses, found from each at sign."""
    out = []
    for m in _AT.finditer(text):
        stop = m.start() - (text[m.start() - 1 : m.start()] == " ")
        start = stop
        while start > 0 and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if 0 <= start < stop:
            out.append((start, 0, m.end()))
    return out


def _compressed(text: str) -> list[tuple[int, int, int]]:
    """The widest valid IPv6 address around each ``::``."""
    out, at = [], text.find("::")
    while at >= 0:
        head, tail = _V6_HEAD.search(text, max(0, at - 34), at), _V6_TAIL.match(text, at + 2)
        starts = [head.start(), *(i + 1 for i in range(head.start(), at) if text[i] == ":")] if head else []
        ends = [tail.end(), *(i for i in range(tail.end() - 1, at + 2, -1) if text[i] == ":")] if tail else []
        starts += [at] if not at or not (text[at - 1].isalnum() or text[at - 1] == "_") else []
        ends += [at + 2] if not (text[at + 2 : at + 3].isalnum() or text[at + 2 : at + 3] == "_") else []
        for start, end in sorted(((s, e) for s in starts for e in ends), key=lambda p: p[0] - p[1]):
            try:
                ipaddress.IPv6Address(text[start:end])
            except ValueError:
                continue
            out.append((start, 1, end))
            break
        at = text.find("::", at + 1)
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Overlapping proposals of all generators."""
    out = _written_out(text)
    if "::" in text:
        out += _compressed(text)
    digits = _DIGIT.search(text) is not None
    for kind, pattern in _GENERATORS:
        if (kind == 1 and text.count(":") > 2) or (kind > 1 and digits):
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    return out


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format and context of one candidate."""
    span = text[start:end]
    digits = "".join(c for c in span if c.isascii() and c.isdigit())
    groups = re.findall(r"[0-9]+", span)
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 48) : start])][-5:]
    after = [w.lower() for w in _WORD.findall(text[end : end + 32])][:3]
    around = set(before) | set(after)
    tail = span.rsplit(".", 1)[-1].rsplit(" ", 1)[-1].lower()
    separators = {c for c in span if not c.isalnum()}
    return [
        float(kind), float(len(span)), float(len(digits)), float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)), float(luhn(digits)) if digits else 0.0,
        float(len(separators)), float("(" in span), float("." in span), float("/" in span), float("-" in span), float(" " in span), float("[" in span or "(at" in span or "{" in span),
        float(span.count(" dot ") + span.count("[dot]") + span.count("(dot)") + span.count("{dot}")), float(tail in ("com", "org", "net", "edu", "io", "de", "fr", "es", "uk", "info")), float(sum(c.isalpha() for c in span)) / len(span),
        float(bool(around & _CONTEXT[kind])), float(bool(set(before[-2:]) & _CONTEXT[kind])), float(bool(set(before[-2:]) & _AGAINST)), float(digits[:1] in "3456" and bool(digits)), float(groups[0] in ("19", "20") or (len(groups[0]) == 4 and groups[0][:2] in ("19", "20")) if groups else 0),
        float(span.count(":")), float("::" in span),
    ]


def examples(n: int, seed: int = 17) -> tuple[list[tuple[str, int, int, int]], np.ndarray]:
    """Labelled candidates made by rule: personal data and look-alikes, in fitting, plain and misleading contexts."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 9))))
    num = lambda k: "".join(str(int(c)) for c in rng.integers(0, 10, k))

    def card(sep: str) -> str:
        body = pick("3456") + num(14)
        last = next(d for d in "0123456789" if luhn(body + d))
        return sep.join((body + last)[i : i + 4] for i in range(0, 16, 4))

    hexa = lambda: "".join(pick("0123456789abcdef") for _ in range(int(rng.integers(1, 5))))

    def compressed() -> str:
        if rng.random() < 0.1:
            return "::1"
        head = pick([[], ["2001", "db8"], ["fe80"], ["fd" + num(2)], ["2a0" + num(1), hexa()], [hexa(), hexa()], [hexa(), hexa(), hexa()]])
        if rng.random() < 0.1:
            return ":".join([*head, "", "ffff", ".".join(str(int(b)) for b in rng.integers(0, 256, 4))]) if head else "::ffff:" + ".".join(str(int(b)) for b in rng.integers(0, 256, 4))
        tail = [hexa() for _ in range(int(rng.integers(0 if head else 2, 8 - len(head))))]
        span = ":".join(head) + "::" + ":".join(tail)
        return span.upper() if rng.random() < 0.2 else span

    def look_alike() -> str:
        name = lambda: "".join(pick("abcdef") for _ in range(int(rng.integers(2, 5))))
        return pick(["::", f"{name()}::{name()}", f"::{name()}", f"{name()}::", f"{num(2)}::{num(2)}"])

    out, y = [], []
    for i in range(n + n // 4):
        kind, real = int(rng.integers(0, 4)), bool(rng.integers(0, 2))
        if i >= n:  # the forms that the first n leave out
            kind = int(rng.integers(0, 2))
            span = (f"{word()} at {word()}.{pick(['com', 'org', 'net', 'de', 'fr', 'io'])}" if real else f"{word()} at {word()}{pick(['. ', '.'])}{word()}") if kind == 0 else compressed() if real else look_alike()
        elif kind == 0:
            a, d = pick([("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", " dot "), ("{at}", "{dot}"), (" [at] ", " [dot] "), ("(at)", ".")])
            span = f"{word()}{a}{word()}{d}{pick(['com', 'org', 'net', 'de', 'fr', 'io'])}" if real else f"{word()} at {word()}{pick(['. ', '.', ' dot '])}{word()}"
        elif kind == 1:
            span = ":".join("".join(pick("0123456789abcdef") for _ in range(int(rng.integers(1, 5)))) for _ in range(8)) if real else ":".join(num(2) for _ in range(int(rng.integers(4, 6))))
        elif kind == 2:
            sep = pick("./_ -")
            span = card(sep) if real else sep.join(num(4) for _ in range(int(rng.integers(3, 5))))
        else:
            sep = pick(" .-")
            span = pick([f"({num(3)}) {num(3)}-{num(4)}", sep.join((num(3), num(3), num(4))), sep.join(("0" + num(2), num(3), num(2), num(2)))]) if real else pick(
                [f"{pick(['19', '20'])}{num(2)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/{pick(['19', '20'])}{num(2)}", ".".join(num(2) for _ in range(3)), "-".join((num(3), num(2), num(4), num(2))), " ".join(num(2) for _ in range(4))]
            )
        fitting = sorted(_CONTEXT[kind])
        lead = pick(fitting) if real and rng.random() < 0.6 else pick(sorted(_AGAINST)) if not real and rng.random() < 0.5 else pick(fitting) if rng.random() < 0.1 else word()
        if i >= n and kind == 1:  # the format alone tells these
            lead = pick([pick(fitting), pick(sorted(_AGAINST)), word()])
        text = f"{word()} {word()} {lead}{pick(['', ':'])} "
        text, start = text + span + f" {word()} {word()}", len(text)
        found = [c for c in candidates(text) if c[1] == kind and c[0] < start + len(span) and start < c[2]]
        for c in found:
            out.append((text, *c))
            y.append(int(real))
    return out, np.array(y)


@dataclass
class Judge:
    trees: gbdt.Trees
    thresholds: tuple[float, ...]
    slope: float
    bias: float
    measured: dict[str, tuple[int, float | None, float | None]]  #: by kind: held-out labelled candidates of documents, precision, recall

    def keep(self, text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        if not found:
            return []
        p = self.probability(np.asarray([features(text, *c) for c in found]))
        return [c for c, q in zip(found, p, strict=True) if q >= self.thresholds[c[1]]]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.raw(x) + self.bias, -40, 40)))


def untouched(found: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The candidates that no base span touches (or that are IPv6 addresses with a base address at their end)."""
    starts = [b[0] for b in base]
    reach = list(accumulate((b[2] for b in base), max))
    out = []
    for c in found:
        i = bisect_left(starts, c[2]) - 1
        free = True
        while free and i >= 0 and reach[i] > c[0]:
            s, k, e = base[i]
            free = e <= c[0] or (c[1] == k == 1 and c[0] < s and c[2] == e)
            i -= 1
        if free:
            out.append(c)
    return out


def disguised(span: str, kind: int, turn: int) -> str:
    """A base span in a form that only the generators propose."""
    digits = "".join(c for c in span if c in "0123456789")
    if kind == 0:
        local, domain = span.rsplit("@", 1)
        at, dot = (("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", " dot "), (" at ", "."), ("(at)", "."))[turn % 5]
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return "::ffff:" + span if turn % 2 else "64:ff9b::" + span
    if kind == 2:
        return ("./_"[turn % 3]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    last = digits[-10:]
    return (f"({last[:3]}) {last[3:6]}-{last[6:]}", f"{last[:3]}-{last[3:6]}-{last[6:]}", f"{last[:3]} {last[3:6]} {last[6:]}")[turn % 3]


def views(text: str, start: int, kind: int, end: int) -> tuple[int, int]:
    """What the format and what the words before a candidate say: 1 for personal data, -1 against, 0 for neither."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 48) : start])][-3:]
    words = 1 if set(before) & _CONTEXT[kind] and not set(before[-2:]) & (_AGAINST - {"at"}) else -1 if set(before[-2:]) & (_AGAINST - {"at"}) else 0
    if kind == 0:
        last = re.split(r"[^A-Za-z0-9]", span)[-1]
        form = 1 if last.isalpha() and 2 <= len(last) <= 4 else -1 if not last.isalpha() or len(last) > 8 else 0
    elif kind == 1:
        try:
            form = 1 if len(ipaddress.IPv6Address(span).compressed) > 4 else 0
        except ValueError:
            form = -1
    elif kind == 2:
        form = 1 if luhn(digits) and digits[0] in "3456" else -1
    else:
        groups = [len(g) for g in re.findall(r"[0-9]+", span)]
        dated = re.search(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])", span) and len(digits) <= 8
        form = -1 if dated or len(digits) < 7 or len(digits) > 15 or max(groups) < 3 else 1 if 9 <= len(digits) <= 12 and groups[-1] >= 2 and max(groups) <= 4 else 0
    return form, words


#: A figure wants so many held-out rows of a kind.
LEAST = 100
#: Bins of a feature, combinations of bins that are held at once, and what the candidates of one label and origin weigh at most.
BINS, CELLS, MOST = 64, 50_000, 20_000
_SOURCES = "h long, kind int, label int, rewritten boolean, x array<double>"
_CELL = "cell binary, kind int, label int, held boolean, rewritten boolean"


def evidence(docs: DataFrame, around: int = 64) -> DataFrame:
    """``h, kind, label, rewritten, x``: the labelled candidates of all documents with their features; ``h`` is the text's hash."""
    rows = texts(docs).where("text is not null").withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 30)))
    schema = arrow_schema(_SOURCES)

    def labelled(number: int, t: str):
        base = scan(t)
        for c in untouched(candidates(t), base):
            form, said = views(t, *c)
            if form == said != 0:
                yield number, c[1], int(form > 0), False, features(t, *c)
        for i, (s, k, e) in enumerate(base):
            first = max(0, s - around)
            span = disguised(t[s:e], k, number + i)
            text, start = t[first:s] + span + t[e : e + around], s - first
            for c in candidates(text):
                if c[1] == k and c[0] < start + len(span) and start < c[2]:
                    yield number, k, 1, True, features(text, *c)

    def run(batches):
        for batch in slices(batches):
            out: list[list] = [[] for _ in schema.names]
            for number, t in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for row in labelled(number, t):
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return rows.select("h", "text").mapInArrow(run, _SOURCES).distinct()


def _ends(values: np.ndarray, number: np.ndarray, made: np.ndarray, bins: int) -> np.ndarray:
    """Where the bins of a feature end: after each value, if they are few, or at quantiles of the documents' and of the made ones."""
    every = np.unique(np.concatenate([values, made]))
    if len(every) <= bins:
        return every[:-1]
    share = np.linspace(0, 1, bins // 2 + 1)[1:-1]
    own = values[np.searchsorted(np.cumsum(number), share * number.sum())] if len(values) else values
    return np.unique(np.concatenate([own, np.quantile(made, share)]))


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)


def cells(rows: DataFrame, made: np.ndarray) -> tuple[list[np.ndarray], list]:
    """``(ends of the bins, rows)``: all of ``evidence`` as ``cell, kind, label, held, rewritten, count``, at most ``CELLS`` rows."""
    v = F.col("v")
    value = F.when(v < 1000, F.round(v, 2)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(v) * 8) / 8))  # few values, whatever the table
    seen: list[list] = [[] for _ in range(made.shape[1])]
    for r in rows.select(F.posexplode("x").alias("j", "v")).groupBy("j", value.alias("v")).count().collect():
        seen[r["j"]].append((r["v"], r["count"]))
    held = rows.select("x", "kind", "label", (F.col("h") % 3 == 0).alias("held"), "rewritten")
    schema, bins = arrow_schema(_CELL), BINS
    while True:
        cuts = [_ends(np.array([a for a, _ in sorted(of)]), np.array([n for _, n in sorted(of)]), made[:, j], bins) for j, of in enumerate(seen)]

        def run(batches, cuts=cuts):
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(cuts))
                cell = pa.array([c.tobytes() for c in _binned(x, cuts)], type=pa.binary())
                yield pa.RecordBatch.from_arrays([cell, *(batch.column(n) for n in schema.names[1:])], schema=schema)

        found = held.mapInArrow(run, _CELL).groupBy(*schema.names).count().limit(CELLS + 1).collect()
        if len(found) <= CELLS or bins <= 2:
            return cuts, sorted(found)
        bins //= 2


def train(docs: DataFrame | None = None, n: int = 6000, precision: float = 0.98) -> Judge:
    """Fit the trees on two thirds of the examples; calibrate (Platt), set thresholds and measure on the rest."""
    rows, y = examples(n)
    x = np.asarray([features(*r) for r in rows])
    kind, held, own = x[:, 0].astype(int), np.arange(len(y)) % 3 == 0, np.zeros(len(y), dtype=bool)
    count, weight, cuts = np.ones(len(y)), np.ones(len(y)), None
    if docs is not None:
        seen = materialize(evidence(docs), "labelled")
        ends, found = cells(seen, x)
        drop(seen)
        if found:
            cuts = ends
            number, label, origin = np.array([r["count"] for r in found], dtype=np.float64), np.array([r["label"] for r in found]), np.array([r["rewritten"] for r in found], dtype=bool)
            most = np.zeros(len(found))
            for group in {(int(a), bool(b)) for a, b in zip(label, origin, strict=True)}:
                mine = (label == group[0]) & (origin == group[1])
                most[mine] = min(1.0, MOST / number[mine].sum())
            more = np.concatenate([_binned(x, cuts), np.frombuffer(b"".join(r["cell"] for r in found), np.uint8).reshape(len(found), -1)])
            x = np.stack([np.append(c, np.inf)[more[:, j]] for j, c in enumerate(cuts)], axis=1)  # a bin by its end
            kind, held = np.concatenate([kind, [r["kind"] for r in found]]), np.concatenate([held, [r["held"] for r in found]])
            y, own = np.concatenate([y, label]), np.concatenate([own, ~origin])
            count, weight = np.concatenate([count, number]), np.concatenate([weight, number * most])
    trees = gbdt.fit(x[~held], y[~held], trees=60, depth=4, rate=0.2, bins=BINS, weight=weight[~held], cuts=cuts, count=count[~held])
    raw, truth, w, total = trees.raw(x[held]), y[held], weight[held], weight[held].sum()
    slope, bias = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(slope * raw + bias, -40, 40)))
        slope -= 0.05 * float((w * (p - truth) * raw).sum() / total)
        bias -= 0.05 * float((w * (p - truth)).sum() / total)
    judge = Judge(trees, (1.0,) * 4, slope, bias, {})
    p = judge.probability(x[held])
    found = []
    for k in range(4):
        of = kind[held] == k
        q, t, mine, n_of, w_of = p[of], truth[of], own[held][of], count[held][of], w[of]
        good = [v for v in np.unique(np.round(q, 3)) if v >= 0.5 and (q >= v).any() and (w_of * t)[q >= v].sum() / w_of[q >= v].sum() >= precision]
        found.append(float(min(good)) if good else 1.1)
        kept, number = (q >= found[-1]) & mine, n_of[mine].sum()
        enough = number >= LEAST
        right = float((n_of * t)[kept].sum())
        judge.measured[KINDS[k]] = (int(number), right / float(n_of[kept].sum()) if enough and kept.any() else None, right / max(1.0, float((n_of * t)[mine].sum())) if enough else None)
    judge.thresholds = tuple(found)
    return judge


def find(text: str | None, judge: Judge) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """``(base finds, all finds)`` of one whole text."""
    text = text or ""
    base = scan(text)
    return base, sorted({*base, *judge.keep(text, untouched(candidates(text), base))})


def report(docs: DataFrame, judge: Judge | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row."""
    judge = judge or train(docs)

    def run(batch) -> dict:
        out: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": []}
        for t in batch.column("text").to_pylist():
            base, every = find(t, judge)
            for i, k in enumerate(KINDS):
                out[f"n_{k}"].append(sum(b[1] == i for b in base))
            out["base_sha256"].append(hashlib.sha256(listed(base, KINDS).encode()).hexdigest())
            out["spans"].append(listed(every, KINDS))
        return {"doc_id": batch.column("doc_id"), **out}

    return per_text(texts(docs), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str | None, judge: Judge) -> str | None:
    """The text with each merged span replaced by its kind in angle brackets."""
    if text is None:
        return None
    every = find(text, judge)[1]
    if not every:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for s, k, e in every:
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(e, merged[-1][2])
        else:
            merged.append([s, k, e])
    for s, k, e in merged:
        out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, judge: Judge | None = None) -> DataFrame:
    """``docs`` with redacted texts; ``n_chars``, where there is one, follows the new text."""
    judge = judge or train(docs)
    names = docs.columns

    def run(batches):
        for batch in slices(batches):
            new = pa.array([redacted(t, judge) for t in batch.column("text").to_pylist()], type=batch.schema.field("text").type)
            columns = [new if n == "text" else batch.column(n) for n in names]
            if "n_chars" in names and pa.types.is_integer(batch.schema.field("n_chars").type):
                i = names.index("n_chars")
                changed = [None if t is None else len(t) for t in new.to_pylist()]
                columns[i] = pa.array([c if c is not None else o for c, o in zip(changed, columns[i].to_pylist(), strict=True)], type=columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
