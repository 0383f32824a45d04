"""Repairs against a search over all edits, and against plain string programming."""

import hashlib
import random
import re
import zlib
from heapq import heappop, heappush

import pytest

pytest.importorskip("weftmill.llm")
from weftmill.llm import conversations  # noqa: E402


def least(turns):
    """Cheapest, then least letters, by a search ordered by (cost, letters) that knows no states, only the wanted pattern."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, letters, i, roles = heappop(heap)
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters
        state = (i, roles[-1:] if len(roles) > 1 or roles != "s" else "S")
        if (state, letters) in done or cost > 3 * len(turns):
            continue
        done.add((state, letters))
        moves = [("I", 2, i, r) for r in "ua"]
        if i < len(turns):
            initial, truncated, goes = turns[i]
            moves.append(("D", 3, i + 1, ""))
            if not goes:
                moves += [("K", truncated, i + 1, initial)] + [("R", 2 + truncated, i + 1, r) for r in "ua"]
        for letter, price, j, r in moves:
            if re.fullmatch("(s?(ua)*u?)?", roles + r) and not (letter == "K" and not r):
                heappush(heap, (cost + price, letters + letter, j, roles + r))


def kind(initial, truncated, goes):
    return max(0, "sua".find(initial)) + (3 if initial not in "sua" else 0) + 4 * truncated + 8 * goes


def test_letters_are_the_cheapest_and_the_least():
    rng = random.Random(4)
    for n in range(6):
        for _ in range(60):
            turns = [(rng.choice("suauaz"), rng.random() < 0.3, rng.random() < 0.2) for _ in range(n)]
            assert conversations.cheapest([kind(*t) for t in turns]) == least(turns), turns


def strings(turns):
    """The same programme with whole strings, for long conversations."""
    layer = {"": (0, "")}
    nxt = lambda q: "a" if q == "u" else "u"
    for initial, truncated, goes in turns:
        new = {}
        for q, (cost, letters) in layer.items():
            for run in range(4):
                steps = [("D", q, 3)]
                if not goes:
                    steps.append(("R", nxt(q), 2 + truncated))
                    if initial == "s" and q == "" or initial == nxt(q):
                        steps.append(("K", "s" if initial == "s" else nxt(q), truncated))
                for letter, to, price in steps:
                    c = (cost + 2 * run + price, letters + "I" * run + letter)
                    new[to] = min(new.get(to, c), c)
                q = nxt(q)
        layer = new
    tail = {"": "", "s": "II", "u": "I", "a": ""}
    return min((c + 2 * len(tail[q]), s + tail[q]) for q, (c, s) in layer.items())


def test_long_conversations_as_with_whole_strings():
    rng = random.Random(5)
    for weights in ("ua", "ss", "uuuuas", "suaz"):
        turns = [(rng.choice(weights), rng.random() < 0.2, rng.random() < 0.3) for _ in range(400)]
        assert conversations.cheapest([kind(*t) for t in turns]) == strings(turns)
    assert conversations.cheapest([kind("s", False, False)] * 300) == strings([("s", False, False)] * 300)
    assert conversations.cheapest([kind("u", False, True)] * 300) == (900, "D" * 300)


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        own = by.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()))
        counts, kinds, seen = [0, 0, 0], [], set()
        for _, role, text in own:
            real = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not real else 1 if (role, text) in seen else 2 if real[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            kinds.append((role[:1], fault == 2, fault in (0, 1)))
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False))
        cost, letters = strings([(k[0] or "-", k[1], k[2]) for k in kinds])
        lines, i, q = [], 0, ""
        for letter in letters:
            role, text = (None, "") if letter == "I" else own[i][1:]
            i += letter != "I"
            if letter in "IR":
                role = "assistant" if q == "u" else "user"
            if letter != "D":
                q = role[0]
                lines.append(f"{role}:{text}")
        out.append((conv, gaps, *counts, illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows):
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, kind int, pass string").repartition(3)
    return sorted((tuple(r) for r in conversations.report(conversations.damage(df)).collect()), key=repr)


def test_report_against_a_loop(spark):
    rng = random.Random(6)
    texts = ["Yes.", "No!", "Well", "", " \t", None, "So?  \n", "Ça ", "a\nb.", "."]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None, "ursa"]), rng.choice(texts)) for c in range(80) for t in rng.sample(range(14), rng.randrange(1, 9))]
    rows += [(None, None, None, None), (None, 3, "user", "x."), (200, None, "user", "a."), (200, None, "user", "b."), (200, 1, "assistant", "c.")]
    rows += [(300, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(900)] + [(301, 0, "user", "long " * 300_000 + "."), (301, 2**62, "assistant", "end."), (301, -(2**62), "system", "s.")]
    rows += [(302, 5, "user", "same.")] * 40
    assert got(spark, rows) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert got(spark, [(gone, 0, "user", "x.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c."), (2, 0, "system", "s.")], "conv_id long, turn long, role string, text string")
    out = conversations.repaired(df.selectExpr("*", "true AS there")).orderBy("conv_id", "turn").collect()
    assert [tuple(r) for r in out] == [(1, 0, "user", "a."), (1, 1, "assistant", ""), (1, 2, "user", "b."), (1, 3, "assistant", "c.")]
