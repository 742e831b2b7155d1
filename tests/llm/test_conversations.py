"""Conversation repair against a plain version, and that against every sequence of edits of short conversations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from orrery.llm import catalog, conversations

SF = "/root/testdata/sf0.001"
WS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost string, piece int"


def play(audit, rows):
    """Repaired (role, text) by an audit, or None if its roles are not those of the grammar."""
    out, rest = [], list(rows)
    for letter in audit:
        if letter == "I":
            out.append(("user" if not out or out[-1][0][:1] in "sa" and out[-1][0] else "assistant", ""))
            continue
        role, text, _ = rest.pop(0)
        if letter == "K":
            out.append((role, text))
        elif letter == "R":
            out.append(("assistant" if out and out[-1][0][:1] == "u" else "user", text))
    return out if not rest and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) else None


def price(audit, rows):
    faults = iter(r[2] for r in rows)
    total = 0
    for letter in audit:
        if letter == "I":
            total += 5
            continue
        fault = next(faults)
        if letter != "D" and fault in ("blank", "duplicate"):
            return None
        total += {"K": 0, "R": 1, "D": 2}[letter] + (5 if letter != "D" and fault == "truncated" else 0)
    return total


def every(rows):
    """The best (cost, audit) of all edits with at most two inserts at each place."""
    best = None
    for letters in itertools.product("DKR", repeat=len(rows)):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * g + x for g, x in zip(gaps, [*letters, ""], strict=True))
            cost = price(audit, rows)
            if cost is not None and (best is None or (cost, audit) < best) and play(audit, rows) is not None:
                best = (cost, audit)
    return best


def plain_best(rows):
    """Least (cost, audit) by carrying whole strings."""
    after = lambda q, c: {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[q].get(c)
    forced = lambda q: "a" if q == "u" else "u"

    def closed(now):
        for _ in range(4):
            for q, (c, a) in list(now.items()):
                now[forced(q)] = min(now.get(forced(q), (c + 5, a + "I")), (c + 5, a + "I"))
        return now

    now = {"": (0, "")}
    for role, _, fault in rows:
        new = defaultdict(list)
        for q, (c, a) in closed(now).items():
            new[q].append((c + 2, a + "D"))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                new[forced(q)].append((c + 1 + more, a + "R"))
                if after(q, role[:1]):
                    new[after(q, role[:1])].append((c + more, a + "K"))
        now = {q: min(v) for q, v in new.items()}
    now = closed(now)
    return min(now[q] for q in ("", "a") if q in now)


def plain(table):
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        own = groups[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        c = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text
        own.extend([(turn, "user" if c == 4 else role, text)] * (0 if c == 0 else 2 if c == 3 else 1))
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        rows, seen, count = [], set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            end = text.rstrip(WS)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            rows.append((role, text, fault))
            if fault:
                count[fault] += 1
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit = plain_best(rows)
        repaired = "\n".join(f"{r}:{t}" for r, t in play(audit, rows))
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest())
    return out


def got(df):
    rows = df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_plain_version_against_all_edits():
    rng = random.Random(4)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), "x", rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 4))]
        assert plain_best(rows) == every(rows)


def test_repairs_and_pieces_against_the_plain_version():
    rng = random.Random(5)
    codes = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
    for n in [*range(12), 40, 1500]:
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), f"t{i}", rng.choice(["", "", "", "blank", "truncated"])) for i in range(n)]
        r = conversations.Repair()
        for role, text, fault in rows:
            r.turn(role, text, codes[fault])
        cost, audit, digest = r.best()
        assert (cost, audit) == plain_best(rows)
        assert digest == hashlib.sha256("\n".join(f"{a}:{t}" for a, t in play(audit, rows)).encode()).hexdigest()
        cuts = sorted(rng.choices(range(n + 1), k=3))
        pieces = []
        for a, b in zip([0, *cuts], [*cuts, n], strict=True):
            own = {e: conversations.Repair(e) for e in range(4)}
            for role, text, fault in rows[a:b]:
                for e in own.values():
                    e.turn(role, text, codes[fault])
            pieces.append([{"entry": e, "exit": x, "cost": c, "audit": s} for e, p in own.items() for x, (c, s) in p.paths().items()])
        assert conversations.composed(pieces) == (cost, audit)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(catalog.QUERIES["op11_conversation_repair"](spark, SF)) == plain(rows)


def test_odd_and_split_conversations(spark):
    rng = random.Random(6)
    roles = ["user", "assistant", "system", "", None, "tool", "ux"]
    texts = ["a.", "b!", "c?", "d", "", None, " \t\n", ".", "e. ", "x" * 40_000 + ".", "é。", "same."]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for c in [*range(60), None] for _ in range(rng.randint(1, 9))]
    rows += [(1000, t, rng.choice(roles[:3]), rng.choice(texts[:4]) + f"{t % 97}.") for t in range(3000)]  # most rows: over all tasks
    rows += [(1001, t, "user", "same.") for t in range(400)]  # one text
    rows += [(1002, 5, "user", "same.")] * 300  # one row
    rows += [(c, 0, "user", "x.") for c in range(2000, 2060)]  # some are dropped
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    want = plain(rows)
    have = got(conversations.repair(conversations.damaged(df)))
    assert have == want
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want.values()
    assert spark.createDataFrame([], SCHEMA).transform(conversations.damaged).transform(conversations.repair).count() == 0


def test_a_long_conversation_is_dealt_over_tasks(spark):
    df = spark.createDataFrame([(1, t, "user" if t % 2 else "assistant", f"{t}.", "", 0) for t in range(4000)], SCHEMA)
    rows = conversations.faulty(conversations.damaged(df))
    pieces = rows.repartitionByRange(4, *conversations.ORDER).sortWithinPartitions(*conversations.ORDER).mapInArrow(conversations.pieces_of, conversations.PIECE.format(kind="bigint"))
    sizes = [r.n for r in pieces.select("n").collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
    assert conversations.repair(conversations.damaged(df)).where(F.length("repaired_sha256") == 64).count() == 1
