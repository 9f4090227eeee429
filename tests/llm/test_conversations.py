"""Structure repair of conversations: audits against exhaustive search, whole tables against a plain programme."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lorekeep.llm import conversations
from lorekeep.llm.conversations import Audits

FORM = re.compile(r"(s?(ua)+)?\Z")
LETTERS = "suaxSUAXdua"


def every_audit(codes, inserts=3):
    """The best (cost, audit) of all edits with a few inserts, by trying all."""
    best = [(10**9, "")]

    def go(n, audit, cost, roles, left):
        if cost > best[0][0]:
            return
        if n == len(codes):
            if FORM.match(roles):
                best[0] = min(best[0], (cost, audit))
        if left:
            for role in "ua":
                go(n, audit + "I", cost + 5, roles + role, left - 1)
        if n < len(codes):
            extra, role = 5 * codes[n].isupper(), codes[n].lower()
            go(n + 1, audit + "D", cost + 2, roles, left)
            if role != "d":
                go(n + 1, audit + "K", cost + extra, roles + role, left)
                for other in "ua":
                    go(n + 1, audit + "R", cost + 1 + extra, roles + other, left)

    go(0, "", 0, "", inserts)
    return best[0]


def test_cheapest_audit_and_tables_of_blocks():
    r = random.Random(4)
    for _ in range(250):
        codes = "".join(r.choice(LETTERS) for _ in range(r.randint(0, 5)))
        want = every_audit(codes)
        assert conversations.cheapest(codes) == want, codes
        cuts = sorted(r.randint(0, len(codes)) for _ in range(2))
        table = conversations.table_of(codes[: cuts[0]])
        for part in (codes[cuts[0] : cuts[1]], codes[cuts[1] :]):
            table = conversations.joined(table, conversations.table_of(part))
        assert conversations.closed(table) == want, (codes, cuts)


@pytest.mark.parametrize("prime", [1, 2, 7])
def test_hashes_that_collide_are_verified(prime):
    r = random.Random(prime)
    for _ in range(200):
        audits, texts = Audits(prime), {0: ""}
        for _ in range(40):
            parent = r.choice(list(texts))
            letter = r.choice("DKR")
            texts[audits.extend(parent, letter)] = texts[parent] + letter
        for _ in range(60):
            x, y = r.choice(list(texts)), r.choice(list(texts))
            assert audits.less(x, y) == (texts[x] < texts[y])
            assert audits.text(audits.ancestor(x, len(texts[x]) // 2)) == texts[x][: len(texts[x]) // 2]


def plain(rows):
    """conv_id -> the whole report, one conversation after another."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        held[conv] += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, found in held.items():
        found.sort()
        codes, faults, seen, turns = "", [], set(), {t for known, t, _, _ in found if known}
        for _, _, role, text in found:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            code = role[:1] if role[:1] and role[:1] in "sua" else "x"
            codes += "d" if fault in ("blank", "duplicate") else code.upper() if fault else code
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(found, found[1:])]
        cost, audit = conversations.cheapest(codes)
        said, state, n = [], "", 0
        for edit in audit:
            due = "assistant" if state == "u" else "user"
            if edit == "I":
                said.append(f"{due}:")
                state = due[0]
                continue
            role, text = found[n][2:]
            n += 1
            if edit != "D":
                role = role if edit == "K" else due
                said.append(f"{role}:{text}")
                state = role[0]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def talk(seed=2):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "", "  ", "cut", "été. \n", "a\n\n.", "x" * 5000 + ".", None]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "u", "a"]
    rows = []
    for conv in [None, *range(40), -7]:
        for turn in range(r.choice([1, 2, 5, 9])):
            rows.append((conv, r.choice([turn, turn, turn * 3, None]), roles[r.randrange(10)] if r.random() < 0.4 else ("user", "assistant")[turn % 2], f"{r.choice(texts) or ''}" if r.random() < 0.5 else f"t{turn}."))
    rows += rows[:30] + [(99, t, "user", "again") for t in range(300)] + [(99, 5, "user", "again")] * 40 + [(98, None, None, None)]
    rows += [(97, t, ("user", "assistant")[t % 2], f"turn {t}{'.' * (t % 3)}") for t in range(500)]
    return rows


@pytest.mark.parametrize("block", [4096, 7])
def test_damage_and_repair(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK_ROWS", block)
    monkeypatch.setattr(conversations, "FAN_IN", 4)
    rows = talk()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = frame.withColumns({n: F.lit(1) for n in ("n", "sha", "conv", "seen", "part", "kind", "copies")})
    got = conversations.repair(conversations.damage(frame)).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert {r.conv_id: tuple(r[n] for n in names) for r in got} == plain(rows)
    assert len(got) == len({r[0] for r in rows})


def test_many_copies_and_no_rows(spark):
    schema = "conv_id string, turn long, role string, text string, copies long"
    frame = spark.createDataFrame([("a", 1, "user", "Hi.", 5000), ("a", 2, "assistant", "Yes.", 1), ("b", 1, "user", "x", 0)], schema)
    got = {r.conv_id: r for r in conversations.repair(frame).collect()}
    assert got["a"].audit == "K" + "D" * 4999 + "K" and got["a"].cost == 2 * 4999 and got["a"].duplicate == 4999
    assert (got["b"].audit, got["b"].cost, got["b"].repaired_sha256) == ("", 0, hashlib.sha256(b"").hexdigest())
    assert conversations.repair(frame.limit(0)).collect() == []
    assert conversations.repair(conversations.damage(frame.drop("copies").limit(0))).collect() == []
