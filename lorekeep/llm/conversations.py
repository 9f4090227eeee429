"""Repairing the turn structure of conversations by the cheapest audit of edits.

Rows of a conversation are read in the order of turn (nulls first), then role and text.  An audit says for every row
whether it is kept, gets another role or is deleted, and where an empty turn is inserted, so that the roles read
``(system)? (user assistant)+`` or nothing is left.  The cheapest audit comes from a dynamic programme over the four
states of that pattern.  Audits are persistent: each is a node that links to the audit it extends, so a state costs
one node a row whatever its length.  Of audits of one cost the ASCII-least wins: nodes carry binary-lifting ancestors and
a rolling hash, the longest common prefix is found by descending through both, and prefixes that agree by their hash
are verified letter by letter (once: verified nodes become one).

A conversation may be of any size.  Rows are dealt by ranges of (conversation, turn, role, text) and read in blocks of
bounded size, so one conversation may span many tasks.  A block is summed up by its 4 x 4 table of cheapest audits
from each state to each state; tables are combined in rounds.  That is exact: the cost of an audit is a function of its
letters and its rows, so no audit is a proper prefix of another of equal cost over the same rows, and the least of two
stays the least whatever follows.  Only the digest of a repaired conversation, which SHA-256 defines over one
stream, reads a conversation's blocks one after another; they are streamed and never held together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.llm.shared import stored

#: A block of one conversation ends after so many rows or characters.
BLOCK_ROWS, BLOCK_CHARS = 4096, 1 << 22
#: Copies of one row that a row of the stream stands for, at most.
COPIES = 1024
#: Blocks whose tables are combined in one group of a round.
FAN_IN = 32
#: Short conversations of one shape are solved once a worker; so many shapes are remembered.
REMEMBERED, SHORT = 50_000, 64

SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a role in a state; other roles are not allowed there.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
PRIME, BASE = (1 << 61) - 1, 1_000_003


class Audits:
    """Strings of edits as linked nodes; node 0 is the empty audit."""

    def __init__(self, prime: int = PRIME) -> None:
        self.prime = prime
        self.letter, self.depth, self.hash = [""], [0], [0]
        self.up: list[list[int]] = [[]]
        self.same: dict[int, int] = {}

    def extend(self, node: int, letter: str) -> int:
        """The audit ``node`` with one more edit."""
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(letter)) % self.prime)
        lifts, k = [node], 0
        while k < len(self.up[lifts[k]]):  # the ancestor 2^(k+1) up is 2^k above the one 2^k up
            lifts.append(self.up[lifts[k]][k])
            k += 1
        self.up.append(lifts)
        return len(self.letter) - 1

    def ancestor(self, node: int, depth: int) -> int:
        """The prefix of ``node`` of that length."""
        above, k = self.depth[node] - depth, 0
        while above:
            if above & 1:
                node = self.up[node][k]
            above, k = above >> 1, k + 1
        return node

    def text(self, node: int) -> str:
        letters = []
        while node:
            letters.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(letters))

    def _root(self, node: int) -> int:
        while node in self.same:
            node = self.same[node]
        return node

    def _verified(self, x: int, y: int) -> bool:
        """Whether two audits of equal length and hash are equal; remembered, so that no letter is compared twice."""
        met = []
        while (x := self._root(x)) != (y := self._root(y)):
            if self.letter[x] != self.letter[y]:
                return False
            met.append((x, y))
            x, y = self.up[x][0], self.up[y][0]
        for a, b in met:
            self.same[max(a, b)] = min(a, b)
        return True

    def less(self, x: int, y: int) -> bool:
        """Whether audit ``x`` comes before ``y``."""
        shorter = min(self.depth[x], self.depth[y])
        a, b = self.ancestor(x, shorter), self.ancestor(y, shorter)
        if self.hash[a] == self.hash[b] and self._verified(a, b):
            return self.depth[x] < self.depth[y]
        if self.hash[a] != self.hash[b]:
            # descend to the shortest prefixes that differ; what stands before them is the longest common prefix
            for k in range(len(self.up[a]) - 1, -1, -1):
                if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                    a, b = self.up[a][k], self.up[b][k]
            if self.letter[a] != self.letter[b] and self._verified(self.up[a][0], self.up[b][0]):
                return self.letter[a] < self.letter[b]
        return self.text(x) < self.text(y)  # a hash has collided

    def least(self, found: list[tuple[int, int, str]]) -> tuple[int, int]:
        """Of (cost, node, edit) the cheapest, extended; of those of one cost the ASCII-least."""
        cost = min(f[0] for f in found)
        tied = [self.extend(node, letter) for c, node, letter in found if c == cost]
        best = tied[0]
        for node in tied[1:]:
            if self.less(node, best):
                best = node
        return cost, best


Best = list["tuple[int, int] | None"]


def inserted(audits: Audits, best: Best) -> Best:
    """``best`` with turns inserted where that is cheaper: one leads to a user, another one on to an assistant."""
    best = list(best)
    for state, role in ((USER, "u"), (ASSISTANT, "a")):
        here = best[state]
        found = [(b[0] + INSERT, b[1], "I") for s, b in enumerate(best) if b and NEXT.get((s, role)) == state]
        if found and (not here or min(f[0] for f in found) <= here[0]):
            made = audits.least(found)
            if not here or made[0] < here[0] or audits.less(made[1], here[1]):
                best[state] = made
    return best


def audited(audits: Audits, codes: str, best: Best) -> Best:
    """The cheapest audits of all rows in each state; ``codes`` has a letter per row (see ``code_of``)."""
    for code in codes:
        best = inserted(audits, best)
        found: list[list[tuple[int, int, str]]] = [[], [], [], []]
        role, extra = code.lower(), TRUNCATED if code.isupper() else 0
        for state, b in enumerate(best):
            if b:
                cost, node = b
                found[state].append((cost + DELETE, node, "D"))
                if role != "d":
                    if (state, role) in NEXT:
                        found[NEXT[state, role]].append((cost + KEEP + extra, node, "K"))
                    for other in "ua":
                        if other != role and (state, other) in NEXT:
                            found[NEXT[state, other]].append((cost + REROLE + extra, node, "R"))
        best = [audits.least(f) if f else None for f in found]
    return best


def code_of(role: str, blank: bool, repeated: bool, cut: bool) -> str:
    """d: must be deleted; else the role's initial (x: no legal one), a capital where the text is truncated."""
    if blank or repeated:
        return "d"
    code = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return code.upper() if cut else code


def cheapest(codes: str) -> tuple[int, str]:
    """The cost and the audit of a whole conversation."""
    audits = Audits()
    best = inserted(audits, audited(audits, codes, [(0, 0), None, None, None]))
    (cost, node), other = best[START], best[ASSISTANT]
    if other and (other[0] < cost or other[0] == cost and audits.less(other[1], node)):
        cost, node = other
    return cost, audits.text(node)


Cell = tuple[int, str]
Table = list["Cell | None"]  # 16 cells: from each state to each state


def table_of(codes: str) -> Table:
    """The cheapest audits of a block from each state to each state."""
    cells: Table = []
    for start in range(4):
        audits = Audits()
        best: Best = [None] * 4
        best[start] = (0, 0)
        cells += [(b[0], audits.text(b[1])) if b else None for b in audited(audits, codes, best)]
    return cells


def joined(one: Table, two: Table) -> Table:
    """The table of two blocks after each other."""
    cells: Table = []
    for start in range(4):
        for end in range(4):
            ways = [(a[0] + b[0], a[1], b[1]) for m in range(4) if (a := one[4 * start + m]) and (b := two[4 * m + end])]
            cost = min((w[0] for w in ways), default=0)
            found = [a + b for c, a, b in ways if c == cost]
            cells.append((cost, min(found)) if found else None)
    return cells


def closed(table: Table) -> Cell:
    """The cheapest audit of a whole conversation by its table, with turns inserted after the last row."""
    tail: Table = [None] * 16
    for s in range(4):
        tail[5 * s] = (0, "")
    tail[4 * START + USER] = tail[4 * SYSTEM + USER] = tail[4 * ASSISTANT + USER] = tail[4 * USER + ASSISTANT] = (INSERT, "I")
    tail[4 * START + ASSISTANT] = tail[4 * SYSTEM + ASSISTANT] = (2 * INSERT, "II")
    done = joined(table, tail)
    return min(c for c in (done[START], done[ASSISTANT]) if c)


class Repaired:
    """Replays an audit over rows and digests the repaired conversation; rows may come block by block."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START
        self.digest, self.turns = hashlib.sha256(), 0

    def _emit(self, role: str, text: str) -> None:
        self.state = NEXT[self.state, role[:1]]
        self.digest.update(f"{chr(10) if self.turns else ''}{role}:{text}".encode())
        self.turns += 1

    def _due(self) -> str:
        return "assistant" if self.state == USER else "user"

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._emit(self._due(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._emit(role if edit == "K" else self._due(), text)

    def end(self) -> str:
        self._inserts()
        return self.digest.hexdigest()


#: Counts of a block or a conversation that add up.
COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
#: What a block tells: initials and turns at its ends, so that neighbouring blocks can be added.
BLOCK = pa.schema(
    [("conv", pa.string()), ("whole", pa.bool_()), ("at", pa.int64())]
    + [(c, pa.int64()) for c in COUNTS]
    + [("first", pa.string()), ("last", pa.string())]
    + [(c, pa.int64()) for c in ("lowest", "highest", "turn_first", "turn_last", "cost")]
    + [(c, pa.string()) for c in ("audit", "sha", "codes")]
    + [("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
)
BLOCK_TYPES = (
    "conv string, whole boolean, at long, " + ", ".join(f"{c} long" for c in COUNTS) + ", first string, last string, "
    "lowest long, highest long, turn_first long, turn_last long, cost long, audit string, sha string, codes string, "
    "roles array<string>, texts array<string>"
)
REPORT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Block:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv: str | None, starts: bool) -> None:
        self.conv, self.starts = conv, starts
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.codes: list[str] = []
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first: str | None = None
        self.last: str | None = None
        self.lowest: int | None = None
        self.highest: int | None = None
        self.turn_first: int | None = None
        self.turn_last: int | None = None
        self.chars = 0

    def row(self, turn: int | None, role: str, text: str, blank: bool, repeated: bool, cut: bool) -> None:
        initial = role[:1]
        if self.first is None:
            self.first, self.turn_first = initial, turn
        elif self.last + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        if turn is not None:
            self.counts["turns"] += turn != self.highest
            self.lowest = turn if self.lowest is None else self.lowest
            self.highest = turn
        self.last, self.turn_last = initial, turn
        if fault := "blank" if blank else "duplicate" if repeated else "truncated" if cut else "":
            self.counts[fault] += 1
        code = code_of(role, blank, repeated, cut)
        if code == "d":  # never said again
            role = text = ""
        self.codes.append(code)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text) + len(role)

    @property
    def full(self) -> bool:
        return len(self.codes) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS

    def told(self, ends: bool, at: int, known: dict[str, Cell]) -> dict:
        """One row: the whole conversation solved, or a block of it with its rows."""
        out = {"conv": self.conv, "whole": self.starts and ends, "at": at, **self.counts}
        out |= {k: getattr(self, k) for k in ("first", "last", "lowest", "highest", "turn_first", "turn_last")}
        codes = "".join(self.codes)
        if not out["whole"]:
            return out | {"codes": codes, "roles": self.roles, "texts": self.texts}
        if codes not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            solved = cheapest(codes)
            if len(codes) <= SHORT:
                known[codes] = solved
        cost, audit = known.get(codes) or solved
        replay = Repaired(audit)
        for role, text in zip(self.roles, self.texts, strict=True):
            replay.row(role, text)
        return out | {"cost": cost, "audit": audit, "sha": replay.end()}


def _batches(rows: Iterator[dict], schema: pa.Schema, many: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    chars = 0
    for row in rows:
        held.append(row)
        chars += sum(map(len, row.get("texts") or ())) + len(row.get("audit") or "")
        if len(held) >= many or chars >= BLOCK_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch], few: int = 512) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, few):
            yield from batch.slice(at, few).to_pylist()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts a task's sorted rows into blocks; conversations at the ends of the task may go on in another one."""

    def cut() -> Iterator[dict]:
        block: Block | None = None
        known: dict[str, Cell] = {}
        made = task = 0
        for row in _rows(batches):
            task = row["task"]
            if block is None or row["conv"] != block.conv or block.full:
                if block is not None:
                    ends = row["conv"] != block.conv
                    yield block.told(ends, (task << 40) + made, known)
                    made += 1
                    block = Block(row["conv"], ends)
                else:
                    block = Block(row["conv"], False)
            for copy in range(row["copies"]):
                repeated = row["seen"] or copy > 0
                block.row(row["turn"], row["role"], row["text"], row["blank"], repeated, row["cut"])
        if block is not None:
            yield block.told(False, (task << 40) + made, known)

    return _batches(cut(), BLOCK)


def _gaps(lowest: int | None, highest: int | None, turns: int) -> int:
    return 0 if lowest is None else highest - lowest + 1 - turns


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its audit (first) and its blocks in order, streamed."""

    def told() -> Iterator[dict]:
        out: dict | None = None
        last: dict | None = None
        replay = Repaired("")

        def done() -> dict:
            gaps = _gaps(out.pop("lowest"), out.pop("highest"), out.pop("turns"))
            return out | {"gaps": gaps, "repaired_sha256": replay.end()}

        for row in _rows(batches, 1):
            if row["at"] < 0:
                if out is not None:
                    yield done()
                replay, last = Repaired(row["audit"]), None
                out = {"conv": row["conv"], "cost": row["cost"], "audit": row["audit"], "lowest": None, "highest": None}
                out |= dict.fromkeys(COUNTS, 0)
                continue
            for c in COUNTS:
                out[c] += row[c]
            if row["first"] is not None:
                if last is not None:
                    out["illegal"] += last["last"] + row["first"] not in ("su", "ua", "au")
                    out["turns"] -= row["turn_first"] is not None and row["turn_first"] == last["turn_last"]
                last = {k: row[k] for k in ("last", "turn_last")}
            if row["lowest"] is not None:
                out["lowest"] = row["lowest"] if out["lowest"] is None else out["lowest"]
                out["highest"] = row["highest"]
            for role, text in zip(row["roles"] or (), row["texts"] or (), strict=True):
                replay.row(role, text)
        if out is not None:
            yield done()

    names = [f.split() for f in REPORT.split(", ")]
    schema = pa.schema([(n, pa.int64() if kind == "long" else pa.string()) for n, kind in names])
    return _batches(told(), schema)


CELLS = "conv string, at long, cells array<struct<cost:long,audit:string>>"
_CELL = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
_CELLS = pa.schema([("conv", pa.string()), ("at", pa.int64()), ("cells", _CELL)])


def _packed(table: Table) -> list:
    return [c and {"cost": c[0], "audit": c[1]} for c in table]


def _unpacked(cells: list) -> Table:
    return [c and (c["cost"], c["audit"]) for c in cells]


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches, 16):
        yield pa.RecordBatch.from_pylist([{"conv": row["conv"], "at": row["at"], "cells": _packed(table_of(row["codes"]))}], _CELLS)


def _combine(group: pa.Table) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: r["at"])
    table = _unpacked(rows[0]["cells"])
    for row in rows[1:]:
        table = joined(table, _unpacked(row["cells"]))
    return pa.Table.from_pylist([{"conv": rows[0]["conv"], "at": rows[0]["at"] // FAN_IN, "cells": _packed(table)}], _CELLS)


def _audits(open_blocks: DataFrame) -> DataFrame:
    """conv, cost, audit of conversations that come in several blocks: tables of blocks are combined in rounds."""
    order = Window.partitionBy("conv").orderBy("at")
    numbers = open_blocks.select("conv", "at").withColumn("number", F.row_number().over(order) - 1)
    most = numbers.agg(F.max("number")).first()[0] or 0
    tables = open_blocks.select("conv", "at", "codes").mapInArrow(_tables, CELLS).alias("t").join(
        numbers.alias("n"), (F.col("t.at") == F.col("n.at")) & F.col("t.conv").eqNullSafe(F.col("n.conv"))
    ).select("t.conv", F.col("number").cast("long").alias("at"), "cells")
    while most > 0:
        combined = tables.groupBy("conv", F.floor(F.col("at") / FAN_IN).alias("group")).applyInArrow(_combine, CELLS)
        tables, most = stored(combined, "conversation-tables"), most // FAN_IN

    schema = pa.schema([("conv", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches, 16):
            cost, audit = closed(_unpacked(row["cells"]))
            yield pa.RecordBatch.from_pylist([{"conv": row["conv"], "cost": cost, "audit": audit}], schema)

    return tables.mapInArrow(close, "conv string, cost long, audit string")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged by crc32(``conv_id:turn``) % 20, a null counting as one space.

    0 drops the row (it stays with no copies, so that its conversation is known), 1 empties its text, 2 removes full
    stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def marked(rows: DataFrame) -> DataFrame:
    """Distinct rows with their faults and number of copies, ``COPIES`` at most in a row of the result."""
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = rows.withColumns(
        {
            "blank": bare == "",
            "cut": ~F.substring(bare, -1, 1).isin(".", "!", "?"),
            "sha": F.when(F.col("n") > 0, F.sha2("text", 256)),
        }
    )
    # the first turn of what stands at several turns; a null turn is the first
    said = rows.where("n > 0").groupBy("conv_id", "role", "sha").agg(F.count("*").alias("times"), F.min(F.struct("turn")).alias("first"))
    said = said.where("times > 1").select(
        F.col("conv_id").alias("of_conv"), F.col("role").alias("of_role"), F.col("sha").alias("of_sha"), "first"
    )
    same = F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("role") == F.col("of_role")) & (F.col("sha") == F.col("of_sha"))
    rows = rows.join(said, same, "left").withColumn(
        "seen", F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    )
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / COPIES)))
    rows = rows.withColumn("part", part)
    copies = F.least(F.col("n") - F.col("part") * COPIES, F.lit(COPIES)).cast("int")
    return rows.select(
        "conv_id", "turn", "role", "text", "blank", "cut", "part", copies.alias("copies"), (F.col("seen") | (F.col("part") > 0)).alias("seen")
    )


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation.

    The table holds conv_id, turn, role and text, and may hold ``copies`` (how often a row stands there, 0: not at all;
    its conversation is reported nevertheless).  Null roles and texts count as one space.  A null conv_id is a
    conversation of its own; rows of one turn are ordered by role, then text, equal rows stand beside each other.
    A role that does not begin with s, u or a, the empty one included, is never kept.  A conversation without rows
    has zeros, an empty audit and the digest of the empty string; an empty table gives an empty result.  Other
    columns are ignored.
    """
    copies = F.coalesce(F.col("copies"), F.lit(0)) if "copies" in rows.columns else F.lit(1)
    rows = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
        copies.cast("long").alias("copies"),
    )
    kind = rows.schema["conv_id"].dataType
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = marked(rows).repartitionByRange(tasks, "conv_id", "turn", "role", F.substring("text", 1, 64))
    dealt = dealt.sortWithinPartitions("conv_id", "turn", "role", "text", "part").select(
        F.col("conv_id").cast("string").alias("conv"), "turn", "role", "text", "blank", "cut", "seen", "copies",
        F.spark_partition_id().alias("task"),
    )
    blocks = stored(dealt.mapInArrow(_blocks, BLOCK_TYPES), "conversation-blocks")
    whole = blocks.where("whole").select(
        "conv",
        F.coalesce(F.col("highest") - F.col("lowest") + 1 - F.col("turns"), F.lit(0)).alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"),
    )
    parts = blocks.where("not whole").drop("cost", "audit")
    audits = _audits(parts).withColumn("at", F.lit(-1).cast("long"))
    stream = parts.unionByName(audits, allowMissingColumns=True).repartition(tasks, "conv").sortWithinPartitions("conv", "at")
    found = whole.unionByName(stream.mapInArrow(_reports, REPORT))
    return found.select(F.col("conv").cast(kind).alias("conv_id"), *(c for c in found.columns if c != "conv"))


def _sql() -> str:
    """The same in DuckDB's SQL: one fold over a conversation's rows, whole audits and texts in its four states."""

    def more(state: str, cost: str, letter: str, line: str) -> str:
        return f"CASE WHEN z.{state} IS NOT NULL THEN {{'c': z.{state}.c + {cost}, 'a': z.{state}.a || {letter}, 'r': z.{state}.r || {line}}} END"

    def least(*found: str) -> str:
        return f"list_min([{', '.join(found)}])"

    def new(role: str, *states: str) -> list[str]:
        return [more(s, "5", "'I'", f"chr(10) || '{role}:'") for s in states]

    def said(role: str, *states: str) -> list[str]:
        same = f"x.k = '{role[0]}'"
        cost, letter = f"x.t + (CASE WHEN {same} THEN 0 ELSE 1 END)", f"(CASE WHEN {same} THEN 'K' ELSE 'R' END)"
        line = f"chr(10) || (CASE WHEN {same} THEN x.role ELSE '{role}' END) || ':' || x.text"
        return [f"CASE WHEN x.k <> 'd' THEN {more(s, cost, letter, line)} END" for s in states]

    gone = [more(s, "2", "'D'", "''") for s in ("s0", "s1", "s2", "s3")]
    system = f"CASE WHEN x.k = 's' THEN {more('s0', 'x.t', chr(39) + 'K' + chr(39), 'chr(10) || x.role || ' + repr(':') + ' || x.text')} END"
    row = f"""{{'s0': {gone[0]}, 's1': {least(gone[1], system)}, 's2': {least(gone[2], *said("user", "s0", "s1", "s3"))},
      's3': {least(gone[3], *said("assistant", "s2"))}}}"""
    kind = "STRUCT(c BIGINT, a VARCHAR, r VARCHAR)"
    return rf"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i::BIGINT) AS v
    FROM range(256) r(i))
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda x: ord(x)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM keyed)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM damaged
), faults AS (
  SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
    right(bare, 1) NOT IN ('.', '!', '?') AS cut,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair
  FROM ordered
), rows AS (
  SELECT *, CASE WHEN blank OR again THEN 'd' WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS k,
    CASE WHEN cut THEN 5 ELSE 0 END AS t
  FROM faults
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list_append(list_append(flatten(list([
      {{'k': '+u', 't': 0, 'role': '', 'text': ''}}, {{'k': '+a', 't': 0, 'role': '', 'text': ''}},
      {{'k': k, 't': t, 'role': role, 'text': text}}] ORDER BY n)),
      {{'k': '+u', 't': 0, 'role': '', 'text': ''}}), {{'k': '+a', 't': 0, 'role': '', 'text': ''}}) AS steps
  FROM rows GROUP BY conv_id
), folded AS (
  SELECT *, list_reduce(steps, lambda z, x: CASE
      WHEN x.k = '+u' THEN {{'s0': z.s0, 's1': z.s1, 's2': {least("z.s2", *new("user", "s0", "s1", "s3"))}, 's3': z.s3}}
      WHEN x.k = '+a' THEN {{'s0': z.s0, 's1': z.s1, 's2': z.s2, 's3': {least("z.s3", *new("assistant", "s2"))}}}
      ELSE {row} END,
    {{'s0': {{'c': 0, 'a': '', 'r': ''}}::{kind}, 's1': NULL::{kind}, 's2': NULL::{kind}, 's3': NULL::{kind}}}) AS z
  FROM told
), best AS (
  SELECT *, {least("z.s0", "z.s3")} AS b FROM folded
)
SELECT conv AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit,
  sha256(coalesce(substr(b.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id AS conv FROM conversations) LEFT JOIN best ON conv IS NOT DISTINCT FROM conv_id
"""


OP11_SQL = _sql()
