"""Repair of conversation structure: the cheapest edits that make the roles of a conversation legal, by an auction.

The lattice has a node for each row boundary and state of the turn order; arcs keep, re-role or delete a row or insert
an empty one, at integer costs. An auction finds the shortest path: every node has a price, a path from the origin is
extended over the cheapest arc or contracted while its last node's price rises. The rows are taken in blocks from the
last to the first, so prices start at those already known. Converged prices expose the arcs that can lie on a
cheapest path, the tight ones, and the least letters are traced over these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.llm.common import quoted, written

#: Costs of the edits, and what a truncated row adds that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing said, a system turn, a user turn, an assistant turn last. The roles are s?(ua)+ or nothing.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that comes next in a state, if it is one of the two that can be inserted.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Rows of a block of the lattice.
BLOCK = 16
#: A row's flags in ``Lattice``.
OTHER, MUST_GO, CUT_OFF = 0, 4, 8
#: ASCII white space, and characters that end a sentence.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"


def _arcs(flags: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, nodes ahead) of a row with ``flags`` in ``state``, in order of letters."""
    out, more = [("D", DELETE, 4)], TRUNCATED if flags & CUT_OFF else 0
    out.append(("I", INSERT, NEXT[state] - state))
    if not flags & MUST_GO:
        role = flags & 3
        if role == NEXT[state] or role == SYSTEM and state == START:
            out.append(("K", more, 4 + role - state))
        out.append(("R", REROLE + more, 4 + NEXT[state] - state))
    return out


#: Arcs by flags and state; after the last row only insertions and, where the roles are whole, the end (one node for all).
ARCS = [[_arcs(flags, state) for state in range(4)] for flags in range(16)]
CLOSING = [[("I", INSERT, NEXT[state] - state)] + ([("", 0, 4 - state)] if state in (START, ASSISTANT) else []) for state in range(4)]


class Lattice:
    """The rows of one conversation as a byte of flags each; node 4 * i + state is before row i."""

    def __init__(self, flags: bytes):
        self.flags = flags
        self.sink = 4 * len(flags) + 4
        self.price = [0] * (self.sink + 1)

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        i, state = node >> 2, node & 3
        return ARCS[self.flags[i]][state] if i < len(self.flags) else CLOSING[state]

    def auction(self, origin: int, known: int) -> None:
        """Raises prices, never above the cost of an arc and the price behind it, until a path of tight arcs leads from
        ``origin`` to a node from ``known`` on, whose prices are exact: the origin's is then exact too.
        """
        price, path = self.price, [origin]
        while (node := path[-1]) < known:
            best, ahead = min((cost + price[node + step], step) for _, cost, step in self.arcs(node))
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(node + ahead)

    def solve(self) -> int:
        """The least cost; afterwards no price is above an arc's cost and the price behind it."""
        n, price = len(self.flags), self.price
        for state in range(4):
            self.auction(4 * n + state, self.sink)
        for end in range(n, 0, -BLOCK):
            begin = max(0, end - BLOCK)
            base = min(price[4 * end : 4 * end + 4])
            price[4 * begin : 4 * end] = [base] * (4 * (end - begin))
            for state in range(4) if begin else (START,):
                self.auction(4 * begin + state, 4 * end)
        return price[START]

    def trace(self) -> str:
        """The least letters over tight arcs from the start to the end; nodes that lead nowhere are met once."""
        price, path, letters, dead = self.price, [START], [], set()
        tried = [0]
        while path[-1] != self.sink:
            node, arcs = path[-1], self.arcs(path[-1])
            for k in range(tried[-1], len(arcs)):
                letter, cost, step = arcs[k]
                if price[node] == cost + price[node + step] and node + step not in dead:
                    tried[-1] = k + 1
                    path.append(node + step)
                    letters.append(letter)
                    tried.append(0)
                    break
            else:
                dead.add(path.pop())
                letters.pop()
                tried.pop()
        return "".join(letters)


def repair_edits(flags: bytes) -> tuple[int, str]:
    """The least cost of legal roles, and the ASCII-least letters of that cost (D, I, K, R)."""
    lattice = Lattice(flags)
    return lattice.solve(), lattice.trace()


def repaired_roles(audit: str, roles: Iterator[str]) -> Iterator[tuple[str, bool]]:
    """(role, whether it is a row's) of every repaired turn, one row's role drawn for each letter but I."""
    state = START
    for letter in audit:
        role = next(roles) if letter != "I" else None
        if letter == "D":
            continue
        state = INITIALS[role[0]] if letter == "K" else NEXT[state]
        yield (role if letter == "K" else ROLE_OF[state]), letter != "I"


def _or_space(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with faults put in by crc32 of ``conv_id:turn``, modulo 20.

    0 drops the row, 1 empties its text, 2 takes every ``.``, ``!`` and ``?`` from it, 3 repeats the row, 4 makes its
    role user. Nulls are one space. Rows get ``at``, their place among those of one turn: by role and hash
    of the text before the damage, then the copy's number.
    """
    role, text = _or_space(quoted("role")), _or_space(quoted("text"))
    kind = F.crc32(F.concat(_or_space(quoted("conv_id")), F.lit(":"), _or_space(quoted("turn"))).cast("binary")) % 20
    rows = turns.select(F.col("conv_id").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("_kind")).where("_kind <> 0")
    rows = rows.withColumn("_copy", F.explode(F.expr("if(_kind = 3, array(0, 1), array(0))")))
    return rows.select(
        "conv_id", "turn", F.expr("if(_kind = 4, 'user', role)").alias("role"),
        F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.struct(F.col("role"), F.xxhash64("text").alias("hash"), F.col("_copy").alias("copy")).alias("at"),
    )


def _flags() -> Column:
    """0 for other roles, 1 to 3 for s, u and a; 4 more for a blank text, 8 more for one that ends without a mark."""
    initial = F.instr(F.lit("sua"), F.when(F.col("role") == "", F.lit("-")).otherwise(F.substring("role", 1, 1)))
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(bare == "", F.lit(MUST_GO)).when(~F.substring(bare, -1, 1).isin(*ENDS), F.lit(CUT_OFF)).otherwise(F.lit(0))
    return (initial + fault).cast("int")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, rows) over batches whose first column is a sorted conv_id."""
    rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
    return groupby(rows, key=lambda r: r[0])


FACTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_NAMES, _KINDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"], [pa.int64()] * 6 + [pa.string()]
#: Conversations of an output batch.
_BATCH = 4096


def _out(kind: pa.DataType, held: list, names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*held))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *kinds])], ["conv_id", *names])


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = next(batches, None)
    if first is None:
        return
    kind, held = first.schema.field(0).type, []
    for conv, rows in _conversations(chain([first], batches)):
        seen, flags, counts = set(), bytearray(), [0, 0, 0]
        low = high = before = None
        distinct = illegal = 0
        last = object()
        for _, turn, initial, flag, key in rows:
            if turn is not None:
                low, high, distinct, last = (turn if low is None else low), turn, distinct + (turn != last), turn
            again = key in seen
            seen.add(key)
            if again and not flag & MUST_GO:
                flag = flag & 3 | MUST_GO
                counts[1] += 1
            else:
                counts[0] += flag & MUST_GO > 0
                counts[2] += flag & CUT_OFF > 0
            flags.append(flag)
            if before is not None:
                illegal += before + initial not in ("su", "ua", "au")
            before = initial
        cost, audit = repair_edits(bytes(flags))
        gaps = 0 if low is None else high - low + 1 - distinct
        held.append((conv, gaps, *counts, illegal, cost, audit))
        if len(held) >= _BATCH:
            yield _out(kind, held, _NAMES, _KINDS)
            held = []
    if held:
        yield _out(kind, held, _NAMES, _KINDS)


def conversation_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of rows (conv_id, turn, role, text, at).

    Rows are in order of turn (null first) and ``at``. A row's first fault counts: blank (white space only), duplicate
    (its role and text were seen before in the conversation), truncated (its last character but for white space is none of
    ``.!?``). Gaps are missing turn numbers, illegal counts neighbours whose role initials are none of su, ua and au. The
    edits are the cheapest that leave roles with initials ``s?(ua)+`` or nothing: keep 0 (K), re-role to user or
    assistant 3 (R), delete 4 (D, the only one for blanks and duplicates), insert an empty user or assistant turn 3 (I);
    a truncated row that stays costs 3 more. Of equally cheap ones audit has the ASCII-least letters.

    Texts are judged where they are read; a few bytes a row are shuffled. A task streams over its rows; of a conversation it
    holds one digest, one byte of flags and four prices a row. Null role and text must be replaced before; rows of
    a null conv_id are one conversation, repeated rows are duplicates, an empty table gives no rows.
    """
    key = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))
    narrow = rows.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), _flags().alias("flags"), key.alias("key"), "at")
    dealt = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "at").select("conv_id", F.col("turn").cast("bigint"), "initial", "flags", "key")
    return dealt.mapInArrow(_facts, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {FACTS}")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The facts of each conversation (its first row) with the digest of what its rows behind them become."""
    first = next(batches, None)
    if first is None:
        return
    kind, held = first.schema.field(0).type, []
    names, kinds = [*_NAMES, "repaired_sha256"], [*_KINDS, pa.string()]
    for conv, rows in _conversations(chain([first], batches)):
        facts = next(rows)[3]
        digest, text, lead = hashlib.sha256(), [""], ""

        def roles(rows=rows, text=text) -> Iterator[str]:
            for _, role, text[0], _ in rows:
                yield role

        for role, own in repaired_roles(facts["audit"], roles()):
            digest.update(f"{lead}{role}:{text[0] if own else ''}".encode())
            lead = "\n"
        held.append((conv, *(facts[k] for k in _NAMES), digest.hexdigest()))
        if len(held) >= _BATCH:
            yield _out(kind, held, names, kinds)
            held = []
    if held:
        yield _out(kind, held, names, kinds)


def with_digests(faults: DataFrame, rows: DataFrame) -> DataFrame:
    """``faults`` with repaired_sha256, the SHA-256 of the repaired turns ``role:text`` joined by newlines.

    A task streams over the texts of ``rows`` behind their conversation's audit.
    """
    audits = faults.select(
        "conv_id", F.lit(0).alias("_part"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "at", "role", "text")), F.struct(*_NAMES).alias("facts")
    )
    turns = rows.select("conv_id", F.lit(1).alias("_part"), "turn", "at", "role", "text", F.lit(None).cast(audits.schema["facts"].dataType).alias("facts"))
    dealt = audits.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "_part", "turn", "at").select("conv_id", "role", "text", "facts")
    return dealt.mapInArrow(_digests, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {FACTS}, repaired_sha256 string")


def repair_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """``conversation_faults`` of ``rows`` and the digest of their repair, for every conv_id of ``conversations``.

    Conversations without rows have zeros, an empty audit and the digest of nothing; a null conv_id is one of them.
    """
    told = with_digests(written(conversation_faults(rows)), rows).withColumnRenamed("conv_id", "_conv")
    every = conversations.select("conv_id").distinct()
    both = every.join(told, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return both.na.fill({**dict.fromkeys(_NAMES[:-1], 0), "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})
