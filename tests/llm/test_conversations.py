"""Repair of conversations and the prefix trie against brute force, and both against their SQL."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from listingloom.llm import repair, trie

WHITE = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
SHAPE = "conv_id bigint, turn bigint, role string, text string, at string, initial string, path string, keys string"


def cheapest(kinds):
    """(cost, letters) of rows (initial, must go, truncated): dynamic programming over suffixes."""

    def inserted(d):
        d = dict(d)
        for _ in range(4):
            for s in NEXT:
                d[s] = min(d[s], (d[NEXT[s]][0] + 3, "I" + d[NEXT[s]][1]))
        return d

    after = inserted({s: (0, "") if s in ("", "a") else (10**9, "") for s in NEXT})
    for initial, must_go, cut in reversed(kinds):
        now = {}
        for s in NEXT:
            ways = [(after[s][0] + 4, "D" + after[s][1])]
            if not must_go:
                if initial == NEXT[s] or initial == "s" and s == "":
                    ways.append((after[initial][0] + 3 * cut, "K" + after[initial][1]))
                ways.append((after[NEXT[s]][0] + 3 + 3 * cut, "R" + after[NEXT[s]][1]))
            now[s] = min(ways)
        after = inserted(now)
    return after[""]


def flags_of(kinds):
    return bytes((" sua".find(i) if i in "sua" and i else 0) + 4 * m + 8 * c for i, m, c in kinds)


def some_kinds(rng, n):
    kinds = [(rng.choice("suauax"), rng.random() < 0.15, rng.random() < 0.25) for _ in range(n)]
    return [(i, m, c and not m) for i, m, c in kinds]


def test_auction_equals_dynamic_programming():
    rng = random.Random(5)
    for _ in range(1500):
        kinds = some_kinds(rng, rng.choice([0, 1, 2, 3, 5, 8, 17, 40]))
        assert repair.repair_edits(flags_of(kinds)) == cheapest(kinds), kinds


def test_converged_prices_are_dual_and_exact():
    """No price is above an arc's cost and the price behind it, and the origin's is the least cost."""
    rng = random.Random(6)
    for _ in range(100):
        kinds = some_kinds(rng, 50)
        lattice = repair.Lattice(flags_of(kinds))
        assert lattice.solve() == lattice.price[0] == cheapest(kinds)[0]
        for node in range(lattice.sink):
            assert all(lattice.price[node] <= cost + lattice.price[node + step] for _, cost, step in lattice.arcs(node))


def test_a_long_conversation_takes_linear_time():
    rng = random.Random(7)
    cost, audit = repair.repair_edits(flags_of(some_kinds(rng, 30_000)))
    assert cost > 0 and sum(letter != "I" for letter in audit) == 30_000


def report(rows):
    convs = {}
    for c, t, r, x, *_ in rows:
        convs.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    out = []
    for c, turns in convs.items():
        kept = []
        for t, r, x in sorted(turns, key=lambda y: (y[0] is not None, y[0] or 0, y[1])):
            fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            x = "" if fault == 1 else x.translate(dict.fromkeys(map(ord, ".!?"))) if fault == 2 else x
            kept += [(t, "user" if fault == 4 else r, x)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        seen, kinds, counts = set(), [], [0, 0, 0]
        for _, r, x in kept:
            blank, again = not x.strip(WHITE), (r, x) in seen
            cut = not blank and x.rstrip(WHITE)[-1] not in ".!?"
            seen.add((r, x))
            for k, hit in enumerate((blank, again, cut)):
                if hit:
                    counts[k] += 1
                    break
            kinds.append((r[:1], blank or again, cut and not again))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        numbers = [t for t, _, _ in kept if t is not None]
        cost, audit = cheapest(kinds)
        state, left, said = "", iter(kept), []
        for letter in audit:
            row = next(left) if letter != "I" else None
            if letter != "D":
                state = row[1][0] if letter == "K" else NEXT[state]
                said.append((row[1] if letter == "K" else {"u": "user", "a": "assistant"}[state]) + ":" + (row[2] if row else ""))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out.append((c, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return out


def odd_turns(seed=3, convs=60):
    """Rows with nulls, blanks, repeats, long texts, odd roles, gaps and a null conversation, and columns with clashing names."""
    rng = random.Random(seed)
    out = []
    for c in [None, *range(-3, convs), 100, 101, 200, 230, 305, 10**12]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 5, 6, 8])):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "unknown", None, ""])
            text = rng.choice([None, "", " \n", "Hello.", "Hello", "why?\n", "Ünï 漢字!", f"text {rng.randrange(4)}.", "x" * 3000 + "."])
            out.append((c, None if rng.random() < 0.05 and t == 0 else 2 * t if rng.random() < 0.1 else 2 * t + 1, role, text, "a", "b", "c", "d"))
    gone = next(c for c in range(2000, 3000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    return out + [(7, 50, "user", "Same.", "a", "b", "c", "d")] * 2 + [(gone, 1, "user", "Dropped.", "a", "b", "c", "d")]


def test_repair_report_equals_brute_force(spark):
    rows = odd_turns()
    turns = spark.createDataFrame(rows, SHAPE)
    got = [tuple(r) for r in repair.repair_report(turns, repair.damaged(turns)).collect()]
    assert sorted(got, key=str) == sorted(report(rows), key=str)
    assert any(r[7] == "" for r in got) and any(r[0] is None for r in got)


def test_repair_of_an_empty_table(spark):
    turns = spark.createDataFrame([], SHAPE)
    assert repair.repair_report(turns, repair.damaged(turns)).count() == 0


def nodes_of(rows):
    convs = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            key = hashlib.sha256(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest()
            convs.setdefault(c, []).append(((t is not None, t or 0, r or "", key), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in own.items():
        h, head = zlib.crc32(str(c).encode()) % 6, int(c / 100) * 100
        built[c] = own.get(head, [])[:h] + v[h:]
    members, kids = {}, {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        below = kids.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in below)
    ends = {k: ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))) for k, m in members.items()}
    return [
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest())
        for k, m in members.items()
    ]


@pytest.mark.parametrize("shard", [1, 7, 64, trie.SHARD])
def test_trie_equals_brute_force(spark, shard):
    """Shards of a conversation or a few: spines of many shards meet at every depth."""
    rows = odd_turns(4) + [(1000 + c, t, "user", f"{t}!", *"abcd") for c in range(40) for t in range(c % 5)]
    got = trie.prefix_trie(trie.graft(trie.conversation_paths(spark.createDataFrame(rows, SHAPE))), shard)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(nodes_of(rows), key=str)


def test_one_path_over_many_shards(spark):
    """Two thirds of all conversations are the same: its ids are hashed from the parts of many shards."""
    rows = [(c, t, "user", "hi" if c % 3 else f"{c}") for c in range(900) for t in range(3)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {(r["conv_id"], r["depth"]): r for r in trie.prefix_trie(trie.conversation_paths(turns), 50).collect()}
    top, same = got[0, 0], got[1, 3]
    assert (top["n_convs"], top["n_children"], top["n_leaves"], same["n_convs"]) == (900, 301, 301, 600)
    assert same["ends_sha256"] == hashlib.sha256(",".join(str(c) for c in range(900) if c % 3).encode()).hexdigest()
    assert top["saved_tokens"] == 3 * 599 * 2


def test_trie_of_an_empty_table(spark):
    assert trie.prefix_trie(trie.graft(trie.conversation_paths(spark.createDataFrame([], SHAPE)))).count() == 0


def test_find_close_on_deep_and_wide_sequences():
    rng = random.Random(9)
    for n in (1, 2, 70, 3000):
        for deep in (0.3, 0.5, 0.95):
            bits, depth, left = [1], 1, n - 1
            while depth:
                if left and (depth == 1 or rng.random() < deep):
                    bits.append(1)
                    depth, left = depth + 1, left - 1
                elif depth > 1 or not left:
                    bits.append(0)
                    depth -= 1
            stack, want = [], {}
            for i, b in enumerate(bits):
                if b:
                    stack.append(i)
                else:
                    want[stack.pop()] = i
            opens = np.flatnonzero(np.array(bits))
            pairs = trie.Parentheses(np.array(bits, np.uint8))
            assert pairs.find_close(opens).tolist() == [want[i] for i in opens.tolist()]
            assert pairs.leaf_rank(np.array([len(bits)]))[0] == sum(a == 1 and b == 0 for a, b in zip(bits, bits[1:]))
