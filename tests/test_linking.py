"""Children merged in order: the set operator equals a merge child by child."""

import random

from listingloom.operators import linking

FIELDS = ["price", "district", "phones", "tag"]
SHAPE = "announcement_id bigint, parent_id bigint, source_id string, price double, district string, phones array<string>, tag string"
EMPTY = (None, "", [])


def folded(rows, links):
    """One link after the other, as a service does it."""
    by_id = {r[0]: list(r) for r in rows}
    audit, touched, done = {}, {}, set()
    for child, parent, _ in sorted(links, key=lambda x: x[2]):
        if child in done:
            continue
        done.add(child)
        if parent not in by_id or by_id[child][1] == parent:
            continue
        p, c = by_id[parent], by_id[child]
        told = []
        for k, f in enumerate(FIELDS, 3):
            if p[k] in EMPTY and c[k] not in EMPTY:
                p[k] = c[k]
            elif p[k] not in EMPTY and c[k] not in EMPTY and p[k] != c[k]:
                told.append(f)
        c[1], audit[child], touched[parent] = parent, (parent, told), c[2]
    parents = {p: (*by_id[p][3:], 1 + sum(r[1] == p for r in by_id.values()), last) for p, last in touched.items()}
    return parents, audit


def test_children_in_order(spark):
    rng = random.Random(8)
    rows, links = [], []
    for i in range(300):
        rows.append((
            i, rng.choice([None, None, None, i % 10]) if i >= 10 else None, f"s{rng.randrange(5)}", rng.choice([None, 1.0, 2.0]), rng.choice([None, "", "a", "b"]),
            rng.choice([None, [], ["1"], ["1", "2"]]), rng.choice([None, "", "t"]),
        ))
        if i >= 10:
            links += [(i, rng.choice([i % 10, 10**6]) if rng.random() < 0.9 else i % 10, rng.randrange(10**6))]
    links += [(i, (i + 1) % 10, 2 * 10**6) for i in range(10, 40)]  # a second link of a child counts for nothing
    got = linking.link_children(spark.createDataFrame(rows, SHAPE), spark.createDataFrame(links, "child_id bigint, parent_id bigint, seq bigint"), FIELDS)
    parents, audit = folded(rows, links)
    assert {r["announcement_id"]: tuple(r)[1:] for r in got.parents.collect()} == parents
    assert {r["child_id"]: (r["parent_id"], [c["field"] for c in r["conflicts"]]) for r in got.audit.collect()} == audit
    assert {(r["announcement_id"], r["parent_id"]) for r in got.children.collect()} == {(c, p) for c, (p, _) in audit.items()}
    assert max(sum(p == q for q, _ in audit.values()) for p in parents) >= 10


def test_conflicts_name_both_values(spark):
    rows = [(1, None, "a", None, "x", None, ""), (2, None, "b", 5.0, "y", [], None), (3, None, "c", 6.0, "x", ["9"], "t")]
    links = [(2, 1, 1), (3, 1, 2)]
    got = linking.link_children(spark.createDataFrame(rows, SHAPE), spark.createDataFrame(links, "child_id bigint, parent_id bigint, seq bigint"), FIELDS)
    told = {r["child_id"]: [tuple(c) for c in r["conflicts"]] for r in got.audit.collect()}
    assert told == {2: [("district", "x", "y")], 3: [("price", "5.0", "6.0")]}
    assert tuple(got.parents.first())[1:] == (5.0, "x", ["9"], "t", 3, "c")


def test_no_links(spark):
    got = linking.link_children(spark.createDataFrame([(1, None, "a", None, None, None, None)], SHAPE), spark.createDataFrame([], "child_id bigint, parent_id bigint, seq bigint"), FIELDS)
    assert got.parents.count() == got.children.count() == got.audit.count() == 0
