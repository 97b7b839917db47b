"""Decisions one by one: the rounds of the batch operator and the stateful stream equal a plain fold."""

import random

import pytest

from listingloom.functions.text import normalised_text
from listingloom.operators import prededup
from listingloom.streaming import history

SHAPE = "scope string, post_id bigint, text string, forward_key string, parent_ref bigint, phash string"


def some_posts(seed, n=150):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(40)}" for _ in range(26)] for _ in range(8)]
    out = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(26)] = f"v{rng.randrange(9)}"
        text = rng.choice([" ".join(words), " ".join(words), f"own {i}", None, f"call 90123456{rng.randrange(10)} {i}"])
        image = 0x0F0F << 20 ^ sum(1 << rng.randrange(64) for _ in range(rng.choice([0, 3, 7])))
        out.append((
            rng.choice(["a", "b"]), i, text, rng.choice([None, None, f"k:{rng.randrange(12)}"]), rng.choice([None, rng.randrange(3)]),
            rng.choice([None, f"{image:016x}", f"{rng.getrandbits(64):016x}"]),
        ))
    return out


def folded(posts, signals):
    """One post after the other against a plain list of the kept ones."""
    kept, out = [], {}
    for p in sorted(posts, key=lambda p: p[1]):
        _, i, _, key, parent, image = p
        s = signals[i]
        sibling = lambda q: parent is not None and parent == q[4]
        forward = next((q[1] for q in kept if key is not None and q[3] == key and not sibling(q)), None)
        same = next((q[1] for q in kept if s["text_hash"] is not None and signals[q[1]]["text_hash"] == s["text_hash"]), None)
        if forward is not None or same is not None:
            out[i] = ("high_confidence_duplicate", "text_hash" if forward is None else "forward_origin", same if forward is None else forward)
            continue
        found, mine = [], set(s["tokens"])
        near = [(-len(mine & o) / len(mine | o), q[1]) for q in kept if (o := set(signals[q[1]]["tokens"])) and mine]
        if near and -min(near)[0] >= 0.88:
            found.append(("near_text", min(near)[1]))
        images = [((int(q[5], 16) ^ int(image, 16)).bit_count(), q[1]) for q in kept if q[5] and image]
        if images and min(images)[0] <= 8:
            found.append(("phash", min(images)[1]))
        phones = [q[1] for q in kept if set(signals[q[1]]["phones"]) & set(s["phones"])]
        if phones:
            found.append(("phone", phones[0]))
        kept.append(p)
        out[i] = ("needs_reviewable_signal" if found else "proceed_to_ai", ",".join(k for k, _ in found), found[0][1] if found else None)
    return out


def wanted(spark, posts):
    signals = {r["post_id"]: r for r in prededup.signals(spark.createDataFrame(posts, SHAPE)).collect()}
    return folded(posts, signals)


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_equal_the_fold(spark, seed):
    posts = some_posts(seed)
    got = {r["post_id"]: tuple(r)[1:] for r in prededup.decide(spark.createDataFrame(posts, SHAPE)).collect()}
    assert got == wanted(spark, posts)
    assert len({d for d, _, _ in got.values()}) == 3


def test_a_skipped_post_blocks_nobody(spark):
    """2 repeats the text of 1; 3 has the forward key of 2 only, 4 that of 3; 5 repeats 4, a sibling by key but not by text."""
    rows = [(1, None, None, "x"), (2, "k", None, "x"), (3, "k", 7, None), (4, "k", None, "y"), (5, "k", 7, "y"), (6, "k", 7, "z"), (7, "k", 8, "z")]
    df = spark.createDataFrame(rows, "post_id bigint, forward_key string, parent_ref bigint, text_hash string")
    got = {r["post_id"]: tuple(r)[1:] for r in prededup.kept_in_order(df).collect()}
    assert got == {
        1: (True, None, None), 2: (False, None, 1), 3: (True, None, None), 4: (False, 3, None), 5: (True, None, None), 6: (True, None, None), 7: (False, 3, 6),
    }


def test_a_long_chain_of_blocks(spark):
    """Each post repeats the forward key of the one before and the text of the one behind: every other one is kept."""
    rows = [(i, f"k{(i + 1) // 2}", None, f"h{i // 2}") for i in range(14)]
    df = spark.createDataFrame(rows, "post_id bigint, forward_key string, parent_ref bigint, text_hash string")
    assert {r["post_id"] for r in prededup.kept_in_order(df).where("kept").collect()} == set(range(0, 14, 2))


def test_no_posts(spark):
    assert prededup.decide(spark.createDataFrame([], SHAPE)).count() == 0


def test_stream_decides_like_the_fold_after_a_restart(spark, tmp_path):
    """Three files are three batches; the query is stopped and begun again between them, its state is on disk."""
    posts = some_posts(3)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = {}
    for k in range(3):
        spark.createDataFrame(posts[50 * k : 50 * k + 50], SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        told = history.decided_as_they_come(stream, "scope")
        query = told.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        assert r["post_id"] not in got
        got[r["post_id"]] = (r["decision"], r["reasons"], r["reference"])
    for scope in "ab":
        mine = [p for p in posts if p[0] == scope]
        want = wanted(spark, mine)
        assert {i: got[i] for i in want} == want
    assert normalised_text(None) == ""
