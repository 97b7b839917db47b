"""Every stage of the pipeline against brute force on a small corpus."""

import os
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from listingloom.llm import common, near
from tests.llm.test_dedup import contained, roots


def similarity(a, b):
    x, y = ({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / max(1, len(x | y))


def corpus():
    rng = random.Random(11)
    items = [(i, " ".join(f"q{i}x{k}" for k in range(20))) for i in range(4)]
    texts = [None, "", "123 456", "!!!"]
    for _ in range(60):
        base = [f"{rng.choice(['alpha', 'beta', 'gamma'])}{rng.randrange(400)}" for _ in range(150)]
        texts.append(" ".join(base))
        if rng.random() < 0.4:
            texts.append("  ".join(base))
        if rng.random() < 0.4:
            edited = list(base)
            edited[rng.randrange(150)] = "changed"
            texts.append(" ".join(edited))
        if rng.random() < 0.2:
            texts.append(" ".join([*base[:60], rng.choice(items)[1], *(f"n{rng.randrange(900)}" for _ in range(60))]))
    rng.shuffle(texts)
    return list(enumerate(texts)), items


def test_stages(spark, tmp_path):
    rows, items = corpus()
    shape = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], shape).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, now = spark.read.parquet(str(tmp_path / "documents.parquet")), dict(rows)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)))
        if name == "language_id":
            keep = {i for i, t in now.items() if re.search(r"[a-z]", t or "")}
        elif name == "exact_dedup":
            first = {}
            for i in sorted(now):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", now[i]), i)
            keep = set(first.values())
        elif name == "near_dedup":
            found = roots(now, [(a, b) for a in now for b in now if a < b and similarity(now[a], now[b]) >= 0.8])
            keep = {i for i in now if found[i] == i}
            assert len(now) - len(keep) > 10
        else:
            keep = set(now) - {d for d, _ in contained(now.items(), items)}
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} == keep and len(keep) <= len(now)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now = {i: now[i] for i in keep}
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in last} == set(now) and all(r["n_tokens"] == len(r["ids"]) for r in last)


def edited_pairs():
    """Pairs of texts from about 0.5 to 0.95 alike, and one group of 90 copies that differ from a base in places of their own."""
    rng = random.Random(5)
    texts = []
    for k in range(240):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        other = list(base)
        for _ in range(1 + k % 14):
            other[rng.randrange(200)] = f"e{rng.randrange(5000)}"
        texts += [" ".join(base), " ".join(other)]
    base = [f"h{i}" for i in range(200)]
    for _ in range(90):
        other = list(base)
        for _ in range(rng.randrange(6)):
            other[rng.randrange(200)] = f"e{rng.randrange(5000)}"
        texts.append(" ".join(other))
    return dict(enumerate(texts))


def shingles_of(text):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup_groups_are_those_of_the_exact_similarity(spark, monkeypatch):
    texts = edited_pairs()
    sets = {i: shingles_of(t) for i, t in texts.items()}
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in texts for b in texts if a < b and sets[a] & sets[b]}
    for low, high in ((0.58, 0.65), (0.68, 0.75), (0.75, 0.8), (0.8, 0.82), (0.83, 0.88)):
        assert sum(low <= s < high for s in like.values()) > 5
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    want = roots(texts, [p for p, s in like.items() if s >= 0.8])
    for cell in (near.CELL, 8):  # whole buckets, and buckets cut into many cells
        monkeypatch.setattr(near, "CELL", cell)
        got = {r["doc_id"]: r["component_id"] for r in near.near_groups(docs).collect()}
        assert {i: got.get(i, i) for i in texts} == want
        keep = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
        assert keep == {i for i in texts if want[i] == i}
    assert near.near_groups(docs.limit(0)).count() == 0


def test_a_pair_at_the_radius_is_not_missed():
    """The 128-bit comparison loses no pair of similarity 0.8, over several lengths."""
    rng = random.Random(8)
    for n in (30, 60, 200, 600):
        for _ in range(60):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            for tail in range(n):
                other = base[: n - tail] + [f"z{k}" for k in range(tail)]
                if len(shingles_of(" ".join(base)) & shingles_of(" ".join(other))) / len(shingles_of(" ".join(base)) | shingles_of(" ".join(other))) < 0.8:
                    break
                last = other
            a, b = (near.shingle_set(" ".join(x)) for x in (base, last))
            assert near.alike(a, b)
            assert np.bitwise_count(near.wide_fingerprint(a) ^ near.wide_fingerprint(b)).sum() <= near.RADIUS


def odd_documents(spark):
    base = [f"m{i}" for i in range(60)]
    edited = " ".join([*base[:40], "other", *base[41:]])
    shape = "doc_id bigint, text string, lang string, _bad bigint, _lang string, `a.b` string, _row string, _key bigint"
    rows = [
        (1, " ".join(base)), (1, "quite another text under the same id"), (2, edited), (2, edited), (3, None), (3, ""), (None, " ".join(base)),
        (None, "a row without id"), (4, "letters " * 3000), (4, "letters " * 3000), (5, " \t\n"), (6, "12 34"),
    ]
    return spark.createDataFrame([(i, t, "en", 7, "keep", "dot", "row", 9) for i, t in rows], shape)


def texts_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_on_odd_rows_and_clashing_names(spark, tmp_path):
    docs = odd_documents(spark)
    base = " ".join(f"m{i}" for i in range(60))
    items = "item_id bigint, text string, _bad string"
    spark.createDataFrame([(0, "quite another text under the same", "x"), (1, None, "x")], items).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {n: f(spark, docs, str(tmp_path)) for n, f in corpus_pipeline.STAGES}
    for name, df in list(out.items())[:-1]:
        assert df.columns == docs.columns
        for r in df.collect():
            assert (r["lang"], r["_bad"], r["_lang"], r["a.b"], r["_row"], r["_key"]) == ("en", 7, "keep", "dot", "row", 9), name
    every = texts_of(docs)
    assert texts_of(out["language_id"]) == [x for x in every if x[1] and re.search("[a-z]", x[1])]
    assert len(texts_of(out["exact_dedup"])) == 8  # base, another, edited, empty, without id, letters, space, digits
    assert (1, base) in texts_of(out["exact_dedup"]) and (None, base) not in texts_of(out["exact_dedup"])
    gone = {(2, docs.where("doc_id = 2").first()["text"]), (None, base)}
    assert texts_of(out["near_dedup"]) == [x for x in every if x not in gone]
    assert texts_of(out["decontamination"]) == [x for x in every if x[0] != 1]
    assert out["sentencepiece"].count() == len(every)
    spark.createDataFrame([], items).write.parquet(str(tmp_path / "none/benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path / "none")).count() == 0
    assert texts_of(corpus_pipeline.decontamination(spark, docs, str(tmp_path / "none"))) == every


def test_rows_of_many_gone_keys_pass_through_a_filter(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("id as doc_id", "cast(id as string) as text")
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    gone = common.written(spark.range(0, 5000, 7).selectExpr("id as k"))
    left = common.without(rows, [rows["doc_id"]], gone)
    assert {r["doc_id"] for r in left.collect()} == {i for i in range(5000) if i % 7}


def test_a_cluster_session_without_a_shared_folder_is_refused():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_only_written_tables_are_deleted(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "own"))
    own, made, empty = spark.read.parquet(str(tmp_path / "own")), common.written(spark.range(3)), common.written(spark.range(0))
    folder = made.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    common.forget(own, made, empty)
    assert own.count() == 5 and not os.path.exists(folder)
