"""Tokenizing, chat, HTML, counting, language and quality."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from listingloom.llm import chat, html, langid, pieces, quality, tokencounts
from listingloom.llm.queries import piece_model_path, vocabulary_path
from listingloom.llm.templates import Template, TemplateError

PARTS = list(" ▁\n\tabetioEé漢字😀\x00.,!  ingŕ") + ["the ", "ation", "  "]


def random_text(rng, n=90, parts=PARTS):
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, n)))


def test_pieces_equal_the_library():
    import sentencepiece

    library, model, rng = sentencepiece.SentencePieceProcessor(model_file=piece_model_path()), pieces.load(piece_model_path()), random.Random(1)
    for text in [random_text(rng) for _ in range(1500)] + ["a" * 3000, "ab" * 500 + " " * 99, " ", "▁", "é" * 70]:
        ids, begins, ends = model.encode(text)
        assert ids.tolist() == library.encode(text)
        assert model.decode(ids) == library.decode(ids.tolist())
        raw = text.encode()
        assert not len(ids) or (begins[0] == 0 and ends[-1] == len(raw) and (begins[1:] == ends[:-1]).all())
        if "▁" not in text:
            joined = b"".join(model.out[i] for i in ids.tolist())
            assert joined[1:] == raw if text else joined == b""
    for _ in range(500):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(270) for _ in range(rng.randint(0, 12))]
        assert model.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_many_texts_at_once_equal_one_by_one(monkeypatch):
    """Words merged together, words looked up, and a cache that is full again and again."""
    import sentencepiece

    library, model, rng = sentencepiece.SentencePieceProcessor(model_file=piece_model_path()), pieces.PieceModel(piece_model_path()), random.Random(12)
    parts = ["a", "b", "t", "he", "ing", "ation", "é", "漢", ",", ".", "\n", "0", "R"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(900)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [random_text(rng) for _ in range(200)] + ["", " a", "a  b", "x" * 500]
    monkeypatch.setattr(pieces, "CACHE", 300)
    monkeypatch.setattr(pieces, "CHARS_AT_ONCE", 4000)
    monkeypatch.setattr(pieces, "MERGED_AT_ONCE", 64)
    for _ in range(2):
        got = list(model.encode_all(texts))
        assert [x[0].tolist() for x in got] == [library.encode(t) for t in texts]
        for text, (ids, begins, ends) in zip(texts, got):
            one = model.encode(text)
            assert all((x == y).all() for x, y in zip(one, (ids, begins, ends)))


def double_array(entries):
    """A compiled map of bytes -> replacement, laid out by brute force."""
    pool, units, taken = b"", {0: [0, None, False]}, {0}
    trie = {}
    for key, out in entries.items():
        node = trie
        for b in key:
            node = node.setdefault(b, {})
        node[None] = len(pool)
        pool += out + b"\0"

    def place(node, at):
        labels = [0 if b is None else b for b in node]
        base = next(o for o in range(1, 1 << 20) if all((at ^ o ^ b) not in taken for b in labels) and (at ^ o) not in taken or all((at ^ o ^ b) not in taken for b in labels))
        units[at][1] = base
        units[at][2] = None in node
        for b, child in node.items():
            spot = at ^ base ^ (0 if b is None else b)
            taken.add(spot)
            units[spot] = [0x80000000 | child, 0, False] if b is None else [b, 0, False]
        for b, child in node.items():
            if b is not None:
                place(child, at ^ base ^ b)

    place(trie, 0)
    words = [0] * (max(units) + 1)
    for at, (label, base, leaf) in units.items():
        words[at] = label if label & 0x80000000 else (base << 10) | (leaf << 8) | label
    blob = np.array(words, "<u4").tobytes()
    return len(blob).to_bytes(4, "little") + blob + pool


def test_character_map_takes_the_longest_prefix_and_keeps_alignment():
    table = {"ﬁ".encode(): b"fi", b"a": b"x", b"ab": b"yz", "Å".encode(): "å".encode()}
    charmap = pieces.CharMap(double_array(table))
    assert charmap.longest(b"abc", 0) == (2, b"yz") and charmap.longest(b"ac", 0) == (1, b"x") and charmap.longest(b"c", 0) is None
    model = pieces.PieceModel(piece_model_path())
    model.charmap, model.squeeze = charmap, 1
    norm, source = model.normalise("  ab ﬁ  Å ")
    assert norm == "▁yz▁fi▁å" and source.tolist() == [2, 2, 2, 4, 5, 5, 8, 10, 12]
    ids, begins, ends = model.encode("ab ﬁ")
    assert begins[0] == 0 and ends[-1] == 6 and all(a <= b for a, b in zip(begins, ends))


def test_encode_and_decode_rows(spark):
    docs = spark.createDataFrame([(1, "Hello  world", 5), (2, None, 6), (3, "", 7), (3, "é\n", 8), (None, "x", 9)], "doc_id bigint, text string, ids bigint")
    encoded = pieces.encode_documents(docs, piece_model_path())
    got = pieces.decode_documents(encoded, piece_model_path()).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in got) == [("1", "Hello  world"), ("2", ""), ("3", ""), ("3", "é\n"), ("None", "x")]
    once = pieces.encode_documents(docs, piece_model_path(), decoded=True)
    assert sorted((str(r["doc_id"]), r["decoded"], r["ids"]) for r in once.collect()) == sorted((str(r["doc_id"]), r["decoded"], r["ids"]) for r in got)
    assert pieces.encode_documents(docs.limit(0), piece_model_path()).count() == pieces.decode_documents(encoded.limit(0), piece_model_path()).count() == 0
    clash = spark.createDataFrame([([5, 6], "old", 1, 2)], "`i.ds` array<int>, decoded string, ids int, `row` int")
    again = pieces.decode_documents(clash, piece_model_path(), ids_col="i.ds").first()
    assert (again["row"], again["ids"], again["i.ds"]) == (2, 1, [5, 6]) and again["decoded"] != "old"
    assert pieces.decode_documents(spark.createDataFrame([(1, None)], "a int, ids array<int>"), piece_model_path()).first()["decoded"] == ""


def test_token_tree_equals_full_encoding():
    import tiktoken

    path = vocabulary_path()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokencounts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    vocabulary, rng = tokencounts.load(path), random.Random(5)
    parts = ["a", " ", "  ", "\n", "'re", "'", "r", "e", "1", "é", "漢", "!", "the ", "'s", "\t", "Zw😀"]
    again = whole = 0
    for _ in range(400):
        text = random_text(rng, 400, parts)
        tree = tokencounts.TokenTree(text, vocabulary)
        for _ in range(6):
            pos, gone, new = rng.randint(0, len(text) + 2), rng.choice([0, 0, 1, 2, 5, 40]), random_text(rng, rng.choice([6, 600]), parts)
            again += tree.edit(pos, gone, new)
            pos = min(pos, len(text))
            text = text[:pos] + new + text[pos + gone :]
            whole += tree.n_pretokens
            assert tree.text() == text and tree.n_chars == len(text)
            assert tree.n_tokens == len(library.encode_ordinary(text))
    assert again < whole


def test_counts_under_edits_rows(spark):
    path = vocabulary_path()
    edit = "array<struct<pos:bigint,deleted:bigint,inserted:string>>"
    rows = [(1, "hello world", [(5, 0, " big")]), (2, None, [(0, 9, "x")]), (3, "abc", None), (4, "abc", [(None, 1, "z"), (99, 5, None)])]
    df = spark.createDataFrame(rows, f"doc_id bigint, text string, edits {edit}")
    got = {r["doc_id"]: r["c"] for r in df.select("doc_id", tokencounts.count_under_edits(F.col("text"), F.col("edits"), path).alias("c")).collect()}
    assert (got[1]["n_tokens"], got[1]["edited_tokens"]) == (2, 3) and got[2]["edited_chars"] == 1
    assert got[3]["n_tokens"] == got[3]["edited_tokens"] and got[4]["edited_chars"] == 3
    edits = spark.createDataFrame([(1, 2, 0, 0, "b"), (1, 1, 0, 0, "a")], "doc_id bigint, seq int, pos bigint, deleted bigint, inserted string")
    assert [e["inserted"] for e in tokencounts.gathered_edits(edits).first()["edits"]] == ["a", "b"]


def test_templates():
    t = Template("{% if 1 == 1 %}A{{ 'b' + 'c' }}{% else %}no{% endif %}{% for m in ms %}{{ loop.index }}{% if m.x in ok and not m.y %}!{% elif m['x'] == 2 %}?{% endif %}{% endfor %}")
    assert len(t.tree) == 2
    assert t.render(ms=[{"x": 1}, {"x": 2}, {"x": 1, "y": True}], ok=[1])[0] == "Abc1!2?3"
    text, spans = Template("{% set a = 'z' %}{{ a }}{% generation %}{{ b }}{{ c }}{% endgeneration %}.{% generation %}q{% endgeneration %}").render(b="12", c="3")
    assert (text, spans) == ("z123.q", [(1, 4), (5, 6)])
    for bad in ("{{ f(x) }}", "{% import os %}", "{{ a | nofilter }}", "{% if x %}", "{{ a. }}", "{{ 'x }}"):
        with pytest.raises(TemplateError):
            Template(bad)
    assert Template("{{ x.__class__ }}").render(x=1)[0] == ""


def test_chat_round_trip(spark):
    rng, parts = random.Random(9), ["\\", "### ", "###", ": ", ":", "</turn>", "</turn", "\n", "a", " ", "Assistant", "é"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 5)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "a: b", None]), rng.choice([None, random_text(rng, 8, parts)])))
    rows += [(0, 0, "user", "tie"), (None, 1, "assistant", "no id"), (0, None, "assistant", "null turn")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    assert set(got) == set(by_conv)
    for conv, turns in by_conv.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0)).count() == 0


def longest(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(1500):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 14))] for _ in range(2))
        at = sorted(html.shared_lines(a, b))
        rest = iter(b)
        assert len(at) == longest(a, b) and all(any(a[i] == y for y in rest) for i in at)


def test_page_parts():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header>top</header><nav><ul><li>menu</ul></nav><!-- no -->"
        "<div class='ad'>buy</div><article><header><h1>Head  line</h1></header><p><b>Fat &amp; <i>thin</i>\n text<br>more<p>next<aside>side</aside>"
        "<div class='comments'><p>me first</div><form><p>mail</form><p hidden>gone</p><ul><li>one<li>two</ul>tail</article><footer>&copy; x</footer>"
    )
    assert html.main_text(html.page_lines(page), [])[0] == "Head line\nFat & thin text more\nnext\none\ntwo\ntail"
    assert html.page_lines("") == [] and html.main_text([], []) == ("", 0)
    assert html.page_lines("just <b>text") == [(html.PLAIN, "just text")]


def test_hidden_elements_end_where_they_end():
    def text(body):
        return html.main_text(html.page_lines(f"<article>{body}</article>"), [])[0]

    assert text('<p>one <svg class="i"/> two</p><p>three</p>') == "one two\nthree"
    assert text("<p>one <math/> two</p>") == "one two" and text("<p>one <svg><path d='M0'/></svg> two</p>") == "one two"
    assert text('<p>a</p><audio-player src="x"></audio-player><object-list>b</object-list><p>c</p>') == "a\nb\nc"
    assert text("<p>a</p><canvas><p>b</p>") == "a\nb" and text("<p>a</p><script>var x = 1;") == "a"


def test_names_that_mark_a_part():
    def kept(attributes):
        return html.page_lines(f"<div {attributes}><p>x</p></div>")[0][0] == html.PLAIN

    for away in ("class='ad'", 'id="site-footer"', "class=cookie-banner", "class='x ad-slot-3'", "hidden", "style='display: none'", 'aria-hidden="true"'):
        assert not kept(away), away
    for plain in ("class='social-science'", "data-class='ad'", "title='hidden class ad'", "class='shadow'", "data-hidden='1'", "id=adder"):
        assert kept(plain), plain


def plain_page(*lines):
    return "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"


def expected_pages(rows):
    """Brute force for small hosts: a page without article loses the lines of an LCS with the next page on each side that has other lines."""
    out = {}
    lines = {i: re.findall("<div>(.*?)</div>", h or "") for i, _, h in rows}
    key = {i: re.fullmatch("(?:https?://([^/]*))?(.*)", u or "").groups(default="") for i, u, _ in rows}
    for i, _, _ in rows:
        order = sorted((j for j in lines if key[j][0] == key[i][0]), key=lambda j: (key[j][1], j))
        at = order.index(i)
        ahead = [x for k, j in enumerate(reversed(order[:at])) if (x := lines[j]) != lines[i]]
        behind = [x for j in order[at + 1 :] if (x := lines[j]) != lines[i]]
        differ = lambda xs: [x for k, x in enumerate(xs) if k == 0 or x != xs[k - 1]]
        near = ahead[:1] + behind[:1] if ahead and behind else differ(ahead)[:2] + differ(behind)[:2]
        shared = set(range(len(lines[i])))
        for other in near:
            shared &= html.shared_lines(lines[i], other)
        out[i] = "\n".join(x for k, x in enumerate(lines[i]) if not near or k not in shared)
    return out


def test_pages_without_article_lose_lines_shared_with_their_nearest_pages(spark):
    rng, rows = random.Random(6), []
    for host in range(6):
        for k in range(rng.choice([1, 2, 3, 9])):
            body = [f"host {host}", *(f"t{rng.randrange(99)}" for _ in range(rng.randrange(4))), rng.choice(["quoted", "rare"]), f"foot {host}"]
            rows.append((len(rows), f"http://h{host}.x/{rng.choice('ab')}/{k}", plain_page(*body)))
    same = plain_page("mirror", "of one page")
    rows += [(100 + k, "http://m.x/p", same) for k in range(5)] + [(110 + k, f"http://m.x/p/{k}", same) for k in range(5)]
    rows += [(120, None, None), (121, "", ""), (122, "http://two.x/1", plain_page("top", "one", "end")), (123, "http://two.x/2", plain_page("top", "two", "end"))]
    want = expected_pages(rows)
    assert want[100] == want[114] == "mirror\nof one page" and (want[122], want[123]) == ("one", "two") and want[120] == ""
    rows += [(130 + k, f"http://c.x/{k}", "<div>top</div><article><p>copy</p><p>of a passage</p></article>") for k in range(3)]
    want |= {130 + k: "copy\nof a passage" for k in range(3)}
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(0)).withColumn("host", F.lit("x")).withColumn("lines", F.lit(1))
    for parts in (1, 7):
        got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract_pages(df.repartition(parts)).collect()}
        assert got == {i: (t, len(t)) for i, t in want.items()}
    assert html.extract_pages(df.limit(0)).count() == 0


def test_large_hosts_and_folders_are_cut(spark, monkeypatch):
    monkeypatch.setattr(html, "GROUP_PAGES", 8)
    rows = [(k, f"http://big.x/{'one' if k % 3 else k % 50}/{k}", plain_page("top", f"body {k}", "end")) for k in range(300)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    groups = html._grouped(df).groupBy("host", "part").count().collect()
    assert max(r["count"] for r in groups) < 40 and len(groups) > 20
    got = {r["page_id"]: r["text"] for r in html.extract_pages(df).collect()}
    assert len(got) == 300 and sum(got[k] == f"body {k}" for k in got) > 285


def test_cuts_of_large_hosts_do_not_show(spark, monkeypatch):
    """Hosts of many folders and pages, with runs of equal pages longer than a part, repeated rows and ids: the text of one part each."""
    rng, rows = random.Random(4), []
    for k in range(240):
        body = "same" if k % 60 > 30 else f"body {rng.randrange(k // 4 + 1)}"
        rows.append((k // 2 if k < 20 else k, f"http://big.x/{k // 80}/{k:03}", plain_page("top", f"menu {k // 7}", body, *(["near"] if k % 2 else []), "end")))
    rows += [(300 + k, f"http://b{k % 5}.x/{k}", plain_page("top", f"body {k}", "end")) for k in range(30)] + rows[35:38] * 3 + [(None, None, None), (None, "", plain_page("a"))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = []
    for pages in (1, 3, 8, 50, 10_000):
        monkeypatch.setattr(html, "GROUP_PAGES", pages)
        got.append(sorted(map(tuple, html.extract_pages(df).collect()), key=str))
    assert all(g == got[-1] for g in got) and len(got[0]) == len(rows)
    monkeypatch.setattr(html, "MOST_PARTS", 2)
    assert sorted(map(tuple, html.extract_pages(df).collect()), key=str) == got[0]


def toy_documents(spark):
    rng, rows = random.Random(3), []
    parts = {"aa": ["ba", "na", "ka"], "bb": ["xu", "zö", "qué"], "cc": ["мир", "да", "нет"]}
    for i in range(600):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 40)))
        rows.append((i, text, lang))
    return spark.createDataFrame([*rows, (900, None, "aa"), (901, "", None), (902, "123 ...", "bb"), (903, "bana kana", None), (903, "bana kana", None)], "doc_id bigint, text string, lang string")


def test_language_held_out_accuracy(spark):
    docs = toy_documents(spark)
    rows = langid.identify_held_out(docs).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    judged = [r for r in rows if r["held_out"] and r["doc_id"] < 900]
    assert len(rows) == 605 and len(judged) > 60
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in judged) >= 0.98 * len(judged)
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows if r["doc_id"] >= 900}
    assert odd[900] == odd[901] == odd[902] == ("und", 0.0) and odd[903][0] == "aa"
    assert all(0 <= r["score"] <= 1 for r in rows)
    nothing = langid.train(docs.where("lang is null"))
    assert nothing.predict(["some text", None]) == (["und", "und"], [0.0, 0.0])


def test_kernel_is_the_normalised_count_of_shared_grams():
    a, b = (np.zeros(langid.GRAMS, bool) for _ in range(2))
    assert langid.presence("ab", a) and langid.presence("abc", b) and not langid.presence("12", np.zeros(langid.GRAMS, bool))
    assert a.sum() == 3 and b.sum() == 6 and (a & b).sum() == 3


def test_quality_held_out_accuracy(spark):
    rng, docs, labels = random.Random(4), [], []
    for i in range(600):
        good = rng.random() < 0.7
        words = ["word%d" % rng.randrange(300) for _ in range(rng.randint(10, 80))]
        text = " ".join(words) + "." if good else " ".join(w.upper() + "###" for w in words[:3] * 9)
        docs.append((i, text))
        labels.append((i, int(good), 0))
    df = spark.createDataFrame([*docs, (900, None), (901, "")], "doc_id bigint, text string")
    marks = spark.createDataFrame([*labels, (5, None, 1)], "doc_id bigint, quality int, toxic int")
    rows = quality.score_held_out(df, marks).collect()
    truth = {i: g for i, g, _ in labels}
    judged = [r for r in rows if r["held_out"] and r["doc_id"] < 900]
    assert len(rows) == 602 and len(judged) > 80
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in judged) >= 0.97 * len(judged)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert quality.score_held_out(df.limit(0), marks).count() == 0
    flat = quality.train(df, marks.limit(0))
    assert flat.score(np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]


def test_language_scores_equal_kernel_ridge_by_hand(spark, monkeypatch):
    """The collapsed product gives what kernels with the landmarks, Nyström features and a weighted ridge give when written out."""
    monkeypatch.setattr(langid, "LANDMARKS_PER_LANGUAGE", 12)
    docs = toy_documents(spark).where("doc_id < 150")
    model = langid.train(docs)
    alphabet = langid._class_of()

    def grams(text):
        c = [int(alphabet[ord(x)]) for x in text.lower()]
        return {(x,) for x in c} | set(zip(c, c[1:])) | set(zip(c, c[1:], c[2:]))

    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    rows = docs.select("text", "lang", F.xxhash64("text").alias("k")).toPandas().sort_values(["lang", "k"], kind="stable")
    sets, langs = [grams(t) for t in rows["text"]], rows["lang"].tolist()
    marks = [i for lang in model.languages for i in [j for j, x in enumerate(langs) if x == lang][:12]]
    k = np.array([[kernel(a, sets[m]) for m in marks] for a in sets])
    values, vectors = np.linalg.eigh(k[marks])
    use = values > values.max() * 1e-6
    root = vectors[:, use] / np.sqrt(values[use])
    phi = k @ root
    asked = ["bana kaba nanaka", "xuzö quéxu", "мир да нет мир", "ba xu мир"]
    seen = np.array([[kernel(grams(t), sets[m]) for m in marks] for t in asked]) @ root
    out = []
    for lang in model.languages:
        y = np.array([1.0 if x == lang else -1.0 for x in langs])
        w = np.array([len(langs) / len(model.languages) / langs.count(x) for x in langs])
        mean, target = (w[:, None] * phi).sum(axis=0) / w.sum(), (w * y).sum() / w.sum()
        centred = phi - mean
        beta = np.linalg.solve((centred.T * w) @ centred + langid.RIDGE * len(langs) * np.eye(phi.shape[1]), (centred.T * w) @ (y - target))
        out.append((seen - mean) @ beta + target)
    f = np.stack(out, axis=1)
    p = np.exp(langid.SHARPNESS * f) / np.exp(langid.SHARPNESS * f).sum(axis=1, keepdims=True)
    told, score = model.predict(asked)
    assert told == [model.languages[i] for i in f.argmax(axis=1)] and told[:3] == ["aa", "bb", "cc"]
    assert np.allclose(score, p.max(axis=1), atol=2e-3)


def test_only_the_commonest_languages_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    rows = [(i, f"word{'a' * (i % 7)} text", ["x", "y", "z"][min(2, i % 5 // 2)]) for i in range(100)]
    assert langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).languages == ("x", "y")


def test_quality_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(5)
    x = rng.random((400, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.6)).astype(float)
    model = quality.fit(x, y)
    assert len(model.pairs) == quality.PAIRS
    for row, score in zip(x[:60], model.score(x[:60])):
        bins = [sum(e <= v for e in edges) for v, edges in zip(row, model.edges)]
        f = model.bias + sum(t[b] for t, b in zip(model.tables, bins))
        f += sum(g[model.coarse[i][bins[i]], model.coarse[j][bins[j]]] for (i, j), g in zip(model.pairs, model.grids))
        assert abs(score - 1 / (1 + np.exp(-f))) < 1e-12
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_operators_pass_by_other_columns(spark):
    """Columns named as the operators' own, dotted names, repeated rows and empty tables."""
    shape = "doc_id bigint, text string, lang string, quality int, id string, row string, `a.b` int, c string, score double, prediction string"
    docs = spark.createDataFrame([(i, f"plain words {'xyz'[i % 3]} and more", "en", 1, "i", "r", 3, "c", 0.1, "p") for i in (1, 1, 2, 3, 4, 5, 6)], shape)
    marks = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    path = vocabulary_path()
    no_edits = F.array().cast("array<struct<pos:bigint,deleted:bigint,inserted:string>>")
    for rows in (docs, docs.limit(0)):
        n = rows.count()
        assert langid.identify_held_out(rows).count() == quality.score_held_out(rows, marks).count() == n
        assert pieces.encode_documents(rows, piece_model_path(), decoded=True).count() == n
        counted = rows.withColumn("n", tokencounts.count_under_edits(F.col("text"), no_edits, path)["n_tokens"])
        assert counted.columns == [*rows.columns, "n"] and counted.count() == n
    assert tokencounts.gathered_edits(spark.createDataFrame([], "doc_id bigint, seq int, pos bigint, deleted bigint, inserted string")).count() == 0


def test_pieces_hold_a_slice_of_a_batch():
    import pyarrow as pa

    model, most = pieces.PieceModel(piece_model_path()), []

    class Spy:
        decode = model.decode

        def encode_all(self, texts):
            most.append(len(texts))
            return model.encode_all(texts)

    texts = [None, "", *(f"some text {i}" for i in range(700))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(702)), pa.array(texts, pa.string())], ["id", "text"])
    out = pa.Table.from_batches(list(pieces._encoded(iter([batch]), Spy(), True, ["id", "ids", "begins", "ends", "decoded"])))
    assert max(most) <= 256 and sum(most) == 702
    assert out["id"].to_pylist() == list(range(702)) and out["decoded"].to_pylist() == ["", "", *texts[2:]]
