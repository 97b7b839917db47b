"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listingloom.llm import chat, decontaminate, exact, html, langid, pieces, quality, repair, shards, simhash, tokencounts, trie, warc
from listingloom.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def piece_model_path() -> str:
    """The SentencePiece model file of the installed tokenizer package; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_documents(table(spark, sf_dir, "documents"), piece_model_path(), decoded=True)
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("bigint").alias("source_bytes"),
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_held_out(table(spark, sf_dir, "documents"))


#: The extra conversation of the query: both texts look like the template's own marks.
MARKED_TEXT = "\\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", MARKED_TEXT), (-7, 1, "assistant", MARKED_TEXT)], turns.schema)
    return chat.digests(chat.format_conversations(turns.unionByName(extra)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_by_bytes(table(spark, sf_dir, "documents"))


def vocabulary_path() -> str:
    """The byte-level vocabulary of the installed tokenizer package; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def example_edits(doc_id: Column, text: Column, source: Column) -> Column:
    """Three edits of a document, fixed by its columns: an insertion, a deletion and a replacement."""
    n, k = F.length(text), F.pmod(doc_id, F.lit(11))
    edits = [
        (F.floor(n / 2) + k, F.lit(0), F.concat(F.lit(" "), source, F.lit(" "))),
        (F.floor(n / 4), F.lit(12) + k, F.lit("")),
        (F.floor(n * 3 / 4), k, F.concat(F.lit("'re "), source)),
    ]
    return F.array(*(F.struct(p.cast("bigint").alias("pos"), d.cast("bigint").alias("deleted"), i.alias("inserted")) for p, d, i in edits))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    edits = example_edits(F.col("doc_id"), F.col("text"), F.coalesce("source", F.lit("")))
    counted = docs.select("doc_id", tokencounts.count_under_edits(F.col("text"), edits, vocabulary_path()).alias("c"))
    return counted.select("doc_id", "c.*")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with keyed as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
), grouped as (
  select text_sha256, min(doc_id) as keep_id, count(*) as group_size from keyed group by text_sha256
)
select k.doc_id, g.keep_id, g.group_size, k.doc_id is not distinct from g.keep_id as kept, k.text_sha256
from keyed k join grouped g using (text_sha256)
"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
with words as (
  select id, kind, list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from (select doc_id as id, 'd' as kind, coalesce(text, '') as t from documents union all select item_id, 'i', coalesce(text, '') from benchmark)
), shingles as (
  select distinct id, kind, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as s from words where len(w) >= 5
), sized as (
  select id as item_id, s, count(*) over (partition by id) as n from shingles where kind = 'i'
)
select d.id as doc_id, z.item_id, count(*) as n_shared, z.n as n_shingles, count(*)::double / z.n as containment
from shingles d join sized z on d.s = z.s and d.kind = 'd'
group by d.id, z.item_id, z.n having count(*) * 5 >= z.n * 4
"""


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(warc.page_records(table(spark, sf_dir, "pages")))
    return warc.page_report(warc.archive(spark, path, payloads="response"))


OP11_SQL = """
with each as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), kept as (
  select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) end as keep_id from each
)
select page_id, payload_bytes, payload_digest, case when keep_id <> page_id then 'revisit' else 'response' end as record_type,
  case when keep_id <> page_id then keep_id end as refers_to
from kept
"""


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.repair_report(turns, repair.damaged(turns))


#: crc32 in SQL: eight steps for each byte of an ASCII text.
CRC_SQL = (
    "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::bigint)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
)

OP12_SQL = """
with recursive original as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as place from conversations
), faulty as (
  select *, CRC % 20 as fault from original
), damaged as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
    case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i
  from (select *, unnest(case when fault = 3 then [0, 1] else [0] end) as copy from faulty where fault <> 0)
), judged as (
  select *, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') as bare, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
    role[1:1] as initial, lag(role[1:1]) over (partition by conv_id order by i) as before
  from damaged
), flagged as (
  select *, bare = '' as blank, bare <> '' and again as duplicate, bare <> '' and not again and right(bare, 1) not in ('.', '!', '?') as truncated from judged
), facts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, sum(blank::int)::bigint as blank, sum(duplicate::int)::bigint as duplicate,
    sum(truncated::int)::bigint as truncated, sum((before is not null and before || initial not in ('su', 'ua', 'au'))::int)::bigint as illegal, max(i) as n
  from flagged group by conv_id
), solved as (
  select conv_id, n as i, {'c': 0, 'l': ''} as s0, {'c': 6, 'l': 'II'} as s1, {'c': 3, 'l': 'I'} as s2, {'c': 0, 'l': ''} as s3 from facts
  union all
  select conv_id, i, list_min([m0, {'c': t2.c + 3, 'l': 'I' || t2.l}]), list_min([m1, {'c': t2.c + 3, 'l': 'I' || t2.l}]), t2, t3
  from (
    select *, list_min([m2, {'c': m3.c + 3, 'l': 'I' || m3.l}]) as t2, list_min([m3, {'c': m2.c + 3, 'l': 'I' || m2.l}]) as t3
    from (
      select conv_id, i,
        list_min([{'c': s0.c + 4, 'l': 'D' || s0.l}, case when stays and initial = 's' then {'c': s1.c + more, 'l': 'K' || s1.l} when stays and initial = 'u' then {'c': s2.c + more, 'l': 'K' || s2.l} end,
          case when stays then {'c': s2.c + more + 3, 'l': 'R' || s2.l} end]) as m0,
        list_min([{'c': s1.c + 4, 'l': 'D' || s1.l}, case when stays and initial = 'u' then {'c': s2.c + more, 'l': 'K' || s2.l} end, case when stays then {'c': s2.c + more + 3, 'l': 'R' || s2.l} end]) as m1,
        list_min([{'c': s2.c + 4, 'l': 'D' || s2.l}, case when stays and initial = 'a' then {'c': s3.c + more, 'l': 'K' || s3.l} end, case when stays then {'c': s3.c + more + 3, 'l': 'R' || s3.l} end]) as m2,
        list_min([{'c': s3.c + 4, 'l': 'D' || s3.l}, case when stays and initial = 'u' then {'c': s2.c + more, 'l': 'K' || s2.l} end, case when stays then {'c': s2.c + more + 3, 'l': 'R' || s2.l} end]) as m3
      from (
        select s.conv_id, s.i - 1 as i, s0, s1, s2, s3, not (blank or duplicate) as stays, case when truncated then 3 else 0 end as more, initial
        from solved s join flagged f on f.conv_id is not distinct from s.conv_id and f.i = s.i
      )
    )
  )
), audits as (
  select conv_id, s0.c as cost, s0.l as audit from solved where i = 0
), letters as (
  select conv_id, unnest(string_split(audit, '')) as letter, generate_subscripts(string_split(audit, ''), 1) as pos from audits where audit <> ''
), placed as (
  select *, sum((letter <> 'I')::int) over (partition by conv_id order by pos) as i from letters
), turns as (
  select p.conv_id, p.pos, p.letter, f.role, f.text, f.initial, row_number() over (partition by p.conv_id order by p.pos) as j
  from placed p left join flagged f on p.conv_id is not distinct from f.conv_id and p.i = f.i where p.letter <> 'D'
), voiced as (
  select *, case when max(case when j = 1 and letter = 'K' and initial = 's' then 1 else 0 end) over (partition by conv_id) = 1 then j + 1 else j end as beat from turns
), repaired as (
  select conv_id, sha256(string_agg(case when letter = 'K' then role when beat % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else text end, chr(10) order by pos)) as repaired_sha256
  from voiced group by conv_id
)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c left join facts f on f.conv_id is not distinct from c.conv_id
  left join audits a on a.conv_id is not distinct from c.conv_id left join repaired r on r.conv_id is not distinct from c.conv_id
""".replace("CRC", CRC_SQL.format("place"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.graft(trie.conversation_paths(table(spark, sf_dir, "conversations"))))


OP13_SQL = """
with turns as (
  select conv_id as c, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as k, length(coalesce(text, '')) as chars,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p
  from conversations where conv_id is not null
), convs as (
  select c, c::varchar as said, CRC % 6 as h from (select distinct c from turns)
), built as (
  select v.c, t.p, t.k, t.chars, 0 as part from convs v join turns t on t.c = v.c - v.c % 100 and t.p <= v.h
  union all select v.c, t.p, t.k, t.chars, 1 from convs v join turns t on t.c = v.c and t.p > v.h
), paths as (
  select v.c, coalesce(list(b.k order by b.part, b.p) filter (where b.k is not null), []) as ks, coalesce(list(b.chars order by b.part, b.p) filter (where b.k is not null), []) as cs
  from convs v left join built b on b.c = v.c group by v.c
), members as (
  select c, d, sha256(array_to_string(ks[1:d], '')) as node, case when d > 0 then sha256(array_to_string(ks[1:d - 1], '')) end as up, case when d > 0 then cs[d] else 0 end as chars, d = len(ks) as ends
  from (select *, unnest(range(0, len(ks) + 1)) as d from paths)
), nodes as (
  select node, any_value(up) as up, any_value(d) as depth, min(c) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(chars) as saved,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where ends), '')) as ends_sha256
  from members group by node
), kids as (
  select up, count(*) as n_children from nodes where up is not null group by up
), below as (
  select distinct a.node as top, b.node from members a join members b on a.c = b.c and a.d <= b.d
), sums as (
  select b.top, sum(n.saved) as saved_tokens, count(*) filter (where k.up is null) as n_leaves
  from below b join nodes n on n.node = b.node left join kids k on k.up = b.node group by b.top
)
select n.conv_id, n.depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, s.n_leaves, s.saved_tokens::bigint as saved_tokens, n.ends_sha256
from nodes n join sums s on s.top = n.node left join nodes u on u.node = n.up left join kids k on k.up = n.node
""".replace("CRC", CRC_SQL.format("said"))

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_html_extraction": op3_html_extraction,
    "op4_language_id": op4_language_id,
    "op5_chat_format": op5_chat_format,
    "op6_quality": op6_quality,
    "op7_sharding": op7_sharding,
    "op8_token_counts": op8_token_counts,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_warc": op11_warc,
    "op12_structure_repair": op12_structure_repair,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL = {
    "op9_exact_dedup": OP9_SQL, "op10_decontamination": OP10_SQL, "op11_warc": OP11_SQL, "op12_structure_repair": OP12_SQL, "op13_prefix_trie": OP13_SQL,
}
