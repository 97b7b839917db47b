"""Duplicate signals of raw posts before any expensive step: exact keys first, then similarity among what is left.

Posts are in order of id. A post that repeats an exact signal of an earlier kept one is skipped and leaves no
signals behind; ``kept_in_order`` finds the kept ones in rounds. Kept posts alone feed the similarity joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.functions.text import normalise_listing_text, phone_numbers, word_tokens
from listingloom.operators.joins import among, hash_join, token_join
from listingloom.sources.tables import checkpointed, stored

NEAR_TEXT, HAMMING = 0.88, 8


def signals(posts: DataFrame, *others: str) -> DataFrame:
    """posts (post_id, text, forward_key, parent_ref, phash) with text_hash, tokens and phones, and the columns ``others``."""
    normal = posts.withColumn("normal", normalise_listing_text(F.coalesce("text", F.lit(""))))
    return normal.select(
        *others, "post_id", "forward_key", "parent_ref", "phash", F.when(F.col("normal") != "", F.sha2("normal", 256)).alias("text_hash"),
        word_tokens(F.col("normal")).alias("tokens"), phone_numbers(F.coalesce("text", F.lit(""))).alias("phones"),
    )


def _apart(a: str, b: str) -> Column:
    """Whether two posts are no siblings: without a parent in common."""
    return F.col(a).isNull() | F.col(b).isNull() | (F.col(a) != F.col(b))


def _forward_leaders(known: DataFrame, name: str) -> DataFrame:
    """(forward_key, name_first struct, name_other): a key's first post, and the first that is no sibling of that one."""
    known = known.where("forward_key is not null").select("post_id", "forward_key", "parent_ref")
    first = known.groupBy("forward_key").agg(F.min(F.struct("post_id", "parent_ref")).alias(f"{name}_first"))
    others = known.join(first, "forward_key").where(_apart("parent_ref", f"{name}_first.parent_ref") & (F.col("post_id") != F.col(f"{name}_first.post_id")))
    return first.join(others.groupBy("forward_key").agg(F.min("post_id").alias(f"{name}_other")), "forward_key", "left")


def _forward_ref(name: str) -> Column:
    """The earlier post of ``_forward_leaders`` that a row of its key repeats, null where there is none."""
    ref = F.when(_apart("parent_ref", f"{name}_first.parent_ref"), F.col(f"{name}_first.post_id")).otherwise(F.col(f"{name}_other"))
    return F.when(ref < F.col("post_id"), ref)


def forward_matches(posts: DataFrame) -> DataFrame:
    """(post_id, forward_ref): the first earlier post of the same forward key that is no sibling of the same parent.

    Per key two posts decide it: the first, and the first of another parent.
    """
    known = posts.where("forward_key is not null").select("post_id", "forward_key", "parent_ref")
    rows = known.join(_forward_leaders(known, "all"), "forward_key")
    return rows.select("post_id", _forward_ref("all").alias("forward_ref")).where("forward_ref is not null")


EXACT = ["post_id", "forward_key", "parent_ref", "text_hash"]


def _first_hashes(rows: DataFrame, name: str) -> DataFrame:
    return rows.where("text_hash is not null").groupBy("text_hash").agg(F.min("post_id").alias(f"{name}_hash"))


def _marked(rows: DataFrame, others: DataFrame, name: str) -> DataFrame:
    """rows with name_forward and name_same: the earlier posts of ``others`` whose forward key or text they repeat."""
    told = rows.join(_forward_leaders(others, name), "forward_key", "left").join(_first_hashes(others, name), "text_hash", "left")
    same = F.when(F.col(f"{name}_hash") < F.col("post_id"), F.col(f"{name}_hash"))
    return told.withColumn(f"{name}_forward", _forward_ref(name)).withColumn(f"{name}_same", same).drop(f"{name}_first", f"{name}_other", f"{name}_hash")


def kept_in_order(posts: DataFrame) -> DataFrame:
    """(post_id, kept, forward_ref, hash_ref) as if posts (EXACT columns, distinct ids) came one by one.

    A post is skipped if an earlier kept one has its forward key (and is no sibling) or its text hash; the refs are the
    first such posts. Skipped posts block nobody, so a post is decided as soon as an earlier kept one blocks it, or
    no earlier undecided one could: each round decides all such posts at once, from the least ids of every key, and only
    undecided posts go on. Rounds follow the longest chain of posts that block each other by turns.
    """
    rows = open_ = checkpointed(posts.select(*EXACT))
    kept = None
    while kept is None or not open_.isEmpty():
        told = _marked(open_, open_, "open")
        free = F.col("open_forward").isNull() & F.col("open_same").isNull()
        if kept is None:
            told = told.select(*EXACT, free.alias("stays"), F.lit(False).alias("goes"))
        else:
            blocked = F.coalesce("kept_forward", "kept_same").isNotNull()
            told = _marked(told, kept, "kept").select(*EXACT, (free & ~blocked).alias("stays"), blocked.alias("goes"))
        told = checkpointed(told)
        more = told.where("stays").select(*EXACT)
        kept = more if kept is None else kept.unionByName(more)
        open_ = told.where("not stays and not goes").select(*EXACT)
    refs = _marked(rows, kept, "kept").select("post_id", F.col("kept_forward").alias("forward_ref"), F.col("kept_same").alias("hash_ref"))
    return refs.select("post_id", F.coalesce("forward_ref", "hash_ref").isNull().alias("kept"), "forward_ref", "hash_ref")


def hash_matches(signals_: DataFrame) -> DataFrame:
    """(post_id, hash_ref): the first post with the same normalised text. Texts are normalised once, for both sides of the join and for the condition."""
    known = stored(signals_.select("post_id", "text_hash")).where("text_hash is not null")
    first = known.groupBy("text_hash").agg(F.min("post_id").alias("hash_ref"))
    return known.join(first, "text_hash").where("hash_ref < post_id").select("post_id", "hash_ref")


def _classes(rows: DataFrame, key: str) -> DataFrame:
    """One row for each distinct value of ``key``: the least post that has it."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("post_id").alias("rep"))


def near_text_matches(rows: DataFrame, least: float = NEAR_TEXT) -> DataFrame:
    """(post_id, near_ref, similarity): the most similar earlier post, the first of equals.

    Posts with one token set are one class, told by the set's SHA-256, and only the first of a class meets other classes: to the
    others the first is the nearest, as different sets are less alike than equal ones.
    """
    keyed = stored(rows.where(F.size("tokens") > 0).select("post_id", F.array_sort("tokens").alias("tokens")).withColumn("set", F.sha2(F.array_join("tokens", " "), 256)))
    members = keyed.select("post_id", "set").join(_classes(keyed, "set"), "set")
    own = checkpointed(members.where("rep < post_id").select("post_id", F.col("rep").alias("ref"), F.lit(1.0).alias("similarity")))
    pairs = token_join(among(keyed, own, "post_id", "left_anti"), "post_id", "tokens", least)
    other = pairs.select(F.col("b").alias("post_id"), F.col("a").alias("ref"), "similarity")
    best = own.unionByName(other).groupBy("post_id").agg(F.max(F.struct("similarity", (-F.col("ref")).alias("r"))).alias("m"))
    return best.select("post_id", (-F.col("m.r")).alias("near_ref"), F.col("m.similarity").alias("similarity"))


def image_matches(rows: DataFrame, most: int = HAMMING) -> DataFrame:
    """(post_id, image_ref, distance): the earlier post with the nearest image hash, the first of equals."""
    classes = _classes(rows, "phash")
    pairs = hash_join(classes, "rep", "phash", most)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    members = rows.where("phash is not null").select("post_id", "phash").join(classes, "phash").select("post_id", "rep")
    own = members.where("rep < post_id").select("post_id", F.col("rep").alias("ref"), F.lit(0).alias("distance"))
    other = members.join(both, F.col("rep") == F.col("a")).where("b < post_id").select("post_id", F.col("b").alias("ref"), "distance")
    best = own.unionByName(other).groupBy("post_id").agg(F.min(F.struct("distance", "ref")).alias("m"))
    return best.select("post_id", F.col("m.ref").alias("image_ref"), F.col("m.distance").alias("distance"))


def phone_matches(rows: DataFrame) -> DataFrame:
    """(post_id, phone_ref): the first earlier post with any phone number in common."""
    phones = rows.select("post_id", F.explode("phones").alias("phone"))
    first = phones.groupBy("phone").agg(F.min("post_id").alias("ref"))
    return phones.join(first, "phone").where("ref < post_id").groupBy("post_id").agg(F.min("ref").alias("phone_ref"))


def decide(posts: DataFrame) -> DataFrame:
    """(post_id, decision, reasons, reference) for every post, as if they came one by one."""
    rows = stored(signals(posts))
    exact = checkpointed(kept_in_order(rows))
    open_ = rows.join(exact.where("kept").select("post_id"), "post_id", "left_semi")
    told = exact
    for found in (near_text_matches(open_), image_matches(open_), phone_matches(open_)):
        told = told.join(found, "post_id", "left")
    sure = F.col("forward_ref").isNotNull() | F.col("hash_ref").isNotNull()
    maybe = F.coalesce("near_ref", "image_ref", "phone_ref").isNotNull()
    reasons = F.when(F.col("forward_ref").isNotNull(), F.array(F.lit("forward_origin"))).when(F.col("hash_ref").isNotNull(), F.array(F.lit("text_hash"))).otherwise(
        F.array_compact(F.array(F.when(F.col("near_ref").isNotNull(), F.lit("near_text")), F.when(F.col("image_ref").isNotNull(), F.lit("phash")), F.when(F.col("phone_ref").isNotNull(), F.lit("phone"))))
    )
    decision = F.when(sure, "high_confidence_duplicate").when(maybe, "needs_reviewable_signal").otherwise("proceed_to_ai")
    return told.select("post_id", decision.alias("decision"), F.array_join(reasons, ",").alias("reasons"), F.coalesce("forward_ref", "hash_ref", "near_ref", "image_ref", "phone_ref").alias("reference"))
