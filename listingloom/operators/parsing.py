"""Turning raw posts into listing candidates: cleanup, splitting, signals, scores and policies."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.functions.text import PHONE, candidate_id, compatibility_form, normalise_label
from listingloom.operators.settings import check_pattern

#: Default splits of a digest: before numbered items and at ruled lines (fixed values).
DIGEST_SPLITS = (r"(?m)(?=^\s*#?\d{1,3}[.)]\s+)", r"(?m)^\s*[-=_━]{3,}\s*$")
#: Patterns of the quality signals (fixed values).
SIGNALS = {
    "has_phone": PHONE,
    "has_price": r"(?:\b\d[\d\s.,]{1,12}\s*(?:usd|у\.?\s*е\.?|dollar|доллар|so['ʻ’]?m|сум)\b|[$€]\s*\d)",
    "has_rooms": r"\b(?:[1-9]\d?\s*(?:xona(?:li)?|хон(?:а|али)?|комнат(?:а|ы|ная)?|room(?:s)?))\b",
    "has_real_estate_terms": (
        r"\b(?:kvartira|квартир|xonadon|хонадон|hovli|ҳовли|uy|уй|ijara|ижара|arenda|аренд|sotil|сотил|прода(?:м|ется)|novostroy|новостро)\w*\b"
    ),
}
#: Weights of the signals in hundredths, on top of five (fixed values).
WEIGHTS = {"has_text": 20, "has_phone": 20, "has_price": 20, "has_rooms": 10, "has_real_estate_terms": 15, "has_media": 5}
#: The start of a numbered item, and older names of recipes (fixed values).
NUMBERED = r"^\s*#?\d{1,3}[.)]\s+"
ALIASES = {
    "passthrough": "generic.single_listing", "caption_first": "generic.album_caption", "album_text_merge": "generic.album_caption",
    "single_listing": "generic.single_listing", "digest_blocks": "generic.digest_blocks", "album_caption": "generic.album_caption",
    "mixed_feed": "generic.mixed_feed",
}


@dataclass(frozen=True)
class Recipe:
    """A declarative parser. Patterns are case-insensitive and multi-line."""

    key: str
    family: str = "single_listing"
    version: str = "1"
    strip: tuple[str, ...] = ()
    splits: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    unmatched: str = "drop"
    excluded: str = "drop"
    empty_text: str = "drop"
    min_chars: int = 1
    max_candidates: int = 50
    min_score: int = 0
    below_minimum: str = "quarantine"
    media: str = "auto"
    extra: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for pattern in (*self.strip, *self.splits, *self.include, *self.exclude):
            check_pattern(pattern)


#: The built-in recipes; their patterns are fixed values.
RECIPES = {
    r.key: r
    for r in (
        Recipe("generic.single_listing", empty_text="emit"),
        Recipe("generic.album_caption", "album_caption", empty_text="emit"),
        Recipe(
            "generic.digest_blocks", "digest_blocks", splits=DIGEST_SPLITS, unmatched="quarantine",
            include=(r"(?:\+?998[\s()\-]*)?(?:\d[\s()\-]*){9,12}", r"(?:\$\s*\d|\b\d[\d\s.,]{1,12}\s*(?:usd|dollar|so['ʻ’]?m)\b)", r"\b[1-9]\d?\s*(?:xona(?:li)?|room(?:s)?)\b", r"\b(?:kvartira|xonadon|hovli|uy|ijara|arenda|sotil)\w*\b"),
        ),
        Recipe(
            "generic.mixed_feed", "mixed_feed", unmatched="quarantine", excluded="drop",
            include=(r"\b(?:kvartira|квартир|xonadon|хонадон|hovli|ҳовли|uy|уй)\w*\b", r"\b(?:ijara|ижара|arenda|аренд|sotil|сотил|прода(?:м|ется))\w*\b"),
            exclude=(r"\b(?:reklama|реклама|ish\s+qidir|работ[ау]|vakansi|ваканси)\w*\b", r"\b(?:kredit|кредит|kurs|курс)\w*\b"),
        ),
    )
}


def _flags(pattern: str) -> str:
    return "(?imU)" + re.sub(r"^\(\?[a-z]+\)", "", pattern)


def resolve_recipe(requested: Column, bound: Column, fallback: str = "generic.single_listing") -> Column:
    """The recipe key of an event: its own request, else its source's binding, by alias; unknown ones fall back."""
    names = F.create_map(*(F.lit(x) for pair in (ALIASES | {k: k for k in RECIPES}).items() for x in pair))
    asked = F.coalesce(F.nullif(F.trim(requested), F.lit("")), F.nullif(F.trim(bound), F.lit("")))
    return F.coalesce(F.try_element_at(names, asked), F.lit(fallback))


def cleaned(text: Column, recipe: Recipe) -> Column:
    """Line ends, no-break spaces, compatibility form, zero-width characters, boilerplate, blanks."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\u00a0", " ")
    out = F.regexp_replace(compatibility_form(out), "[\u200b\u200c\u200d\ufeff]", "")
    for pattern in recipe.strip:
        out = F.regexp_replace(out, _flags(pattern), "")
    out = F.regexp_replace(F.regexp_replace(out, "[^\\S\r\n]+", " "), "\n\\s*\n(?:\\s*\n)+", "\n\n")
    return F.regexp_replace(out, "^\\s+|\\s+$", "")


def _splitter(pattern: str):
    return lambda chunk: F.split(chunk, _flags(pattern))


def segments(text: Column, recipe: Recipe) -> Column:
    """Blocks of a cleaned text by successive splits; a split that divides nothing changes nothing."""
    chunks = F.array(text)
    for pattern in recipe.splits:
        parts = F.filter(F.flatten(F.transform(chunks, _splitter(pattern))), lambda p: F.trim(p) != "")
        chunks = F.when(F.size(parts) > F.size(chunks), parts).otherwise(chunks)
    bare = F.transform(chunks, lambda c: F.regexp_replace(c, "^\\s+|\\s+$", ""))
    return F.filter(bare, lambda c: F.length(c) >= recipe.min_chars)


def matches(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns match."""
    out = F.lit(0)
    for p in patterns:
        out = out + text.rlike(_flags(p)).cast("int")
    return out


def signal_columns(text: Column, has_media: Column) -> dict[str, Column]:
    return {"has_text": F.trim(text) != ""} | {k: text.rlike(_flags(p)) for k, p in SIGNALS.items()} | {"has_media": has_media}


def score(text: Column, has_media: Column, includes: Column) -> Column:
    """In hundredths, an exact integer, at most one hundred."""
    out = F.lit(5) + F.least(F.lit(20), includes * 10)
    for name, present in signal_columns(text, has_media).items():
        out = out + F.when(present, WEIGHTS[name]).otherwise(0)
    return F.least(F.lit(100), out)


def parse(posts: DataFrame, recipe: Recipe) -> DataFrame:
    """posts (post_id, text, has_media) -> one row a segment: (post_id, index, segment, policy, reason, score, candidate_id, with_media).

    A post over max_candidates is quarantined whole; one without any segment has one row with a null segment
    (or an empty one if it has media, or if empty texts are emitted).
    """
    body = posts.select("post_id", "has_media", cleaned(F.col("text"), recipe).alias("clean"))
    none = F.array().cast("array<string>")
    found = body.withColumn("s", segments(F.col("clean"), recipe) if recipe.splits else F.when(F.col("clean") != "", F.array("clean")).otherwise(none))
    found = found.withColumn("s", F.when((F.size("s") == 0) & (F.col("has_media") | F.lit(recipe.empty_text == "emit")), F.array(F.lit(""))).otherwise(F.col("s")))
    over = F.size("s") > recipe.max_candidates
    found = found.withColumn("over", over).withColumn("s", F.when(over, F.array(F.lit(None).cast("string"))).otherwise(F.col("s"))).withColumn("n", F.size("s"))
    numbered = F.transform("s", lambda x: x.rlike(NUMBERED))
    heading = F.lit(recipe.key == "generic.digest_blocks") & (F.col("n") >= 2) & ~F.coalesce(F.get(numbered, F.lit(0)), F.lit(False)) & F.exists(numbered, lambda x: x)
    rows = found.withColumn("heading", heading).select("post_id", "has_media", "over", "n", "heading", F.posexplode_outer("s").alias("index", "segment"))
    seg, media = F.col("segment"), F.col("has_media")
    includes, excludes = matches(seg, recipe.include), matches(seg, recipe.exclude)
    reason = (
        F.when(F.col("over"), "candidate_limit_exceeded").when(seg.isNull(), "empty_text").when(F.col("heading") & (F.col("index") == 0), "digest_preamble")
        .when(excludes > 0, "exclude_marker_matched").when((F.trim(seg) == "") & ~media & (recipe.empty_text != "emit"), "empty_text")
        .when(F.lit(bool(recipe.include)) & (includes == 0) & (F.trim(seg) != ""), "include_marker_missing")
        .when((score(seg, media, includes) < recipe.min_score) & F.lit(recipe.below_minimum != "emit"), "below_minimum_parser_score").otherwise("candidate_accepted")
    )
    policies = {
        "candidate_limit_exceeded": "quarantine", "empty_text": recipe.empty_text, "digest_preamble": "quarantine", "exclude_marker_matched": recipe.excluded,
        "include_marker_missing": recipe.unmatched, "below_minimum_parser_score": recipe.below_minimum, "candidate_accepted": "emit",
    }
    policy = F.create_map(*(F.lit(x) for pair in policies.items() for x in pair))
    with_media = {"all": F.lit(True), "none": F.lit(False), "first_candidate": F.col("index") == 0}.get(recipe.media, F.lit(recipe.family != "digest_blocks") | (F.col("n") == 1))
    told = rows.withColumn("reason", reason).withColumn("score", score(seg, media, includes))
    identifier = candidate_id(F.col("post_id").cast("string"), F.lit(recipe.key), F.lit(recipe.version), F.col("index"), seg)
    return told.select("post_id", "index", "segment", policy[F.col("reason")].alias("policy"), "reason", "score", identifier.alias("candidate_id"), (with_media & media).alias("with_media"))


def outcomes(parsed: DataFrame) -> DataFrame:
    """(post_id, decision, candidates, score): emit if anything was, else quarantine before drop; the least emitted score."""
    emitted = F.col("policy") == "emit"
    totals = parsed.groupBy("post_id").agg(F.count_if(emitted).alias("candidates"), F.count_if(F.col("policy") == "quarantine").alias("q"), F.min(F.when(emitted, F.col("score"))).alias("score"))
    return totals.select("post_id", F.when(F.col("candidates") > 0, "emit").when(F.col("q") > 0, "quarantine").otherwise("drop").alias("decision"), "candidates", "score")


def evaluate(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Multiset comparison of (case_id, text) rows: true and false positives, misses, precision and recall in one row."""
    e = expected.groupBy("case_id", "text").agg(F.count("*").alias("e"))
    a = actual.groupBy("case_id", "text").agg(F.count("*").alias("a"))
    both = e.join(a, ["case_id", "text"], "full_outer").fillna(0, ["e", "a"])
    sums = both.agg(F.sum(F.least("e", "a")).alias("tp"), F.sum(F.greatest(F.col("a") - F.col("e"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("e") - F.col("a"), F.lit(0))).alias("fn"))
    return sums.select("tp", "fp", "fn", F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")).alias("precision"), F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")).alias("recall"))


#: Metrics of a replay and the floor of each (fixed values).
FLOORS = {"precision": 0.95, "recall": 0.95, "decision_accuracy": 0.95, "drop_accuracy": 0.95, "candidate_count_accuracy": 0.95}


def evaluate_cases(cases: DataFrame, decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row a labelled case: decisions and candidate counts, expected and actual, and true and false positives and misses.

    ``cases`` have case_id, decision, texts (array, empty or null without labels) and n (null: unknown); ``decisions`` case_id and decision of the
    parser, ``candidates`` (case_id, text) what it emitted. Texts are compared as multisets in normal form. A case without texts
    counts by number only: its candidates prove neither precision nor recall. Without a number one is expected of an emit.
    """
    labelled = F.coalesce(F.size("texts"), F.lit(-1)) > 0
    stated = cases.select("case_id", F.col("decision").alias("expected_decision"), labelled.alias("labelled"), F.coalesce("texts", F.array().cast("array<string>")).alias("texts"), "n")
    e = stated.where("labelled").select("case_id", F.explode("texts").alias("text")).select("case_id", normalise_label(F.coalesce("text", F.lit(""))).alias("text")).groupBy("case_id", "text").agg(F.count("*").alias("e"))
    a = candidates.select("case_id", normalise_label(F.coalesce("text", F.lit(""))).alias("text")).groupBy("case_id", "text").agg(F.count("*").alias("a"))
    shared = e.join(a, ["case_id", "text"]).groupBy("case_id").agg(F.sum(F.least("e", "a")).alias("tp"))
    found = a.groupBy("case_id").agg(F.sum("a").alias("actual"))
    rows = stated.join(decisions.select("case_id", F.col("decision").alias("actual_decision")), "case_id", "left").join(shared, "case_id", "left").join(found, "case_id", "left")
    expected = F.when(F.col("labelled"), F.size("texts")).otherwise(F.coalesce("n", F.when(F.col("expected_decision") == "emit", 1).otherwise(0))).cast("bigint")
    rows = rows.withColumns({"expected": expected, "actual": F.coalesce("actual", F.lit(0)), "tp": F.when(F.col("labelled"), F.coalesce("tp", F.lit(0))).otherwise(0)})
    over = lambda total: F.when(F.col("labelled"), F.greatest(F.lit(0), F.col(total) - F.col("tp"))).otherwise(0)
    right = F.coalesce(F.col("actual_decision") == F.col("expected_decision"), F.lit(False))
    return rows.select("case_id", "expected_decision", "actual_decision", right.alias("decision_correct"), "labelled", "expected", "actual", "tp", over("actual").alias("fp"), over("expected").alias("fn"))


def report(evaluated: DataFrame) -> DataFrame:
    """One row over ``evaluate_cases``: sums, and the five metrics, null where nothing is to be measured."""
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    negative = F.col("expected_decision") != "emit"
    sums = evaluated.agg(
        F.count("*").alias("cases"), F.count_if("labelled").alias("labelled_cases"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("expected", "actual", "tp", "fp", "fn")),
        F.count_if("decision_correct").alias("right"), F.count_if(negative).alias("negative"), F.count_if(negative & F.col("decision_correct")).alias("dropped"),
        F.count_if(F.col("expected") == F.col("actual")).alias("counted"),
    )
    c = F.col
    return sums.select(
        "cases", "labelled_cases", "expected", "actual", "tp", "fp", "fn", ratio(c("tp"), c("tp") + c("fp")).alias("precision"), ratio(c("tp"), c("tp") + c("fn")).alias("recall"),
        ratio(c("right"), c("cases")).alias("decision_accuracy"), ratio(c("dropped"), c("negative")).alias("drop_accuracy"), ratio(c("counted"), c("cases")).alias("candidate_count_accuracy"),
    )


def failed_gates(metrics: DataFrame, floors: Mapping[str, float]) -> DataFrame:
    """(metric, value, floor) of the metrics that are unknown or below their floor."""
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(v).alias("floor")) for k, v in floors.items())))
    return metrics.select(rows.alias("m")).select("m.*").where("value is null or value < floor")


def merged_binding(old_key: Column, old_config: Column, new_key: Column, new_config: Column) -> tuple[Column, Column]:
    """(key, config) after a patch: a new key drops the old configuration unless it brings its own."""
    key = F.coalesce(new_key, old_key)
    kept = F.when(F.coalesce(new_key, old_key).eqNullSafe(old_key), old_config)
    return key, F.coalesce(new_config, kept)


#: Fields of a parser binding in events and payloads; the mark between a message id and a candidate's place.
BINDING = ("parser_key", "parser_version", "parser_config", "parser_mode")
FANOUT = "::candidate::"


def metadata(event: Mapping[str, Column], payload: Column) -> Column:
    """Struct of BINDING: of an event's columns, its JSON payload and the payload's ``source_parser``, the last that is not empty."""

    def given(value: Column) -> Column:
        return F.nullif(F.nullif(value, F.lit("")), F.lit("{}"))

    def one(name: str) -> Column:
        own = given(event[name]) if name in event else F.lit(None).cast("string")
        return F.coalesce(given(F.get_json_object(payload, f"$.source_parser.{name}")), given(F.get_json_object(payload, f"$.{name}")), own)

    return F.struct(*(one(name).alias(name) for name in BINDING))


def family_shortcut(family: Column) -> Column:
    """(decision, reasons) of the families that no recipe parses; null for the others."""
    told = lambda decision, *reasons: F.struct(F.lit(decision).alias("decision"), F.array(*map(F.lit, reasons)).alias("reasons"))
    buffered = told("buffer", "stateful_buffer_required", "buffer_not_configured")
    return F.when(family == "buffered_thread", buffered).when(family == "custom", told("quarantine", "custom_parser_plugin_required"))


def candidate_key(raw: Column, candidate: Column, preserve_raw: Column) -> Column:
    """The idempotency key of a candidate: its event's own where that is preserved."""
    return F.when(preserve_raw, raw).otherwise(F.concat(raw, F.lit(":candidate:"), candidate))


def fanout_message_id(raw: Column, index: Column) -> Column:
    """The message id of one candidate of a digest; null for a negative place."""
    return F.when(index >= 0, F.concat(raw, F.lit(FANOUT), index.cast("string")))


def by_mode(posts: DataFrame, recipe: Recipe) -> DataFrame:
    """posts (post_id, text, has_media, mode) -> (post_id, kind, index, text).

    active: the emitted candidates. shadow: the post as it is, and an audit row for each parsed segment. disabled,
    and families that need a buffer: the post as it is, so nothing is lost.
    """
    buffered = recipe.family == "buffered_thread"
    parsed = parse(posts.where(F.col("mode").isin("active", "shadow")), recipe).join(posts.select("post_id", "mode"), "post_id")
    kind = F.when((F.col("mode") == "active") & F.lit(not buffered), F.when(F.col("policy") == "emit", "candidate")).when(F.col("mode") == "shadow", "audit")
    told = parsed.select("post_id", kind.alias("kind"), "index", F.col("segment").alias("text")).where("kind is not null")
    whole = posts.where(F.lit(buffered) | ~F.col("mode").eqNullSafe("active")).select("post_id", F.lit("passthrough").alias("kind"), F.lit(0).alias("index"), "text")
    return told.unionByName(whole)
