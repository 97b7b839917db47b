"""Review items and source suggestions: state machines as ordered folds, and the routing of decisions."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (status, action) -> next status.
REVIEW = {("pending", "update"): "pending", ("pending", "approve"): "approved", ("pending", "merge"): "merged", ("pending", "reject"): "rejected"}
SUGGESTION = {("new", "submit"): "pending", ("rejected", "submit"): "pending", ("pending", "approve"): "approved", ("pending", "reject"): "rejected"}


def applied_actions(actions: DataFrame, table: Mapping[tuple[str, str], str], start: str, entity: str) -> DataFrame:
    """actions (entity, seq, action, idempotency_key, expected_status) with ``result`` and ``status`` after each.

    In order of seq: a key seen before is a replay, an expected status other than the current one a conflict,
    an action the table lacks refused; else applied. An entity's actions stream in order through a fold whose
    state is its status and its keys; null entities are one.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, status, seen = object(), start, set()
        for b in batches:
            results, states = [], []
            for e, action, key, expected in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if current is None and e is not None or e != current:
                    current, status, seen = e, start, set()
                if key in seen:
                    result = "replayed"
                elif expected is not None and expected != status:
                    result = "conflict"
                elif (status, action) not in table:
                    result = "refused"
                else:
                    result, status = "applied", table[status, action]
                    seen.add(key)
                results.append(result)
                states.append(status)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(results, pa.string()), pa.array(states, pa.string())], [*b.schema.names, "result", "status"])

    rows = actions.select(entity, "seq", "action", "idempotency_key", "expected_status")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(entity).sortWithinPartitions(entity, "seq").mapInArrow(fold, f"{shape}, result string, status string")


def final_status(applied: DataFrame, entity: str) -> DataFrame:
    return applied.groupBy(entity).agg(F.max_by("status", "seq").alias("status"), F.count_if(F.col("result") == "applied").alias("applied"))


def routed(decisions: DataFrame) -> DataFrame:
    """decisions (.., status, decision) with ``route``: listings in review stay there; duplicates merge, doubts go to review, the rest are new parents."""
    route = (
        F.when(F.col("status") == "manual_review", "review").when(F.col("decision").isin("exact_duplicate", "high_confidence_duplicate"), "merge")
        .when(F.col("decision") == "possible_duplicate", "review").otherwise("new_parent")
    )
    return decisions.withColumn("route", route)


def review_items(routed_: DataFrame, existing: DataFrame) -> DataFrame:
    """One item for each (announcement, reason) that is not queued yet."""
    rows = routed_.where("route = 'review'").select("announcement_id", "reason").distinct()
    return rows.join(existing.select("announcement_id", "reason"), ["announcement_id", "reason"], "left_anti")


def queued_reviews(routed_: DataFrame, existing: DataFrame) -> DataFrame:
    """(review_id, announcement_id, reason, status): ``review_items`` as pending items, with an id made of announcement and reason.

    The id is the same each time, so an item that is queued by two runs at once is one item.
    """
    from listingloom.operators.envelopes import name_based_id

    items = review_items(routed_, existing)
    key = F.concat(F.lit("review:"), F.col("announcement_id").cast("string"), F.lit(":"), F.col("reason"))
    return items.select(name_based_id(key).alias("review_id"), "announcement_id", "reason", F.lit("pending").alias("status"))


def decision_log(best: DataFrame, weights: Mapping[str, int]) -> DataFrame:
    """(incoming, candidate, score, decision, breakdown): a line to append for each decision, with all its signals as stored beside it.

    ``best`` has a boolean for each signal; those that it lacks are left out of the breakdown.
    """
    from listingloom.operators.envelopes import breakdown_json

    names = [n for n in weights if n in best.columns]
    reason = lambda n: F.when(F.col(n), f"{n}_matched").otherwise(f"{n}_differs")
    signals = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(weights[n]).alias("weight"), F.coalesce(n, F.lit(False)).alias("matched"), reason(n).alias("reason")) for n in names))
    return best.select("incoming", "candidate", "score", "decision", breakdown_json(signals).alias("breakdown"))


def linked(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(announcement_id, source_count, latest_source_id) of every parent after its children are linked."""
    every = parents.select("announcement_id", "source_id", "created_at").unionByName(children.select(F.col("parent_id").alias("announcement_id"), "source_id", "created_at"))
    total = every.groupBy("announcement_id").agg(F.greatest(F.lit(1), F.count("*")).alias("source_count"), F.max_by("source_id", F.struct("created_at", "source_id")).alias("latest_source_id"))
    return total.join(parents.select("announcement_id"), "announcement_id", "left_semi")


def capped_posts(wanted: DataFrame, most: int) -> DataFrame:
    """(day, kind, seq) -> the posts that are made: the first of each kind and day, at most ``most`` a day."""
    from pyspark.sql import Window

    once = wanted.groupBy("day", "kind").agg(F.min("seq").alias("seq"))
    return once.withColumn("_n", F.row_number().over(Window.partitionBy("day").orderBy("seq"))).where(F.col("_n") <= most).drop("_n")
