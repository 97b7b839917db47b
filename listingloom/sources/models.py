"""Model calls with fall-backs: several models are tried in order until an answer is good enough."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType


class TransportError(Exception):
    """A call that didn't come through; one that isn't retryable ends the attempts."""

    def __init__(self, message: str, retryable: bool = True):
        super().__init__(message)
        self.retryable = retryable


class MalformedAnswer(ValueError):
    """An answer that can't be read; the next model is tried."""


@dataclass(frozen=True)
class Verdict:
    """Of an answer: its status and why, whether the next model is to be tried, and if so whether this one may be returned should none be better."""

    status: str
    reason: str
    retry: bool
    returnable: bool
    rank: tuple = (0,)


def by_confidence(confidence: float, least: float) -> Verdict:
    """The plain rule: an answer is good from ``least`` on, and of no use below."""
    if confidence >= least:
        return Verdict("success", "confidence_threshold_met", False, True, (confidence,))
    return Verdict("low_confidence", "confidence_below_threshold", True, False, (confidence,))


_ATTEMPT = pa.struct([("model", pa.string()), ("stage", pa.int32()), ("status", pa.string()), ("reason", pa.string()), ("selected", pa.bool_()), ("trigger", pa.string())])
ATTEMPTS = "array<struct<model:string,stage:int,status:string,reason:string,selected:boolean,trigger:string>>"


def answer(text: str, models: list[str], call: Callable[[str, str], str], judge: Callable[[str], Verdict]) -> tuple[str | None, str | None, list[dict]]:
    """(response, model, attempts) of one request.

    The first answer that needs no retry is taken. Else the best of those that may be returned, the first of equals; else nothing. ``trigger`` is the reason
    of the attempt before.
    """
    attempts: list[dict] = []
    valid: list[tuple[tuple, int, str]] = []
    for stage, model in enumerate(models):
        told = {"model": model, "stage": stage, "selected": False, "trigger": attempts[-1]["reason"] if attempts else None}
        try:
            response = call(model, text)
            verdict = judge(response)
            attempts.append(told | {"status": verdict.status, "reason": verdict.reason, "selected": not verdict.retry})
            if not verdict.retry:
                return response, model, attempts
            if verdict.returnable:
                valid.append((verdict.rank, -stage, response))
        except TransportError as e:
            attempts.append(told | {"status": "failed", "reason": "retryable_transport_error" if e.retryable else "non_retryable_transport_error"})
            if not e.retryable:
                break
        except ValueError as e:
            attempts.append(told | {"status": "failed", "reason": "malformed_response" if isinstance(e, MalformedAnswer) else "model_error"})
    if not valid:
        return None, None, attempts
    _, stage, response = max(valid, key=lambda v: v[:2])
    attempts[-stage]["selected"] = True
    return response, models[-stage], attempts


def complete(rows: DataFrame, models: list[str], call: Callable[[str, str], str], judge: Callable[[str], Verdict], text_col: str = "text") -> DataFrame:
    """rows with response, model and attempts (ATTEMPTS) of an injected ``call(model, text)``, in Arrow batches.

    Calls are made where the rows are; a task that is lost makes its calls again. A null text is asked for as an empty one. Errors other than
    TransportError and ValueError end the job.
    """
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [answer(text or "", models, call, judge) for text in b.column(at).to_pylist()]
            response, model, attempts = zip(*told) if told else ((), (), ())
            columns = [pa.array(response, pa.string()), pa.array(model, pa.string()), pa.array(attempts, pa.list_(_ATTEMPT))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, "response", "model", "attempts"])

    shape = StructType([*rows.schema, StructField("response", StringType()), StructField("model", StringType()), StructField("attempts", StructType.fromDDL(f"a {ATTEMPTS}")["a"].dataType)])
    return rows.mapInArrow(run, shape)
