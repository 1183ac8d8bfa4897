"""The data side of services that are asked again and again: polled tasks, and what an interface says it supports."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate, count, takewhile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuetide.operators.folds import fold
from cuetide.params import P


def poll_times(first: float = P.poll_first, most: float = P.poll_most, deadline: float = P.poll_deadline) -> list[float]:
    """Seconds after a task's start at which it is asked about: the pause grows by a second each time, up to a most."""
    pauses = (min(most, first + k) for k in count())
    return list(takewhile(lambda at: at < deadline, accumulate(pauses, initial=0.0)))


#: States in which a task ends, and what they mean.
ENDS = {"SUCCEEDED": "succeeded", "FAILED": "failed", "CANCELED": "canceled"}


def polled(tasks: DataFrame, states: DataFrame, times: list[float] | None = None) -> DataFrame:
    """tasks: task. states: task, at (seconds after its start), status, as the service changed them. (task, outcome, polls,
    ended): what the first poll that saw an end saw, how many there were until then, and when. A state counts for a poll if
    it is the latest at that time, so one that was replaced between two polls is never seen. Tasks without an end before the
    deadline are `timed_out` after all polls. Of states of one time the last in the alphabet counts."""
    times = poll_times() if times is None else times
    at = F.array(*[F.lit(float(t)) for t in times])
    upto = F.lead("at").over(Window.partitionBy("task").orderBy("at"))
    latest = states.groupBy("task", "at").agg(F.max("status").alias("status"))
    spans = latest.withColumn("until", upto).where(F.col("status").isin(*ENDS))
    poll = F.size(F.filter(at, lambda t: t < F.col("at"))) + 1
    seen = spans.withColumn("poll", poll).where(F.col("poll") <= len(times)).withColumn("ended", F.element_at(at, F.col("poll")))
    seen = seen.where(F.col("until").isNull() | (F.col("until") > F.col("ended")))
    first = seen.groupBy(F.col("task").alias("_t")).agg(F.min(F.struct("poll", "ended", "status")).alias("x"))
    named = F.create_map(*[F.lit(x) for pair in ENDS.items() for x in pair])
    both = tasks.join(first, F.col("task") == F.col("_t"), "left").drop("_t")
    return both.select(*tasks.columns, F.coalesce(F.element_at(named, F.col("x.status")), F.lit("timed_out")).alias("outcome"), F.coalesce("x.poll", F.lit(len(times))).cast("long").alias("polls"), F.col("x.ended").alias("ended"))


def speaker_request(chunks: Column, speakers: Column) -> Column:
    """What a request says of speakers: they are told apart if a medium has one to three chunks; their number goes along if
    it is one that the service takes."""
    apart = (chunks >= 1) & (chunks <= P.speaker_chunks)
    return F.struct(F.coalesce(apart, F.lit(False)).alias("tell_apart"), F.when(apart & speakers.between(2, 100), speakers).alias("speakers"))


def _first(pairs: list[tuple[str, object]]) -> dict:
    """Of members of one name the first counts, as for get_json_object."""
    return dict(reversed(pairs))


def _parsed(text: str | None) -> object:
    """JSON whose numbers stay text; null where it is none."""
    try:
        return json.loads(text or "", object_pairs_hook=_first, parse_int=str, parse_float=str)
    except (ValueError, RecursionError):
        return None


def _pointed(body: object, pointer: str) -> object:
    """What a local JSON pointer (#/a/b) names, or null."""
    for part in pointer[2:].split("/"):
        name = part.replace("~1", "/").replace("~0", "~")
        if isinstance(body, list):
            body = body[int(name)] if name.isascii() and name.isdigit() and len(name) < 10 and int(name) < len(body) else None
        else:
            body = body.get(name) if isinstance(body, dict) else None
    return body


def schema_fields(documents: DataFrame, start: DataFrame) -> DataFrame:
    """documents: doc, body (JSON). start: doc, node (the JSON of a schema in it). (doc, field): the names of the properties of
    these schemas, of those they refer to, of their alternatives (allOf, anyOf, oneOf) and of their items. A schema with a
    reference is only what it refers to. References may form cycles: each is followed once. A document is one row of the
    result's making and is held whole: it meets its schemas by one shuffle, and nothing is broadcast, however small its
    columns look. JSON that doesn't parse, or is nested beyond what the parser takes, has no fields."""

    def step(rows: Iterator[dict]) -> Iterator[tuple]:
        bodies, nodes, seen, fields, doc = [], [], set(), set(), None
        for r in rows:
            doc = r["doc"]
            (bodies if r["whole"] else nodes).append(_parsed(r["json"]))
        while nodes:
            node = nodes.pop()
            if not isinstance(node, dict):
                continue
            ref = node.get("$ref")
            if isinstance(ref, str) and ref.startswith("#/"):
                if ref not in seen:
                    seen.add(ref)
                    nodes += [_pointed(body, ref) for body in bodies]
                continue
            own = node.get("properties")
            fields.update(own if isinstance(own, dict) else ())
            for name in ("allOf", "anyOf", "oneOf"):
                nodes += node[name] if isinstance(node.get(name), list) else ()
            nodes.append(node.get("items"))
        # Halves of surrogate pairs, which JSON may name, are no text.
        yield from ((doc, field) for field in {f.encode("utf-8", "replace").decode() for f in fields})

    whole = documents.where("doc is not null").select("doc", F.col("body").alias("json"), F.lit(True).alias("whole"))
    rows = whole.unionByName(start.select("doc", F.col("node").alias("json"), F.lit(False).alias("whole")))
    return fold(rows, "doc", [], f"doc {documents.schema['doc'].dataType.simpleString()}, field string", step)
