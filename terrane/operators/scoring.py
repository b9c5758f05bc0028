"""Scoring tasks by an external model: answers checked, explanations reviewed, work resumed."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the answer contract.
STATUSES = ("scored", "insufficient_data")
LONGEST_REASON = 320
HIGHEST_SCORE = 10
#: The words that claim a label, or that a connection lies on every path; the words that take a claim
#: back, and how many characters before it they are looked for.
CLAIMS = {
    "junction": r"\bjunction\b",
    "corridor": r"\bcorridor\b",
    "open": r"\bopen\b",
    "dead_end": r"\bdead[- ]end\b",
    "pocket": r"\bpocket\b",
    "narrow": r"\bnarrow\b",
    "critical": r"\bcritical\b",
    "alternative_route": r"\balternative route\b",
}
NEGATION = r"\b(no|not|without|inactive|unavailable|missing)\b"
LOOK_BACK = 45
NECESSITY = r"\b(mandatory|unavoidable|required on all|every path)\b"
NECESSITY_NEGATION, NECESSITY_LOOK_BACK = r"\b(no|not|without)\b", 30


def answer_problems(status: str = "status", score: str = "score", reason: str = "reason") -> str:
    """SQL of the first rule that an answer breaks, null for a sound one."""
    listed = ", ".join(f"'{s}'" for s in STATUSES)
    return (
        f"case when {status} is null or {status} not in ({listed}) then 'status'"
        f" when {reason} is null or length({reason}) < 1 or length({reason}) > {LONGEST_REASON} then 'reason'"
        f" when {status} = 'scored' and ({score} is null or {score} < 0 or {score} > {HIGHEST_SCORE}) then 'score'"
        f" when {status} <> 'scored' and {score} is not null then 'score' end"
    )


def parsed_answers(replies: DataFrame, text: str = "reply") -> DataFrame:
    """Adds status, score, reason and problem of JSON replies; other keys, wrong types or no JSON are problem 'shape'."""
    shape = F.from_json(text, "status string, score int, reason string", {"mode": "PERMISSIVE"})
    out = replies.withColumn("_a", shape)
    keys = F.expr(f"array_sort(json_object_keys({text}))")
    sound = F.coalesce(keys == F.array(F.lit("reason"), F.lit("score"), F.lit("status")), F.lit(False)) & F.expr(f"coalesce(regexp_like(get_json_object({text}, '$.score'), '^-?[0-9]+$') or get_json_object({text}, '$.score') is null, false)")
    return out.selectExpr("*", "_a.status as status", "_a.score as score", "_a.reason as reason").withColumn("problem", F.when(sound, F.expr(answer_problems())).otherwise(F.lit("shape"))).drop("_a")


def _unnegated(text: str, pattern: str, negation: str, back: int) -> str:
    """Whether some match of ``pattern`` has no negation in the characters before it, by split positions."""
    marked = f"split(regexp_replace({text}, '({pattern})', '\\u0001$1'), '\\u0001')"
    before = f"transform(sequence(1, size({marked}) - 1), i -> right(array_join(slice({marked}, 1, i), ''), {back}))"
    return f"case when size({marked}) < 2 then false else exists({before}, b -> not regexp_like(b, '{negation}')) end"


def review_flags(items: DataFrame, text: str = "reason", levels: str = "levels", proven: str = "mandatory", connection: str = "connection") -> DataFrame:
    """Adds ``flags``: claimed labels that are not active, and 'necessity' where a connection's is claimed but not proven.

    ``levels`` is a map from label to level, ``connection`` whether the item is
    one; a claim counts unless a negation stands in the characters before it.
    """
    low = f"lower(coalesce({text}, ''))"
    parts = [f"case when {_unnegated(low, p, NEGATION, LOOK_BACK)} and coalesce({levels}['{name}'], 'unavailable') not in ('active', 'very') then '{name}' end" for name, p in CLAIMS.items()]
    parts.append(f"case when {_unnegated(low, NECESSITY, NECESSITY_NEGATION, NECESSITY_LOOK_BACK)} and coalesce({connection}, false) and not coalesce({proven}, false) then 'necessity' end")
    quoted = [p.replace("\\b", "\\\\b") for p in parts]
    return items.withColumn("flags", F.expr(f"filter(array({', '.join(quoted)}), f -> f is not null)"))


def task_list(regions: DataFrame, connections: DataFrame) -> DataFrame:
    """Regions and connections as one list of tasks with a kind and an identity."""
    r = regions.select(F.lit("region").alias("kind"), F.col("id").alias("item"), F.to_json(F.struct(*[c for c in regions.columns if c != "id"])).alias("context"))
    c = connections.select(F.lit("connection").alias("kind"), F.concat_ws("|", "a", "b").alias("item"), F.to_json(F.struct(*[c for c in connections.columns if c not in ("a", "b")])).alias("context"))
    return r.unionByName(c)


def remaining(tasks: DataFrame, done: DataFrame, fingerprint: str) -> DataFrame:
    """Tasks without a result under this fingerprint; two results for one task are an error."""
    own = done.where(F.col("fingerprint") == fingerprint)
    twice = own.groupBy("kind", "item").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two results for {twice[0]['kind']} {twice[0]['item']}")
    return tasks.join(own, ["kind", "item"], "left_anti")


def score(tasks: DataFrame, scorer: Callable[[str, str], dict]) -> DataFrame:
    """(kind, item, reply) with the reply of ``scorer(kind, context)`` as JSON; the callable is shipped to the workers."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"kind": f["kind"], "item": f["item"], "reply": [json.dumps(scorer(k, c), allow_nan=False) for k, c in zip(f["kind"], f["context"], strict=True)]})

    return tasks.select("kind", "item", "context").mapInPandas(ask, "kind string, item string, reply string")


def fingerprint(*parts: str) -> str:
    """A digest of what a result depends on, keys sorted."""
    import hashlib

    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()
