"""Streams of chat requests: rewritten record by record, their savings appended to a log.

No state is kept, so every request is its own unit of work and a replay gives the same result.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ReduceConfig
from ..functions import scalars as fn
from ..operators.kernel import Lexicon, estimate_tokens, reduce_text

REQUEST = "path string, body string"
REWRITTEN = "body string, before bigint, after bigint"


def rewrite_body(body: str | None, config: ReduceConfig, lexicon: Lexicon = Lexicon()) -> tuple[str | None, int, int]:
    """The body with the open roles' texts reduced, and their cost before and after; as it was if it is no chat request."""
    try:
        payload = json.loads(body or "")
    except ValueError:
        return body, 0, 0
    if not isinstance(payload, dict) or not isinstance(payload.get("messages"), list):
        return body, 0, 0
    cost = [0, 0]

    def reduced(text: str) -> str:
        out, _ = reduce_text(text, config, lexicon)
        cost[0] += estimate_tokens(text)
        cost[1] += estimate_tokens(out)
        return out

    if config.all_roles and isinstance(payload.get("system"), str):
        payload["system"] = reduced(payload["system"])
    for message in payload["messages"]:
        if not isinstance(message, dict) or not (config.all_roles or message.get("role") in ("user", "tool")):
            continue
        content = message.get("content")
        if isinstance(content, str):
            message["content"] = reduced(content)
        elif isinstance(content, list):
            for part in content:
                if isinstance(part, dict) and isinstance(part.get("text"), str):
                    part["text"] = reduced(part["text"])
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False), cost[0], cost[1]


@lru_cache(maxsize=8)
def _rewriter(config: ReduceConfig, shipped):
    @F.pandas_udf(REWRITTEN)
    def run(bodies: pd.Series) -> pd.DataFrame:
        lexicon = shipped.value if shipped is not None else Lexicon()
        return pd.DataFrame([rewrite_body(b, config, lexicon) for b in bodies], columns=["body", "before", "after"])

    return run


def rewritten(body, config: ReduceConfig, shipped=None) -> Column:
    """struct<body, before, after>."""
    return _rewriter(config, shipped)(F.col(body) if isinstance(body, str) else body)


def rewrite(requests: DataFrame, config: ReduceConfig, shipped=None) -> DataFrame:
    """(path, body, before, after) of a batch or a stream of requests; only chat paths are rewritten."""
    chat = fn.is_chat_path("path")
    done = requests.withColumn("r", rewritten(F.when(chat, F.col("body")), config, shipped))  # other bodies do not leave the JVM
    pick = lambda c, other: F.when(chat, F.col(f"r.{c}")).otherwise(other).alias(c)
    return done.select("path", pick("body", F.col("body")), pick("before", F.lit(0)), pick("after", F.lit(0)))


def gain_rows(rewritten: DataFrame, cmd: str = "proxy", folder: str = "") -> DataFrame:
    """Gain events of rewritten requests; those that cost nothing before are left out."""
    return rewritten.where("before > 0").select(F.unix_timestamp().alias("t"), F.lit(cmd).alias("cmd"), "before", "after", F.lit(folder).alias("dir"))


def append_gain(log: str, cmd: str = "proxy", folder: str = ""):
    """A ``foreachBatch`` function that appends each batch's gain events to a JSON log."""

    def append(batch: DataFrame, _: int) -> None:
        gain_rows(batch, cmd, folder).write.mode("append").json(log)

    return append
