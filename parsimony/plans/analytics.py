"""Savings, realised and potential: totals, by folder or project, and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..sources.logs import session_dirs, session_pieces


def sums() -> list[Column]:
    zero = F.lit(0).cast("bigint")
    return [F.count("*").alias("n"), F.coalesce(F.sum("before"), zero).alias("tokens_in"), F.coalesce(F.sum("after"), zero).alias("tokens_out")]


def with_saved(df: DataFrame) -> DataFrame:
    saved = df.withColumn("tokens_saved", F.col("tokens_in") - F.col("tokens_out"))
    return saved.withColumn("saved_pct", fn.pct_int("tokens_saved", "tokens_in"))


def totals(events: DataFrame) -> DataFrame:
    """One row of sums over (before, after); zeros for no events."""
    return with_saved(events.agg(*sums()))


def by_folder(events: DataFrame, home: str = "") -> DataFrame:
    """Sums by ``dir``, most saved first, then by name; a missing folder is "(unknown)"."""
    grouped = events.groupBy(fn.known_dir("dir").alias("dir")).agg(*sums())
    return with_saved(grouped).orderBy(F.desc("tokens_saved"), "dir").withColumn("dir", fn.short_dir("dir", home))


def history(events: DataFrame, order: list[str], size: int = 20) -> DataFrame:
    """The last ``size`` events, newest first by ``order`` (their place in the log, not their time)."""
    return events.orderBy(*[F.desc(c) for c in order]).limit(size)


def sessions(pieces: DataFrame, all_roles: bool = False) -> DataFrame:
    """(path, before, after, msgs) from pieces (path, role, before, after) of the roles to reduce; sessions without any drop out."""
    open_roles = pieces.where(fn.role_gate("role", all_roles))
    return open_roles.groupBy("path").agg(F.sum("before").alias("before"), F.sum("after").alias("after"), F.count("*").alias("msgs"))


def projects(results: DataFrame) -> DataFrame:
    """Sums by project from (path, cwd, before, after, msgs); a session without a folder belongs to its file's folder."""
    cwd = F.coalesce(F.when(F.col("cwd") != "", F.col("cwd")), F.element_at(F.split("path", "/"), -2))
    kept = results.where("msgs > 0").withColumn("dir", cwd)
    grouped = kept.groupBy("dir").agg(F.count("*").alias("sessions"), F.sum("msgs").alias("messages"), F.sum("before").alias("tokens_in"), F.sum("after").alias("tokens_out"))
    return with_saved(grouped).orderBy(F.desc("tokens_saved"), "dir")


def project_totals(found: DataFrame) -> DataFrame:
    """One row of sums over projects; zeros for none."""
    zero = F.lit(0).cast("bigint")
    return with_saved(found.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("sessions", "messages", "tokens_in", "tokens_out")]))


def discover(lines: DataFrame, price, all_roles: bool = False) -> DataFrame:
    """Projects of session logs (path, line_no, line): what their open messages cost and would cost.

    ``price`` takes pieces with ``text`` and adds ``before`` and ``after``. Roles are selected before any text is priced.
    """
    said = session_pieces(lines).where(fn.role_gate("role", all_roles))
    results = sessions(price(said), all_roles).join(session_dirs(lines), "path", "left")
    return projects(results)
