"""Text and JSON forms of the summaries; a few lines each, rendered from collected totals."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ReduceConfig
from ..functions import scalars as fn
from ..operators.kernel import Lexicon, estimate_tokens, reduce_text
from . import analytics

#: History rows that a text report shows at most; JSON shows all.
SHOWN = 20
SAMPLE = "I would really appreciate it if you could please carefully review the changes"


def _counts(df: DataFrame) -> DataFrame:
    for c in ("tokens_in", "tokens_out", "tokens_saved"):
        df = df.withColumn(f"{c}_text", fn.human_count(c))
    return df


def _json(out: dict, **lists: list[dict]) -> str:
    return json.dumps(out | {k: v for k, v in lists.items() if v}, indent=2, ensure_ascii=False)


def gain_json(events: DataFrame, home: str = "", order: list[str] | None = None) -> str:
    """Totals and all folders as indented JSON; with ``order``, the columns that order the log, all events too, newest first."""
    out = analytics.totals(events).withColumnRenamed("n", "reductions").first().asDict()
    folders = [r.asDict() for r in analytics.by_folder(events, home).withColumnRenamed("n", "reductions").toLocalIterator()]
    newest = events.orderBy(*[F.desc(c) for c in order]).select("t", "cmd", "before", "after", "dir").toLocalIterator() if order else []
    return _json(out, by_folder=folders, history=[{k: v for k, v in r.asDict().items() if (k, v) != ("dir", "")} for r in newest])


def gain_text(events: DataFrame, order: list[str], home: str = "", with_history: bool = False) -> str:
    """Totals, the folders if there are several, and if wanted the newest events."""
    t = _counts(analytics.totals(events)).first()
    if t["n"] == 0:
        return "no reductions recorded yet"
    lines = [f"{t['n']} reductions", f"  tokens in     {t['tokens_in_text']}", f"  tokens out    {t['tokens_out_text']}", f"  tokens saved  {t['tokens_saved_text']} ({t['saved_pct']}%)"]
    folders = list(_counts(analytics.by_folder(events, home)).toLocalIterator())
    if len(folders) > 1:
        lines += ["", "by folder:", *[f"  {f['dir']:<40} {f['n']:>4} reductions  saved {f['tokens_saved_text']} ({f['saved_pct']}%)" for f in folders]]
    if with_history:
        rows = analytics.with_saved(analytics.history(events, order, SHOWN).withColumns({"tokens_in": F.col("before"), "tokens_out": F.col("after")}))
        rows = _counts(rows).withColumn("when", F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd HH:mm"))
        lines += ["", "history (newest first):"]
        lines += [f"  {r['when']}  {r['cmd']:<6} {r['tokens_in_text']:>7} -> {r['tokens_out_text']:<7}  saved {r['tokens_saved_text']} ({r['saved_pct']}%)  {r['dir']}" for r in rows.collect()]
        if t["n"] > SHOWN:
            lines.append(f"  ... {t['n'] - SHOWN} older")
    return "\n".join(lines)


def discover_json(found: DataFrame, all_roles: bool = False, home: str = "") -> str:
    """Totals of projects and each project as indented JSON."""
    names = {"tokens_out": "would_be_out", "tokens_saved": "would_save"}
    out = analytics.project_totals(found).withColumnsRenamed(names).first().asDict()
    rows = found.withColumn("dir", fn.short_dir("dir", home)).drop("sessions").withColumnsRenamed(names)
    return _json(out | {"roles": fn.roles_label(all_roles)}, by_project=[r.asDict() for r in rows.toLocalIterator()])


def discover_text(found: DataFrame, all_roles: bool = False, home: str = "") -> str:
    """Totals of projects, and the projects if there are several."""
    t = _counts(analytics.project_totals(found)).withColumn("messages_text", fn.human_count("messages")).first()
    if t["messages"] == 0:
        return "no reducible text found"
    lines = [f"{t['sessions']} sessions", f"  messages       {t['messages_text']} reducible ({fn.roles_label(all_roles)})", f"  tokens in      {t['tokens_in_text']}"]
    lines += [f"  would be out   {t['tokens_out_text']}", f"  would save     {t['tokens_saved_text']} ({t['saved_pct']}%)"]
    rows = list(_counts(found.withColumn("dir", fn.short_dir("dir", home))).withColumn("messages_text", fn.human_count("messages")).toLocalIterator())
    if len(rows) > 1:
        lines += ["", "by project:", *[f"  {r['dir']:<40} {r['messages_text']:>6} msgs  saved {r['tokens_saved_text']} ({r['saved_pct']}%)" for r in rows]]
    return "\n".join(lines)


def doctor(config: ReduceConfig, lexicon: Lexicon = Lexicon(), events: DataFrame | None = None, sessions: DataFrame | None = None) -> tuple[int, str]:
    """The number of problems, and lines on the level, the logs and a sample that must get cheaper."""
    before, after = estimate_tokens(SAMPLE), estimate_tokens(reduce_text(SAMPLE, config, lexicon)[0])
    lines = [f"  level {config.level} ({fn.roles_label(config.all_roles)})"]
    lines += [f"  gain log: {events.count()} events"] if events is not None else []
    lines += [f"  {sessions.select('path').distinct().count()} session logs"] if sessions is not None else []
    if after < before:
        return 0, "\n".join([*lines, f"  {before} -> {after} tokens ({(before - after) * 100 // before}% smaller)", "healthy"])
    return 1, "\n".join([*lines, f"  the sample did not get cheaper ({before} -> {after})", "1 problem(s) found"])
