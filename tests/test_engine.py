"""Sources, analytics, reports, streams, lexicon builders, SQL names, and plans."""

import json

import pytest

from parsimony.config import ReduceConfig
from parsimony.functions import scalars as fn
from parsimony.functions.registration import register
from parsimony.operators import lexbuild
from parsimony.plans import analytics, registry, reports
from parsimony.sources import logs, sinks
from parsimony.streaming import rewrite


@pytest.fixture(scope="module")
def events(spark):
    rows = [(0, 1, "reduce", 100, 40, "/a"), (1, 2, "proxy", 200, 150, "/b"), (2, 3, "reduce", 100, 60, "/a")]
    return spark.createDataFrame(rows, "seq int, t long, cmd string, before long, after long, dir string")


def test_gain(events):
    total = analytics.totals(events).first()
    assert tuple(total) == (3, 400, 250, 150, 37)
    first = analytics.by_folder(events).first()
    assert (first.dir, first.tokens_saved) == ("/a", 100)
    assert [r.t for r in analytics.history(events, ["seq"]).collect()] == [3, 2, 1]
    assert tuple(analytics.totals(events.where("false")).first()) == (0, 0, 0, 0, 0)


def test_reports(events):
    out = json.loads(reports.gain_json(events))
    assert out["reductions"] == 3 and len(out["by_folder"]) == 2
    text = reports.gain_text(events, ["seq"], with_history=True)
    assert "tokens saved  150 (37%)" in text and text.count("->") == 3
    assert reports.gain_text(events.where("false"), ["seq"]) == "no reductions recorded yet"


def test_reports_leave_nothing_out(spark, events):
    many = spark.createDataFrame([(i, i, "reduce", 100 + i, 50, f"/d{i}" if i else "") for i in range(30)], events.schema)
    text = reports.gain_text(many, ["seq"], with_history=True)
    assert all(f"/d{i} " in text for i in range(1, 30)) and "(unknown)" in text and "... 10 older" in text
    out = json.loads(reports.gain_json(many, order=["seq"]))
    assert len(out["by_folder"]) == 30 and [r["t"] for r in out["history"]] == list(range(29, -1, -1)) and "dir" not in out["history"][-1]


def test_discover(spark):
    lines = spark.createDataFrame(registry.SESSIONS, "path string, line_no int, line string")
    found = analytics.discover(lines, registry._priced)
    assert [(r.dir, r.sessions, r.messages) for r in found.orderBy("dir").collect()] == [("/w/a", 1, 3), ("b", 1, 1)]
    out = json.loads(reports.discover_json(found))
    assert (out["sessions"], out["messages"], out["roles"], len(out["by_project"])) == (2, 4, "user + tool roles", 2) and out["would_save"] == out["tokens_in"] - out["would_be_out"]
    text = reports.discover_text(analytics.discover(lines, registry._priced, all_roles=True), all_roles=True)
    assert text.startswith("2 sessions\n  messages       5 reducible (all roles)") and "by project:" in text
    assert reports.discover_text(found.where("false")) == "no reducible text found"


def test_doctor(spark, events):
    problems, text = reports.doctor(ReduceConfig(), events=events)
    assert problems == 0 and "22 -> 8 tokens (63% smaller)" in text and "3 events" in text
    assert reports.doctor(ReduceConfig(filler=False, synonyms=False, gloss=False, arrows=False, passes=1))[0] in (0, 1)


def test_sinks(spark, tmp_path):
    sinks.write_texts(spark.createDataFrame([("a\nb",)], "text string"), "text", str(tmp_path / "t"))
    assert [p.read_text() for p in (tmp_path / "t").glob("part*") if p.stat().st_size] == ["a\nb\0"]
    table = spark.createDataFrame([(f"w{i * 7 % 50:02}", "x") for i in range(50)], "word string, gloss string").repartition(5)
    sinks.write_table(table, str(tmp_path / "l"))
    words = [r.word for p in sorted((tmp_path / "l").glob("*.parquet")) for r in spark.read.parquet(str(p)).collect()]
    assert words == sorted(words) and len(words) == 50


def test_line_order_over_splits(spark, tmp_path):
    """The first folder of a session is found however its file is split."""
    (tmp_path / "s.jsonl").write_text("".join(json.dumps({"type": "user", "cwd": f"/w/{i}" if i else "", "message": {"content": "x" * 50}}) + "\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = logs.log_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 3 and lines.count() == 3000
        assert logs.session_dirs(lines).first().cwd == "/w/1"
        assert [json.loads(r.line)["cwd"][3:] for r in lines.orderBy("line_no").collect()] == ["", *map(str, range(1, 3000))]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_projects(spark):
    rows = [(100, 50, 2, "/a", "l/x/1"), (500, 100, 1, "/b", "l/x/2"), (10, 5, 1, "", "l/proj/3"), (0, 0, 0, "/c", "l/x/4")]
    out = analytics.projects(spark.createDataFrame(rows, "before long, after long, msgs long, cwd string, path string")).collect()
    assert [r.dir for r in out] == ["/b", "/a", "proj"] and sum(r.sessions for r in out) == 3


def test_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "s.jsonl").write_text("\n".join(x[2] for x in registry.SESSIONS[:4]) + "\nnot json\n\n")
    (tmp_path / "a" / "skip.txt").write_text("{}")
    lines = logs.log_lines(spark, str(tmp_path))
    assert lines.count() == 5
    pieces = logs.session_pieces(lines)
    assert sorted(r.role for r in pieces.collect()) == ["assistant", "tool", "tool", "user"]
    assert logs.session_dirs(lines).first().cwd == "/w/a"
    (tmp_path / "d.csv").write_text("\n".join(registry.DICTIONARY))
    assert {r.word: r["class"] for r in lexbuild.classes(logs.dictionary(spark, str(tmp_path / "d.csv"))).collect()}["show"] == "verb"
    assert logs.texts(spark, str(tmp_path / "d.csv")).first().text.startswith("abdomen")
    assert "house" in {r.word for r in lexbuild.headwords(logs.dictionary(spark, str(tmp_path / "d.csv"))).collect()}


BODY = json.dumps({"system": "Please be really nice to the user", "messages": [{"role": "user", "content": "Please just use the tool in the box"}, {"role": "assistant", "content": [{"type": "text", "text": "I think the box is here"}]}, "x"]})


def test_rewrite_body():
    body, before, after = rewrite.rewrite_body(BODY, ReduceConfig("full"))
    out = json.loads(body)
    assert out["system"].startswith("Please") and out["messages"][0]["content"] == "Use tool box" and before > after > 0
    assert json.loads(rewrite.rewrite_body(BODY, ReduceConfig("full", all_roles=True))[0])["messages"][1]["content"][0]["text"] != "I think the box is here"
    assert rewrite.rewrite_body("nope", ReduceConfig()) == ("nope", 0, 0) and rewrite.rewrite_body("{}", ReduceConfig()) == ("{}", 0, 0)


def test_stream(spark, tmp_path):
    spark.createDataFrame([("/v1/messages", BODY), ("/v1/models", BODY)], rewrite.REQUEST).write.json(str(tmp_path / "in"))
    stream = rewrite.rewrite(spark.readStream.schema(rewrite.REQUEST).json(str(tmp_path / "in")), ReduceConfig("full"))
    job = stream.writeStream.foreachBatch(rewrite.append_gain(str(tmp_path / "log"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    log = spark.read.json(str(tmp_path / "log")).collect()
    assert len(log) == 1 and log[0].before > log[0].after


def test_sql_names(spark):
    names = register(spark, ReduceConfig("full"))
    assert "reduce_text" in names
    row = spark.sql("SELECT estimate_tokens('review it') AS n, reduce_text('Please, I think you should just use the tool.') AS t, word_lemma('went') AS l").first()
    assert (row.n, row.t, row.l) == (3, "Use tool", "go")


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = registry.QUERIES["discover_user_tool"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "In(role, [" in plan[plan.index("PushedFilters") :]
    plan = registry.QUERIES["token_cost_by_lang"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string,lang:string>" in plan or "ReadSchema: struct<lang:string,text:string>" in plan
    assert "Python" not in registry.QUERIES["level_savings_by_lang"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_nulls_and_empties(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    rows = df.select(fn.estimate_tokens("t").alias("n"), fn.term_graph("t").alias("g"), fn.role_gate("t").alias("r")).collect()
    assert rows[1].n == 1 and rows[1].g == "" and rows[0].r is False
