"""The reduction kernel on worked examples, and against the native expressions."""

import pytest
from pyspark.sql import functions as F

from parsimony.config import ReduceConfig, default_on, is_true
from parsimony.functions import lexicon as lex
from parsimony.functions import scalars as fn
from parsimony.operators import kernel

FOX = "The quick brown fox jumps over the lazy dog. The dog was not amused by the quick fox."
WORDS = "go run fox jump create use test move stop company movie box see server child show belly abdomen demonstrate".split()
KNOWN = kernel.Lexicon(
    classes={w: "verb" if w in ("go", "run", "jump", "create", "use", "test", "move", "stop", "see", "show", "demonstrate") else "noun" for w in WORDS},
    synonyms={"abdomen": "belly", "demonstrate": "show", "fox": "run"},
    script={"fox": "狐", "run": "走", "go": "行"},
)


def reduce(text, level="full", lexicon=kernel.Lexicon(), **more):
    return kernel.reduce_text(text, ReduceConfig(level, **more), lexicon)[0]


def test_worked_trace():
    assert reduce("Please, I think you should just use the tool.") == "Use tool"
    assert kernel.estimate_tokens("Please, I think you should just use the tool.") == 13
    assert reduce("The quick brown fox jumps over the lazy dog.", "ultra") == "Fox jumps dog"


def test_pass_through():
    assert reduce("fox jump dog") == "Fox jump dog" or reduce("fox jump dog") == "fox jump dog"
    assert reduce("fox jump dog", filler=False) == "fox jump dog"


@pytest.mark.parametrize("level", ["lite", "full", "ultra"])
def test_content_stays_and_cost_falls(level):
    out = reduce(FOX, level)
    assert "fox" in out.lower() and "dog" in out.lower()
    assert kernel.estimate_tokens(out) < kernel.estimate_tokens(FOX)


def test_passes():
    text = "# Alpha\nThe server uses the cache.\n# Beta\nThe cache serves the server really well."
    costs = [kernel.estimate_tokens(reduce(text, passes=n)) for n in (1, 2, 0)]
    assert costs == sorted(costs, reverse=True)
    assert reduce(reduce(text)) == reduce(text) or kernel.estimate_tokens(reduce(reduce(text))) <= kernel.estimate_tokens(reduce(text))


@pytest.mark.parametrize("literal", ["https://example.org/a/b?c=1", "src/pkg/main.go", "`code span`", "```\nx = 1\n```", "MAX_SIZE", "fs.read()", "1.2.3"])
def test_literals_survive(literal):
    assert literal in reduce(f"Please see {literal} for the details of the tool.", "ultra")


def test_bare_integers():
    out = kernel.shrink_prose("keep 0 and 1 near a.b and the 2")
    assert out.startswith("Keep 0 and 1 near a.b and 2")


@pytest.mark.parametrize(("text", "clean"), [("-> a -> -> b ->", "a -> b"), ("a -> b", "a -> b"), ("->", ""), ("", ""), ("->  ->  x", "x")])
def test_cleanup_arrows(text, clean):
    assert kernel.cleanup_arrows(text) == clean


def test_arrows():
    text = "The cache miss leads to a database query which results in latency"
    assert "->" in reduce(text) and "->" not in reduce(text, arrows=False)
    assert not reduce(text + " leads to").rstrip().endswith("->")


def test_lemma():
    pairs = {"went": "go", "running": "run", "creating": "create", "using": "use", "stopped": "stop", "moved": "move", "companies": "company", "movies": "movie", "boxes": "box", "servers": "server", "children": "child"}
    assert {w: KNOWN.lemma(w) for w in pairs} == pairs
    assert [KNOWN.lemma(w) for w in ("news", "series", "physics", "virus", "pass", "class", "render")] == ["news", "series", "physics", "virus", "pass", "class", "render"]
    assert kernel.Lexicon().lemma("running") == "running" and kernel.Lexicon().lemma("ran") == "run"
    assert reduce("Fox went. Fox goes. Fox ran, running, runs.", "ultra", KNOWN, filler=False, synonyms=False) == "fox go run"


def test_swaps_need_one_class():
    assert KNOWN.swap("Abdomen demonstrate fox", KNOWN.synonyms) == "belly show fox"
    assert kernel.Lexicon(synonyms={"abdomen": "belly"}).swap("abdomen", {"abdomen": "belly"}) == "abdomen"


def test_script():
    assert KNOWN.to_script("fox run go far") == "狐走行 far"


def test_structure():
    text = "lost before\n# One\nsee `src/a.go` here\nThe big server runs\n```\nin fence\n```\n##### five\n## Two\n|---|---|\nhttps://x.org is **bold** text"
    assert kernel.structure(text, "full", kernel.Lexicon()) == "One\n  src/a.go\n  big server runs\n  Two\n    https //x org bold text\n"
    assert kernel.structure("no heading", "full", kernel.Lexicon()) == ""
    long = "# H\n" + "x" * 70_000 + "\n# Later"
    assert kernel.structure(long, "full", kernel.Lexicon(), 65_536) == "H\n"
    assert kernel.structure(long, "full", kernel.Lexicon()) == "H\n  " + "x" * 70_000 + "\nLater\n"


def test_config():
    assert ReduceConfig("wenyan").base_level == "ultra"
    assert ReduceConfig.from_settings({"level": " Full ", "filler": "off", "all_roles": "yes"}) == ReduceConfig("full", filler=False, all_roles=True)
    assert default_on(None) and not default_on("No") and is_true("on") and not is_true("")
    with pytest.raises(ValueError):
        ReduceConfig("most")


def test_native_equals_kernel(spark):
    words = "running stopped using companies movies boxes news pass sees because although quick readable don't é naïve x -> ran better".split()
    texts = [FOX, "", " ", "Don't stop-me; (now) [please]! 3.14   café 你好", "a -> b -> the a", " ".join(words), "In order to go, I think   it leads to   this ."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for level in fn.LEVELS:
        got = {r.i: r.x for r in df.select("i", fn.term_graph("t", level).alias("x")).collect()}
        assert got == {i: kernel.term_graph(t, level, kernel.Lexicon()) for i, t in enumerate(texts)}
    rows = df.select("t", fn.estimate_tokens("t").alias("n"), fn.protect_literals("t").alias("p"), fn.cleanup_arrows(fn.apply_arrows("t")).alias("a")).collect()
    for r in rows:
        assert r.n == kernel.estimate_tokens(r.t)
        assert (r.p.stripped, r.p.literals) == kernel.protect(r.t)
        assert r.a == kernel.cleanup_arrows(kernel.ARROW.sub(" -> ", r.t))
    w = spark.createDataFrame([(x,) for x in words + list(lex.IRREGULAR)], "w string")
    for r in w.select("w", fn.classify("w").alias("c"), fn.base_forms("w").alias("b"), fn.lemma("w").alias("l")).collect():
        assert (r.c, r.b, r.l) == (kernel.Lexicon().classify(r.w), kernel.base_forms(r.w), kernel.Lexicon().lemma(r.w))


def test_arrow_kernel(spark):
    df = spark.createDataFrame([(0, FOX), (1, None), (2, "")], "i int, t string")
    shipped = kernel.ship(spark, spark.createDataFrame([("fox", "noun")], "word string, class string"))
    rows = {r.i: r.r for r in df.select("i", kernel.reduced("t", ReduceConfig("full"), shipped).alias("r")).collect()}
    assert rows[0].text == kernel.reduce_text(FOX, ReduceConfig("full"))[0] and rows[1].text is None and rows[2].tokens_in == 1


def test_formats(spark):
    counts = {0: "0", 999: "999", 1000: "1k", 1005: "1k", 1234: "1.23k", 1200: "1.2k", 999_999: "1000k", 13_524_093: "13.52m", 100_000_000: "100m", 1_660_000_000_000: "1.66t", -1500: "-1.5k", 125_000_000_000: "125b"}
    df = spark.createDataFrame([(n,) for n in counts], "n long")
    assert {r.n: r.h for r in df.select("n", fn.human_count("n").alias("h")).collect()} == counts
    p = spark.createDataFrame([(150, 400, 37), (0, 0, 0), (-7, 3, -233), (1, 3, 33), (5, -1, 0)], "n long, t long, want long")
    assert all(r.want == r.got for r in p.select("want", fn.pct_int("n", "t").alias("got")).collect())
    d = spark.createDataFrame([("/home/u/x",), ("/home/user",), ("/tmp",), ("",)], "d string")
    assert [r[0] for r in d.select(fn.short_dir("d", "/home/u")).collect()] == ["~/x", "~ser", "/tmp", ""]
    assert d.select(fn.preview(F.lit("a\n b " * 200)).alias("p")).first().p.endswith("...")
