"""Native column expressions: token cost, guards, literals, filler, arrows, classes, terms and formats.

Everything here stays inside the JVM. Nulls give null unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lex
from . import patterns as pat

LEVELS = ("lite", "full", "ultra")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def fields(text) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(_col(text), f"[{pat.WHITE}]+"), lambda f: f != "")


def estimate_tokens(text) -> Column:
    """Estimated token cost: an ASCII word costs one and one more per five characters, any other word its characters; at least 1."""
    cost = lambda f: F.when(F.octet_length(f) == F.length(f), F.lit(1) + F.floor(F.length(f) / 5)).otherwise(F.length(f)).cast("bigint")
    return F.greatest(F.lit(1).cast("bigint"), F.aggregate(fields(text), F.lit(0).cast("bigint"), lambda n, f: n + cost(f)))


def smaller(a, b) -> Column:
    """Whether ``a`` costs fewer tokens than ``b``, or as many in fewer bytes."""
    a, b = _col(a), _col(b)
    return F.struct(estimate_tokens(a), F.octet_length(a)) < F.struct(estimate_tokens(b), F.octet_length(b))


def protect_literals(text) -> Column:
    """struct<stripped, literals>: code, links, paths and identifiers cut out, pattern by pattern, and each once."""
    out = F.struct(_col(text).alias("stripped"), F.array().cast("array<string>").alias("literals"))
    for p in pat.PROTECTED.values():
        out = let(out, _protecting(pat.jvm(p)))
    return let(out, lambda s: F.struct(s["stripped"].alias("stripped"), F.array_distinct(s["literals"]).alias("literals")))


def _protecting(p: str):
    return lambda s: F.struct(
        F.regexp_replace(s["stripped"], p, " ").alias("stripped"),
        F.concat(s["literals"], F.regexp_extract_all(s["stripped"], F.lit(p), F.lit(0))).alias("literals"),
    )


def strip_words(text, *names: str) -> Column:
    """The text without the given kinds of filler (names of this module's patterns, in order)."""
    work = _col(text)
    for n in names:
        work = F.regexp_replace(work, pat.jvm(getattr(pat, n)), "")
    return work


def compress_prose(text) -> Column:
    """All filler out and spacing tidied; the upper case of sentence heads is the kernel's."""
    work = strip_words(text, "LEADERS", "PLEASANTRIES", "HEDGES", "FILLERS", "ARTICLES")
    work = F.regexp_replace(work, pat.jvm(pat.MANY_SPACES), " ")
    work = F.regexp_replace(work, pat.jvm(pat.SPACE_BEFORE_MARK), "$1")
    work = F.regexp_replace(work, pat.jvm(pat.MANY_BREAKS), "\n\n")
    return trim(work)


def trim(text) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(_col(text), f"^[{pat.WHITE}]+|[{pat.WHITE}]+\\z", "")


def apply_arrows(text) -> Column:
    """Connective phrases become arrows."""
    return F.regexp_replace(_col(text), pat.jvm(pat.ARROW), " -> ")


def cleanup_arrows(text) -> Column:
    """Runs of arrows become one; one at either end goes."""
    work = trim(F.regexp_replace(_col(text), pat.jvm(pat.ARROW_RUN), "-> "))
    work = trim(F.regexp_replace(work, "^->", ""))
    return trim(F.regexp_replace(work, "->\\z", ""))


def classify(word) -> Column:
    """Word class without a dictionary: noun, verb, adj or other."""
    w = _col(word)
    ending = F.lit(False)
    for e in lex.ADJECTIVE_ENDINGS:
        ending = ending | w.endswith(e)
    return F.when(w.isin(lex.CONJUNCTIONS), "other").when(w.isin(lex.VERBS), "verb").when(w.isin(lex.ADJECTIVES) | ending, "adj").otherwise("noun")


def non_plural(word) -> Column:
    """Whether a word in -s is a singular noun."""
    w = _col(word)
    out = w.isin(lex.NON_PLURAL)
    for e in lex.NON_PLURAL_ENDINGS:
        out = out | w.endswith(e)
    return out


def base_forms(word) -> Column:
    """Candidates for the base of an inflected word, best first."""
    w = _col(word)
    n = F.octet_length(w)
    cut = lambda k: F.left(w, F.length(w) - k)
    none = F.array().cast("array<string>")

    def stem(k: int) -> Column:
        root = cut(k)
        twice = (F.length(root) >= 2) & (F.right(root, F.lit(1)) == F.left(F.right(root, F.lit(2)), F.lit(1)))
        return F.concat(F.array(F.concat(root, F.lit("e")), root), F.when(twice, F.array(cut(k + 1))).otherwise(none))

    return (
        F.when(w.endswith("ing") & (n > 4), stem(3))
        .when(w.endswith("ed") & (n > 3), stem(2))
        .when(non_plural(w), none)
        .when(w.endswith("ies") & (n > 4), F.array(F.concat(cut(3), F.lit("y")), cut(1)))
        .when(w.endswith("ss"), none)
        .when(w.endswith("es") & (n > 3), F.array(cut(2), cut(1)))
        .when(w.endswith("s") & (n > 3), F.array(cut(1)))
        .otherwise(none)
    )


def lemma(word) -> Column:
    """The base of an irregular form, else the word. The table is read only for words that are in it."""
    w = _col(word)
    table = F.create_map(*[F.lit(x) for pair in lex.IRREGULAR.items() for x in pair])
    return F.when(w.isin(list(lex.IRREGULAR)), F.element_at(table, w)).otherwise(w)


def normal_terms(text) -> Column:
    """Terms of a text in order: split at marks and blanks, trimmed, in lower case, without apostrophes; arrows stay."""
    raw = F.filter(F.split(_col(text), r"[.!?\n\t ,;:]+"), lambda w: w != "")
    return F.transform(raw, lambda w: F.when(w == "->", w).otherwise(F.replace(F.lower(F.btrim(w, F.lit(lex.TERM_EDGES))), F.lit("'"), F.lit(""))))


def is_content(word, level: str = "full") -> Column:
    """Whether a normal term survives a level: no stop word, no mere punctuation, of a class that the level keeps."""
    w = _col(word)
    stop = lex.STOP_WORDS + (lex.ULTRA_STOP_WORDS if level == "ultra" else [])
    keep = (F.octet_length(w) >= 2) & ~w.isin(sorted(set(stop))) & w.rlike("[A-Za-z0-9]")
    if level == "lite":
        return keep
    return keep & classify(w).isin(["noun", "verb"] if level == "ultra" else ["noun", "verb", "adj"])


def term_graph(text, level: str = "full") -> Column:
    """Content terms in order of first appearance, joined by spaces; the level "ultra" merges irregular forms."""
    return graph_of(normal_terms(text), level)


def graph_of(terms: Column, level: str) -> Column:
    """The same from normal terms."""
    kept = F.filter(terms, lambda w: (w == "->") | is_content(w, level))
    if level == "ultra":
        kept = F.transform(kept, lemma)
    # an arrow is never a repetition: it carries its place while the others are made distinct
    marked = F.transform(kept, lambda w, i: F.when(w == "->", F.concat(w, F.lit("\0"), i.cast("string"))).otherwise(w))
    return F.array_join(F.transform(F.array_distinct(marked), lambda w: F.when(w.startswith("->\0"), "->").otherwise(w)), " ")


def guarded(text, candidate) -> Column:
    """The candidate if it is there and smaller, else the text."""
    return let(F.struct(_col(text).alias("t"), _col(candidate).alias("c")), lambda s: F.when((s["c"] != "") & smaller(s["c"], s["t"]), s["c"]).otherwise(s["t"]))


def level_costs(text) -> Column:
    """array<struct<level, before, after>>: token cost of a text and of what each level would leave of it; terms are split once."""
    cost = lambda g: F.struct(g.alias("g"), estimate_tokens(g).alias("c"), F.octet_length(g).alias("b"))

    def at(level: str, s: Column) -> Column:
        def after(x: Column) -> Column:
            better = (x["g"] != "") & (F.struct(x["c"], x["b"]) < F.struct(s["c"], s["b"]))
            return F.struct(F.lit(level).alias("level"), s["c"].alias("before"), F.when(better, x["c"]).otherwise(s["c"]).alias("after"))

        return let(graph_of(s["n"], level), lambda g: let(cost(g), after))

    whole = F.struct(normal_terms(text).alias("n"), estimate_tokens(text).alias("c"), F.octet_length(_col(text)).alias("b"))
    return let(whole, lambda s: F.array(*[at(x, s) for x in LEVELS]))


def heading(line) -> Column:
    """struct<level, name> of a heading of one to four hashes, else null."""
    x = trim(line)
    name = trim(F.regexp_extract(x, r"(?s)^#{1,4}(?!#)(.*)", 1))
    level = F.length(F.regexp_extract(x, r"^(#{1,4})(?!#)", 1))
    return F.when((level > 0) & (name != ""), F.struct(level.cast("bigint").alias("level"), name.alias("name")))


def path_in(line) -> Column:
    """The first code span that holds a slash or a dot, else the first word with a slash that is no link, else ''."""
    x = _col(line)
    code = F.regexp_extract(x, r"(?s)^[^`]*`([^`]+)`", 1)
    bare = F.filter(F.transform(fields(x), lambda w: F.btrim(w, F.lit(",;:()[]{}"))), lambda w: w.contains("/") & ~w.contains("://"))
    return F.when(code.contains("/") | code.contains("."), code).otherwise(F.coalesce(F.get(bare, 0), F.lit("")))


def is_noise(line) -> Column:
    """Table rulers, and lines of more than three bytes of which less than a third are letters or digits."""
    x = _col(line)
    alnum = F.length(F.regexp_replace(x, "[^A-Za-z0-9]", ""))
    return x.startswith("|---") | x.startswith("| --") | ((F.octet_length(x) > 3) & (alnum < F.floor(F.octet_length(x) / 3)))


def join_han(text) -> Column:
    """No white space between Han characters."""
    return F.regexp_replace(_col(text), r"(?<=\p{IsHan})[\t\n\f\r ]+(?=\p{IsHan})", "")


def role_gate(role, all_roles: bool = False) -> Column:
    """Whether messages of a role are reduced."""
    return F.lit(True) if all_roles else _col(role).isNotNull() & _col(role).isin("user", "tool")


def roles_label(all_roles: bool) -> str:
    """The roles whose messages are reduced, in words."""
    return "all roles" if all_roles else "user + tool roles"


def is_chat_path(path) -> Column:
    return _col(path).endswith("/chat/completions") | _col(path).endswith("/messages")


def pct_int(n, total) -> Column:
    """n of total in whole percent, towards zero; 0 if total is not positive."""
    n, total = _col(n), _col(total)
    hundred, by = n.cast("bigint") * 100, F.nullif(total.cast("bigint"), F.lit(0))
    return F.when(total <= 0, F.lit(0)).otherwise((hundred - hundred % by) / by).cast("bigint")


def pct(n, total) -> Column:
    return F.concat(pct_int(n, total).cast("string"), F.lit("%"))


def human_count(n) -> Column:
    """A count with k, m, b or t and at most two decimals, rounded from the binary value."""
    n = _col(n).cast("bigint")
    size = F.abs(n)
    out = n.cast("string")
    for unit, limit in (("k", 1e3), ("m", 1e6), ("b", 1e9), ("t", 1e12)):
        short = F.regexp_replace(F.replace(F.format_number(n / F.lit(limit), 2), F.lit(","), F.lit("")), r"\.?0+$", "")
        out = F.when(size >= F.lit(int(limit)), F.concat(short, F.lit(unit))).otherwise(out)
    return out


def short_dir(path, home: str) -> Column:
    """The home folder as a tilde."""
    p = _col(path)
    return F.when(p.startswith(home), F.concat(F.lit("~"), F.substr(p, F.lit(len(home) + 1)))).otherwise(p) if home else p


def preview(text, size: int = 300) -> Column:
    """One line of at most ``size`` characters."""
    line = F.array_join(fields(text), " ")
    return F.when(F.length(line) > size, F.concat(F.left(line, F.lit(size)), F.lit("..."))).otherwise(line)


def known_dir(path) -> Column:
    return F.coalesce(F.when(_col(path) != "", _col(path)), F.lit("(unknown)"))
