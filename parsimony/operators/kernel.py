"""The reduction to a fixpoint, as an Arrow kernel.

Each text repeats its passes until nothing changes, each text as often as it needs, which no
column expression can say. Texts travel in Arrow batches; the lexicon is broadcast once.
The steps of one pass equal the native expressions of ``functions.scalars``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ReduceConfig
from ..functions import lexicon as lex
from ..functions import patterns as pat

MOST_PASSES, MOST_RESTORES = 100, 8
#: Terms that a lexicon remembers.
MEMO = 200_000
WHITE = re.compile(f"[{pat.WHITE}]+")
WHITE_CHARS = "\t\n\x0b\f\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
PROTECTED = [pat.python(p) for p in pat.PROTECTED.values()]
#: What a literal of each kind must hold; a text without it is not searched for that kind.
NEEDED = [("```",), ("`",), ("://",), ("/", "\\"), ("_",), (".",), ("(",), (".",)]
REMOVED = [pat.python(p) for p in (pat.LEADERS, pat.PLEASANTRIES, pat.HEDGES, pat.FILLERS, pat.ARTICLES)]
TIDIED = [(pat.python(pat.MANY_SPACES), " "), (pat.python(pat.SPACE_BEFORE_MARK), r"\1"), (pat.python(pat.MANY_BREAKS), "\n\n")]
HEAD, ARROW, RUN = pat.python(pat.SENTENCE_HEAD), pat.python(pat.ARROW), pat.python(pat.ARROW_RUN)
MARK = re.compile("\0([0-9]+)\0")
LETTERS = re.compile("[A-Za-z]+")
TERM_GAP = re.compile(r"[.!?\n\t ,;:]+")
ALNUM = re.compile("[A-Za-z0-9]")
HAN = "⺀-⿕々〇〡-〩〸-〻㐀-䶿一-鿿豈-﫿\U00020000-\U000323af"
HAN_GAP = re.compile(f"(?<=[{HAN}])[\\t\\n\\f\\r ]+(?=[{HAN}])")
STOP, ULTRA = frozenset(lex.STOP_WORDS), frozenset(lex.STOP_WORDS + lex.ULTRA_STOP_WORDS)
CONJUNCTIONS, VERBS, ADJECTIVES, ENDINGS = frozenset(lex.CONJUNCTIONS), frozenset(lex.VERBS), frozenset(lex.ADJECTIVES), tuple(lex.ADJECTIVE_ENDINGS)
NON_PLURAL, NON_PLURAL_ENDINGS = frozenset(lex.NON_PLURAL), tuple(lex.NON_PLURAL_ENDINGS)
KEPT = {"lite": frozenset(("adj", "noun", "verb", "other")), "ultra": frozenset(("noun", "verb"))}
FULL = frozenset(("adj", "noun", "verb"))


@dataclass(frozen=True)
class Lexicon:
    """User tables: word classes, shorter synonyms, shortest glosses, and Han characters for words. All may be empty."""

    classes: dict[str, str] = field(default_factory=dict)
    synonyms: dict[str, str] = field(default_factory=dict)
    gloss: dict[str, str] = field(default_factory=dict)
    script: dict[str, str] = field(default_factory=dict)
    #: Terms by level and raw form, as far as they are known; bounded.
    memo: dict[tuple[str, str], str] = field(default_factory=dict, compare=False, repr=False)

    def knows(self, word: str) -> bool:
        return word.lower() in self.classes

    def classify(self, word: str) -> str:
        """noun, verb, adj or other; the dictionary's class if it has the word, else by closed lists and endings."""
        if word in CONJUNCTIONS:
            return "other"
        known = self.classes.get(word.lower())
        if known:
            return "other" if known in ("adv", "prep") else known
        if word in VERBS:
            return "verb"
        return "adj" if word in ADJECTIVES or word.endswith(ENDINGS) else "noun"

    def lemma(self, word: str) -> str:
        """The base of an irregular form, else the first base form that the dictionary knows, else the word."""
        if word in lex.IRREGULAR:
            return lex.IRREGULAR[word]
        if self.classes:
            for form in base_forms(word):
                if form != word and self.knows(form):
                    return form
        return word

    def swap(self, text: str, table: dict[str, str]) -> str:
        """Each run of letters by its entry, where both words are known and of one class."""
        if not table or not self.classes:
            return text

        def one(m: re.Match) -> str:
            low = m[0].lower()
            other = table.get(low)
            same = other is not None and self.knows(low) and self.knows(other) and self.classify(low) == self.classify(other)
            return other if same else m[0]

        return LETTERS.sub(one, text)

    def to_script(self, text: str) -> str:
        """Words by their Han characters, and no blanks between Han characters."""
        return HAN_GAP.sub("", LETTERS.sub(lambda m: self.script.get(m[0].lower(), m[0]), text))


def estimate_tokens(text: str) -> int:
    return max(1, sum(1 + len(f) // 5 if f.isascii() else len(f) for f in WHITE.split(text) if f))


def smaller(a: str, b: str) -> bool:
    return (estimate_tokens(a), len(a.encode())) < (estimate_tokens(b), len(b.encode()))


def base_forms(word: str) -> list[str]:
    """Candidates for the base of an inflected word, best first."""
    size = len(word.encode())
    for ending, least in (("ing", 4), ("ed", 3)):
        if word.endswith(ending) and size > least:
            root = word[: -len(ending)]
            doubled = len(root) >= 2 and root[-1] == root[-2]
            return [root + "e", root, *([root[:-1]] if doubled else [])]
    if word in NON_PLURAL or word.endswith(NON_PLURAL_ENDINGS):
        return []
    if word.endswith("ies") and size > 4:
        return [word[:-3] + "y", word[:-1]]
    if word.endswith("ss"):
        return []
    if word.endswith("es") and size > 3:
        return [word[:-2], word[:-1]]
    return [word[:-1]] if word.endswith("s") and size > 3 else []


def possible(text: str) -> list[re.Pattern]:
    return [p for p, needed in zip(PROTECTED, NEEDED, strict=True) if any(n in text for n in needed)]


def protect(text: str) -> tuple[str, list[str]]:
    """The text without its literals, and the literals in pattern order, each once."""
    found: dict[str, None] = {}
    for p in possible(text):
        found |= dict.fromkeys(m[0] for m in p.finditer(text))
        text = p.sub(" ", text)
    return text, list(found)


def compress(text: str) -> str:
    """Filler out, spacing tidied, sentence heads in upper case."""
    for p in REMOVED:
        text = p.sub("", text)
    for p, by in TIDIED:
        text = p.sub(by, text)
    return HEAD.sub(lambda m: m[0].upper(), text).strip(WHITE_CHARS)


def shrink_prose(text: str) -> str:
    """Filler out of all but the literals, which wait behind numbered marks."""
    held: list[str] = []

    def hide(m: re.Match) -> str:
        held.append(m[0])
        return f"\0{len(held) - 1}\0"

    for p in possible(text):
        text = p.sub(hide, text)
    text = compress(text)
    for _ in range(MOST_RESTORES):  # a literal may hold marks itself
        if not held or not MARK.search(text):
            break
        text = MARK.sub(lambda m: held[int(m[1])] if int(m[1]) < len(held) else m[0], text)
    return text


def cleanup_arrows(text: str) -> str:
    text = RUN.sub("-> ", text).strip(WHITE_CHARS)
    return text.removeprefix("->").strip(WHITE_CHARS).removesuffix("->").strip(WHITE_CHARS)


def term_graph(text: str, level: str, lexicon: Lexicon) -> str:
    """Content terms in order of first appearance; ultra merges by lemma."""
    memo = lexicon.memo
    seen: set[str] = set()
    out = []
    for raw in TERM_GAP.split(text):
        if raw == "->":
            out.append(raw)
            continue
        key = memo.get((level, raw))
        if key is None:
            if len(memo) >= MEMO:
                memo.clear()
            key = memo[level, raw] = term_of(raw, level, lexicon)
        if key and key not in seen:
            seen.add(key)
            out.append(key)
    return " ".join(out)


def term_of(raw: str, level: str, lexicon: Lexicon) -> str:
    """What a raw term counts as at a level, '' if it is dropped."""
    term = raw.strip(lex.TERM_EDGES).lower().replace("'", "")
    if len(term.encode()) < 2 or term in (ULTRA if level == "ultra" else STOP) or not ALNUM.search(term) or lexicon.classify(term) not in KEPT.get(level, FULL):
        return ""
    return lexicon.lemma(term) if level == "ultra" else term


def heading(line: str) -> tuple[int, str] | None:
    level = len(line) - len(line.lstrip("#"))
    name = line[level:].strip(WHITE_CHARS)
    return (level, name) if 1 <= level <= 4 and name else None


def path_in(line: str) -> str:
    """The first code span with a slash or a dot, else the first word with a slash that is no link."""
    pieces = line.split("`", 2)
    if len(pieces) == 3 and pieces[1] and ("/" in pieces[1] or "." in pieces[1]):
        return pieces[1]
    words = (w.strip(",;:()[]{}") for w in WHITE.split(line))
    return next((w for w in words if "/" in w and "://" not in w), "")


def is_noise(line: str) -> bool:
    size = len(line.encode())
    return line.startswith(("|---", "| --")) or size > 3 and len(ALNUM.findall(line)) < size // 3


def lines_of(text: str, longest: int | None = None) -> list[str]:
    """Lines without blanks around them; with ``longest``, as a reader with a buffer of so many bytes sees them: a line that does not fit ends the text."""
    out = []
    for line in text.split("\n"):
        if longest is not None and len(line.encode()) >= longest:
            break
        out.append(line.removesuffix("\r").strip(WHITE_CHARS))
    return out


UNMARKED = str.maketrans("", "", "*_`")


def structure(text: str, level: str, lexicon: Lexicon, longest: int | None = None) -> str:
    """Headings with their paths and the terms of their bodies, indented; '' without headings. Text before the first heading and in code fences goes."""
    sections: list[tuple[int, str, list[str], list[str]]] = []
    in_code = False
    for line in lines_of(text, longest):
        if line.startswith("```"):
            in_code = not in_code
        elif in_code:
            continue
        elif (h := heading(line)) is not None:
            sections.append((*h, [], []))
        elif sections:
            if path := path_in(line):
                sections[-1][2].append(path)
            elif line and not line.startswith("#") and not is_noise(line):
                sections[-1][3].append(line.translate(UNMARKED))
    out = []
    for depth, name, paths, body in sections:
        indent = "  " * (depth - 1)
        terms = term_graph(" ".join(body), level, lexicon)
        out += [f"{indent}{name}\n", *[f"{indent}  {p}\n" for p in paths], *([f"{indent}  {terms}\n"] if terms else [])]
    return "".join(out)


def to_graph(text: str, level: str, lexicon: Lexicon, longest: int | None = None) -> str:
    out = structure(text, level, lexicon, longest) or term_graph(text, level, lexicon)
    return out if out and smaller(out, text) else text


def reduce_text(text: str, config: ReduceConfig, lexicon: Lexicon = Lexicon()) -> tuple[str, int]:
    """The reduced text and the number of passes that changed it."""
    level = config.base_level
    out, literals = protect(text)
    changed = 0
    for _ in range(config.passes if config.passes > 0 else MOST_PASSES):
        step = ARROW.sub(" -> ", out) if config.arrows else out
        step = shrink_prose(step) if config.filler else step
        step = lexicon.swap(step, lexicon.synonyms) if config.synonyms else step
        step = lexicon.swap(step, lexicon.gloss) if config.gloss else step
        step = to_graph(step, level, lexicon, config.longest_line)
        if step == out:
            break
        out, changed = step, changed + 1
    out = cleanup_arrows(out) if config.arrows else out
    out = lexicon.to_script(out) if config.level == "wenyan" else out
    if not literals:
        return out, changed
    kept = " ".join(literals)
    return (f"{out.rstrip(chr(10) + ' ')} {kept}" if out.strip(WHITE_CHARS) else kept), changed


SCHEMA = "text string, tokens_in bigint, tokens_out bigint, passes int"


@lru_cache(maxsize=8)
def _kernel(config: ReduceConfig, shipped):
    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        lexicon = shipped.value if shipped is not None else Lexicon()
        rows = []
        for t in texts:
            if t is None:
                rows.append((None, None, None, None))
                continue
            out, passes = reduce_text(t, config, lexicon)
            rows.append((out, estimate_tokens(t), estimate_tokens(out), passes))
        return pd.DataFrame(rows, columns=["text", "tokens_in", "tokens_out", "passes"])

    return run


def reduced(text, config: ReduceConfig, shipped=None) -> Column:
    """struct<text, tokens_in, tokens_out, passes> of a text column; null stays null. ``shipped`` is a broadcast ``Lexicon``."""
    return _kernel(config, shipped)(F.col(text) if isinstance(text, str) else text)


def shrunk(text: str) -> Column:
    """One pass of filler removal with literals held back."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else shrink_prose(t))

    return run(F.col(text))


def structured(text: str, level: str = "full") -> Column:
    """Headings, paths and terms of a structured text, '' without headings."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else structure(t, level, Lexicon()))

    return run(F.col(text))


#: Entries up to which a lexicon table is broadcast.
LEXICON_ENTRIES = 2_000_000


def ship(spark: SparkSession, classes: DataFrame | None = None, synonyms: DataFrame | None = None, gloss: DataFrame | None = None, script: DataFrame | None = None):
    """A broadcast lexicon from tables (word, class) and (word, replacement); refuses tables beyond ``LEXICON_ENTRIES``."""

    def table(df: DataFrame | None) -> dict[str, str]:
        rows = df.select(*df.columns[:2]).limit(LEXICON_ENTRIES + 1).collect() if df is not None else []
        if len(rows) > LEXICON_ENTRIES:
            raise ValueError(f"a lexicon table has more than {LEXICON_ENTRIES} entries")
        return {r[0]: r[1] for r in rows}

    return spark.sparkContext.broadcast(Lexicon(table(classes), table(synonyms), table(gloss), table(script)))
