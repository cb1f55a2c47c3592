"""Text patterns, kept in one dialect and rewritten for the JVM and for Python.

The common dialect is that of linear-time engines: ``\\b``, ``\\w``, ``\\d`` and ``\\s`` are ASCII and ``\\s`` is
tab, line feed, form feed, carriage return and space. Java's ``\\b`` knows all letters and its ``\\s`` the
vertical tab, Python's classes know all scripts; both are spelled out.
"""

from __future__ import annotations

import re

from .lexicon import ARROW_PHRASES

# The patterns below define the operators, in the order in which they apply.
PROTECTED = {
    "fence": r"(?s)```.*?```",
    "code": r"`[^`\n]+`",
    "url": r"(?i)\bhttps?://\S+",
    "path": r"(?:[/~])?[\w.-]*[/\\][\w./\\-]+",
    "constant": r"\b[A-Z][A-Za-z0-9]*(_[A-Z][A-Za-z0-9]*)+\b",
    "dotted": r"\b\w+\.\w+(\.\w+)*(\(\))?",
    "call": r"[A-Za-z_][A-Za-z0-9_]*\s*\([^)]*\)",
    "version": r"\b\d+\.\d+\.\d+\b",
}
LEADERS = r"(?im)^(i'?ll|i will|i can|i'?d|you can|we will|we can|let me|let'?s)\s+"
PLEASANTRIES = r"(?i)\b(please|kindly|thank you|thanks|sure|certainly|of course|happy to|i'?d be happy)\b[,.]?\s*"
HEDGES = r"(?i)\b(perhaps|maybe|might|could potentially|would like to|i think|in my opinion|it seems|it appears)\b\s*"
FILLERS = r"(?i)\b(just|really|basically|actually|simply|quite|very|essentially|literally)\b"
ARTICLES = r"(?i)\b(a|an|the)\s+"
MANY_SPACES = r"[ \t]{2,}"
SPACE_BEFORE_MARK = r"\s+([,.;:!?])"
MANY_BREAKS = r"\n{3,}"
SENTENCE_HEAD = r"(?:^|[.!?]\s+)([a-z])"
ARROW = r"(?i)\b(?:" + "|".join(p.replace(" ", r"\s+") for p in ARROW_PHRASES) + r")\b"
ARROW_RUN = r"(?:->\s*){2,}"
HEADING = r"^(#{1,4})([^#].*)$"
#: Characters with the Unicode property White_Space, as a class body; Java and Python agree on it.
WHITE = r"\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WHITE_DUCK = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

_BOUNDARY = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_SPACE = r"\t\n\f\r "


def _spaces(pattern: str) -> str:
    return pattern.replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")


def jvm(pattern: str) -> str:
    """The pattern for Spark's regular expressions; line starts are after line feeds only."""
    out = _spaces(pattern).replace(r"\b", _BOUNDARY)
    return out.replace("(?im)", "(?imd)")


def duck(pattern: str) -> str:
    """The pattern for DuckDB, whose dialect is the common one, as the inside of an SQL string."""
    return pattern.replace("'", "''")


def python(pattern: str) -> re.Pattern:
    """The compiled pattern for the kernel."""
    return re.compile(_spaces(pattern), re.ASCII)
