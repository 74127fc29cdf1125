"""Text expressions that reproduce Python string semantics on Spark columns.

All of these are built-in expressions (codegen, JVM side); nothing here
leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: characters Python's str.strip()/rstrip() remove (str.isspace()).
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
PY_WHITESPACE_NO_NL = PY_WHITESPACE.replace("\n", "")

# FIXED VALUES: line boundaries of Python's str.splitlines().
SPLITLINES_RE = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# FIXED VALUES: cleaning patterns (ANSI escapes; control characters except \t \n \r).
ANSI_RE = r"\x1B\[[0-?]*[ -/]*[@-~]"
CONTROL_RE = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
# Python whitespace except LF (as ranges), up to a line end: what rstrip() removes per line.
RSTRIP_LINES_RE = r"[\t\x0B-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+(?=\n|\z)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``."""
    return F.btrim(_col(c), F.lit(PY_WHITESPACE))


def py_rstrip(c) -> Column:
    """``str.rstrip()``."""
    return F.rtrim(_col(c), F.lit(PY_WHITESPACE))


def split_lines(c) -> Column:
    """``str.splitlines()`` as an array column (one trailing empty item dropped)."""
    return let(F.split(_col(c), SPLITLINES_RE, -1),
               lambda parts: F.slice(parts, 1, F.size(parts) - F.when(F.element_at(parts, -1) == F.lit(""), 1).otherwise(0)))


def clean_text(c) -> Column:
    """B-2: drop ANSI escapes and control characters, LF line ends, rstrip lines."""
    t = F.regexp_replace(_col(c), ANSI_RE, "")
    t = F.regexp_replace(t, CONTROL_RE, "")
    t = F.regexp_replace(t, "\r\n?", "\n")
    return F.regexp_replace(t, RSTRIP_LINES_RE, "")


def normalize_text(c) -> Column:
    """B-3: NUL->space, LF line ends, collapse blanks/tabs, 3+ newlines -> 2, strip."""
    t = F.translate(_col(c), "\x00", " ")
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(t, "[ \t]+", " ")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return py_strip(t)


def first_nonblank_lines(c, n: int = 3) -> Column:
    """B-4: first ``n`` stripped non-blank lines of a text (array<string>)."""
    lines = F.transform(split_lines(_col(c)), lambda x: py_strip(x))
    return F.slice(F.filter(lines, lambda x: x != F.lit("")), 1, n)


def _class_body(chars: str) -> str:
    out = []
    for ch in chars:
        out.append("\\x{%x}" % ord(ch))
    return "".join(out)


def regex_class(chars: str) -> str:
    """Java regex character class of the given characters."""
    return "[" + _class_body(chars) + "]"


def let(expr: Column, fn) -> Column:
    """Evaluate ``expr`` once and pass it to ``fn`` (a lambda over Columns).

    Spark has no expression-level binding, and subexpressions inside
    conditional branches are not shared, so a value used several times is
    bound through a one-element ``transform``.
    """
    return F.element_at(F.transform(F.array(expr), fn), 1)
