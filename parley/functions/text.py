"""Column -> Column text rules. All are native Spark expressions (codegen'd,
no Python workers)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour:
#   fence pattern for code blocks (lazy, closing fence at line start)
CODE_BLOCK_PATTERN = r"(?s)```(?:python)?\n(.*?)\n```"
#   explanation is the text before the first newline+fence
FENCE_SEPARATOR = "\n```"
#   default numbering put before each of several code blocks
MULTI_BLOCK_PREFIX = "\n\n# {i}\n"
#   marker of the debugger call removed from source code
DEBUGGER_MARKER = "duck("
#   comment prefix that routes a typed line to the model
COMMENT_PREFIX = ">"
#   prefix that asks for the full prompt to be shown
VERBOSE_PREFIX = "[dev]"
#   number of characters kept in clear when masking a key; expected key prefix
MASK_KEEP = 4
KEY_PREFIX = "sk-"

# Line breaks as Python's str.splitlines sees them (minus U+001C..U+001E,
# which the Java and RE2 engines do not treat as breaks either).
LINE_BREAK = r"\r\n|[\n\x0B\x0C\r\x{0085}\x{2028}\x{2029}]"
# Unicode whitespace run, as Python's str.split() without arguments.
WHITESPACE = r"(?U)\s+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_count(text) -> Column:
    """Whitespace tokens of ``text`` (Python ``len(s.split())``); NULL -> 0."""
    toks = F.filter(F.split(F.coalesce(_col(text), F.lit("")), WHITESPACE),
                    lambda x: x != "")
    return F.size(toks).cast("bigint")


def speaker_label(role) -> Column:
    r = _col(role)
    return (F.when(r == "user", F.lit("Human"))
            .when(r == "assistant", F.lit("AI"))
            .when(r == "system", F.lit("System"))
            .otherwise(F.initcap(r)))


def speaker_words(text) -> Column:
    """Words of ``"Speaker: text"``: the content's tokens plus the label."""
    return word_count(text) + F.lit(1)


def code_blocks(text) -> Column:
    """All fenced code blocks, in order, as ARRAY<STRING>."""
    return F.regexp_extract_all(_col(text), F.lit(CODE_BLOCK_PATTERN), 1)


def explanation(text) -> Column:
    """Text before the first newline+fence (the whole text when none)."""
    return F.substring_index(_col(text), FENCE_SEPARATOR, 1)


def _template_parts(template: str, allowed: set[str] | None = None):
    """Split a ``str.format``-style template into literal and field parts.

    ``{{``/``}}`` are literal braces; ``{name}`` is a field. Compiled once on
    the driver; rows never see Python.
    """
    parts: list[tuple[str, str]] = []
    i, buf = 0, []
    while i < len(template):
        ch = template[i]
        if ch == "{" and template.startswith("{{", i):
            buf.append("{")
            i += 2
        elif ch == "}" and template.startswith("}}", i):
            buf.append("}")
            i += 2
        elif ch == "{":
            j = template.find("}", i)
            if j < 0:
                raise ValueError(f"unclosed field in template at {i}")
            name = template[i + 1:j]
            if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
                raise ValueError(f"bad field name {name!r} in template")
            if allowed is not None and name not in allowed:
                raise ValueError(f"template field {name!r} is not a column")
            if buf:
                parts.append(("lit", "".join(buf)))
                buf = []
            parts.append(("field", name))
            i = j + 1
        elif ch == "}":
            raise ValueError(f"single '}}' in template at {i}")
        else:
            buf.append(ch)
            i += 1
    if buf:
        parts.append(("lit", "".join(buf)))
    return parts


def template_fields(template: str) -> list[str]:
    """Field names of a template, in first-seen order."""
    seen: list[str] = []
    for kind, val in _template_parts(template):
        if kind == "field" and val not in seen:
            seen.append(val)
    return seen


def render_template(template: str, fields: dict[str, Column]) -> Column:
    """``concat`` of literals and field columns; NULL fields render as ''.
    Fields of ``fields`` that the template does not use are ignored."""
    pieces = []
    for kind, val in _template_parts(template, set(fields)):
        if kind == "lit":
            pieces.append(F.lit(val))
        else:
            pieces.append(F.coalesce(fields[val].cast("string"), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")


def join_code_blocks(blocks, prefix_template: str = MULTI_BLOCK_PREFIX) -> Column:
    """none -> ''; one -> itself; several -> numbered, first left-stripped."""
    arr = _col(blocks)
    numbered = F.transform(
        arr, lambda c, i: F.concat(render_template(
            prefix_template, {"i": (i + 1).cast("string")}), c))
    stripped = F.transform(
        numbered, lambda c, i: F.when(i == 0, F.regexp_replace(c, r"(?U)^\s+", ""))
        .otherwise(c))
    return (F.when(F.size(arr) <= 0, F.lit(""))
            .when(F.size(arr) == 1, F.element_at(arr, 1))
            .otherwise(F.array_join(stripped, "")))


def strip_marker_lines(code, marker: str = DEBUGGER_MARKER) -> Column:
    """Drop every line whose stripped text starts with ``marker``; lines are
    split as ``str.splitlines`` does (one final break does not make a line)
    and joined with ``\\n``."""
    c = _col(code)
    # `\z` (not `$`): only a break that ends the text is dropped.
    body = F.regexp_replace(c, f"(?:{LINE_BREAK})\\z", "")
    lines = F.split(body, LINE_BREAK)
    pat = r"(?U)^\s*" + re.escape(marker).replace("\\(", r"\(")
    kept = F.filter(lines, lambda ln: ~ln.rlike(pat))
    return F.when(c.isNull(), F.lit(None)).otherwise(
        F.when(c == "", F.lit("")).otherwise(F.array_join(kept, "\n")))


def is_conversational(line) -> Column:
    c = _col(line)
    return F.contains(c, F.lit("?")) | c.startswith(COMMENT_PREFIX)


def strip_comment_prefix(line) -> Column:
    return F.regexp_replace(_col(line), "^" + re.escape(COMMENT_PREFIX) + "+", "")


def redact(value) -> Column:
    c = _col(value)
    return F.concat(F.substring(c, 1, MASK_KEEP),
                    F.repeat(F.lit("*"), F.greatest(F.lit(0), F.length(c) - MASK_KEEP)))


def looks_like_key(value) -> Column:
    return _col(value).startswith(KEY_PREFIX)


def quote(value) -> Column:
    """Our quoting rule for previews: ``'`` + text + ``'`` (no escapes)."""
    return F.concat(F.lit("'"), _col(value), F.lit("'"))
