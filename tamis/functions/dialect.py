"""Rule patterns are kept in one form; here they become patterns of java.util.regex or of RE2.

The common form is ASCII: \\b is a boundary of [A-Za-z0-9_], \\s is space and x09 to x0D, $ is the very end.
"""

from __future__ import annotations

import re

_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_BEFORE, _AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_SPACE = r"\t\n\x0B\f\r "


def _outside(pattern: str, change) -> str:
    """pattern with change(escape or character, inside a class?) applied to each part."""
    out, inside = [], False
    for part in re.findall(r"\\.|.", pattern, re.S):
        out.append(change(part, inside))
        if part == "[" and not inside:
            inside = True
        elif part == "]" and inside:
            inside = False
    return "".join(out)


def java(pattern: str, flags: str = "", exact: bool = False) -> str:
    """A boundary beside a word character needs to look to its other side only, which is several times faster.

    A group beside a boundary is taken to begin and end with word characters, as in most rules; exact is for others.
    """

    def change(part: str, inside: bool) -> str:
        if part == r"\s":
            return _SPACE if inside else f"[{_SPACE}]"
        return r"\z" if part == "$" and not inside else part

    def boundary(m: re.Match) -> str:
        if exact:
            return (m[1] or "") + _BOUNDARY
        if re.match(r"\w|\(", m[2] or "") and not re.match(r"[\w)\]}]", m[1] or ""):
            return (m[1] or "") + _BEFORE
        if re.match(r"[\w)]", m[1] or ""):
            return m[1] + _AFTER
        if re.match(r"\w|\(", m[2] or ""):
            return (m[1] or "") + _BEFORE
        return (m[1] or "") + _BOUNDARY

    pattern = re.sub(r"([^\\])?\\b(?=(.)?)", boundary, pattern)
    return ("(?i)" if "i" in flags else "") + _outside(pattern, change)


def re2(pattern: str, flags: str = "") -> str:
    def change(part: str, inside: bool) -> str:
        if part == r"\s":
            return _SPACE if inside else f"[{_SPACE}]"
        return part

    return ("(?i)" if "i" in flags else "") + _outside(pattern, change)


def quoted(text: str) -> str:
    """A SQL string literal for DuckDB."""
    return "'" + text.replace("'", "''") + "'"
