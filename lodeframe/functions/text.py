"""Text helpers with one meaning everywhere: lines, trimming, patterns, paths and sizes."""

from __future__ import annotations

import re
import re._parser as sre_parse
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def java(pattern: str) -> str:
    """A pattern for rlike: classes and case by Unicode, and only a newline ends a line."""
    return "(?Ud)" + pattern


def lines_of(content: Column) -> Column:
    """The lines of a text: none for an empty one, no empty last line, no carriage return before a newline."""
    plain = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(plain, r"\n\z", ""), "\n", -1))


def explode_lines(blobs: DataFrame) -> DataFrame:
    """(path, line_no, line) of (path, content), as lines_of() has them; null content has no lines."""
    parts = blobs.select("path", F.split(F.replace("content", F.lit("\r\n"), F.lit("\n")), "\n", -1).alias("parts"))
    rows = parts.select("path", F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "line")).filter("pos < n - 1 or line <> ''")
    return rows.select("path", (F.col("pos") + 1).alias("line_no"), "line")


def literals(pattern: str) -> tuple[list[tuple[str, ...]], bool]:
    """Sets of literals, of each of which any text that the pattern fits holds at least one, and whether they go by lower case. No
    sets if none can be told."""
    try:
        parsed = sre_parse.parse(pattern)
    except re.error:
        return [], False
    by_lower = bool(parsed.state.flags & re.IGNORECASE)

    def of(sequence) -> list[tuple[str, ...]]:
        nonlocal by_lower
        found, run = [], ""
        for op, value in [*sequence, (None, None)]:
            if op is sre_parse.LITERAL:
                run += chr(value)
                continue
            if run:
                found.append((run,))
            run = ""
            if op is sre_parse.SUBPATTERN:
                by_lower = by_lower or bool(value[1] & re.IGNORECASE)
                found += of(value[3])
            elif op in (sre_parse.MAX_REPEAT, sre_parse.MIN_REPEAT) and value[0] > 0:
                found += of(value[2])
            elif op is sre_parse.BRANCH:
                each = [best(of(b)) for b in value[1]]
                found += [tuple(x for e in each for x in e)] if all(each) else []
        return found

    found = of(parsed)
    return [tuple(sorted({x.lower() if by_lower else x for x in f})) for f in found], by_lower


def best(found: list[tuple[str, ...]]) -> tuple[str, ...]:
    """The set whose shortest literal is longest."""
    return max(found, key=lambda f: (min(map(len, f), default=0), -len(f)), default=())


def needles(pattern: str) -> tuple[tuple[str, ...], bool]:
    """Literals of which any text that the pattern fits holds at least one, and whether they go by lower case. None if no such
    literals can be told."""
    found, by_lower = literals(pattern)
    return best(found), by_lower


def there(pattern: str) -> str:
    """A pattern that is found in the same texts, for rlike. A long run of ASCII characters of a class is looked for from the run's
    first character only, and the class is spelt out, for which Java looks characters up in a table."""
    try:
        parsed = list(sre_parse.parse(pattern))
    except re.error:
        return java(pattern)
    op, value = parsed[0] if parsed else (None, None)
    if op is not sre_parse.MAX_REPEAT or any(o is not sre_parse.MAX_REPEAT or v[0] for o, v in parsed[1:]) or re.search(r"\(\?", pattern):
        return java(pattern)
    least, most, inner = value[0], value[1], list(value[2])
    if least < 2 or most is not sre_parse.MAXREPEAT or len(inner) != 1 or inner[0][0] is not sre_parse.IN:
        return java(pattern)
    chars = []
    for kind, x in inner[0][1]:
        if kind not in (sre_parse.LITERAL, sre_parse.RANGE) or max(x if kind is sre_parse.RANGE else (x,)) > 127:
            return java(pattern)
        chars += range(x[0], x[1] + 1) if kind is sre_parse.RANGE else [x]
    spelt = "[" + "".join(f"\\x{c:02x}" for c in sorted(set(chars))) + "]"
    return f"(?<!{spelt}){spelt}{{{least}}}"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def ends_with_any(path: Column, endings: str | Iterable[str]) -> Column:
    """Whether a path ends in one of the endings (a space-separated string or several)."""
    found = F.lit(False)
    for e in endings.split() if isinstance(endings, str) else endings:
        found = found | path.endswith(e)
    return found


def outside(path: Column, folders: Iterable[str], ignored: Iterable[str] = ()) -> Column:
    """Whether a path lies in none of the folders at the root. Ignored folders may lack their slash."""
    kept = F.lit(True)
    for d in [*folders, *(x if x.endswith("/") else x + "/" for x in ignored)]:
        kept = kept & ~path.startswith(d)
    return kept


def not_a_test(path: Column, folders: Iterable[str] = ("/test/",)) -> Column:
    kept = ~path.contains("_test.") & ~path.contains(".test.")
    for d in folders:
        kept = kept & ~path.contains(d)
    return kept


def shortened(text: Column, limit: int) -> Column:
    """Texts of more than limit bytes cut to limit - 1 characters and an ellipsis."""
    return F.when(F.octet_length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def human_size(size: Column) -> Column:
    return (
        F.when(size > 1 << 20, F.format_string("%.1f MB", size / (1 << 20)))
        .when(size > 1 << 10, F.format_string("%.1f KB", size / (1 << 10)))
        .otherwise(F.format_string("%d B", size.cast("bigint")))
    )


def without_colour(text: Column) -> Column:
    """A terminal text without its colour codes."""
    return F.regexp_replace(text, "\x1b\\[[0-9;]*m", "")
