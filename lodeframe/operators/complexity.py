"""Functions in source files and how many branches they have.

Finding where a function ends is sequential: what one function covers decides where the next search starts. So each file is
one row for an Arrow function that gives a row per function; everything after that is plain DataFrame work."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions import rule_tables as fixed
from lodeframe.functions.text import ends_with_any, outside

THRESHOLD = 10
SCHEMA = "path string, name string, line int, complexity int"


def lines(text: str) -> list[str]:
    out = text.split("\n")
    if out and out[-1] == "":
        out.pop()
    return [x.removesuffix("\r") for x in out]


def indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def indented_end(code: list[str], at: int) -> tuple[int, Iterable[str]]:
    """Where the body after a header by indentation ends, and its lines that count."""
    depth, body, end = indent(code[at]), [], len(code)
    for i in range(at + 1, len(code)):
        bare = code[i].strip()
        if not bare or bare.startswith("#"):
            continue
        if indent(code[i]) <= depth:
            end = i
            break
        body.append(code[i])
    return end, body


def braced_end(code: list[str], at: int) -> tuple[int, Iterable[str]]:
    """Where the braces opened from the header on are closed, and the lines after it from the first brace on."""
    depth, opened, body = 0, False, []
    for i in range(at, len(code)):
        opened = opened or "{" in code[i]
        depth += code[i].count("{") - code[i].count("}")
        if opened and i > at:
            body.append(code[i])
        if opened and depth <= 0:
            return i + 1, body
    return len(code), body


def functions_in(code: list[str], header: re.Pattern, by_indent: bool, count: Callable[[str], int]) -> Iterator[tuple[str, int, int]]:
    """(name, line, complexity) of the functions of a file; those inside another are part of it."""
    at = 0
    while at < len(code):
        found = header.search(code[at])
        name = next((g for g in found.groups() if g), "") if found else ""
        if not name:
            at += 1
            continue
        end, body = (indented_end if by_indent else braced_end)(code, at)
        yield name, at + 1, 1 + sum(map(count, body))
        at = end


def scanned(blobs: DataFrame, rules: list[tuple[str, str, bool, tuple]]) -> DataFrame:
    """Functions by rules (endings, header, by_indent, what to count). What to count: patterns, all of whose occurrences
    count, or ("words", ...), each of which counts once a line."""

    def counter(what: tuple) -> Callable[[str], int]:
        if what[0] == "words":
            return lambda line: sum(w in line for w in what[1:])
        if what[0] == "bare words":
            return lambda line: sum(w in line.strip() for w in what[1:])
        compiled = [re.compile(p) for p in what]
        return lambda line: sum(len(p.findall(line)) for p in compiled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(tuple(e.split()), re.compile(h), i, counter(c)) for e, h, i, c in rules]
        for batch in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for endings, header, by_indent, count in ready:
                    if path.endswith(endings):
                        rows += [(path, *f) for f in functions_in(lines(content), header, by_indent, count)]
                        break
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)], ["path", "name", "line", "complexity"])

    known = blobs.filter(ends_with_any(F.col("path"), " ".join(r[0] for r in rules)) & F.col("content").isNotNull())
    return known.select("path", "content").mapInArrow(run, SCHEMA)


def complexity_functions(blobs: DataFrame, ignored: Iterable[str] = ()) -> DataFrame:
    """path, name, line, complexity of every function: one and every occurrence of a branch pattern in its body."""
    kept = blobs.filter(outside(F.col("path"), fixed.SKIP_CODE, ignored))
    return scanned(kept, [(e, h, e == ".py", b) for e, h, b in fixed.LANGUAGES])


def complexity_top(blobs: DataFrame, n: int = 20, ignored: Iterable[str] = ()) -> DataFrame:
    return top_of(complexity_functions(blobs, ignored), n)


def top_of(functions: DataFrame, n: int = 20) -> DataFrame:
    return functions.orderBy(F.desc("complexity"), "path", "line").limit(n)


def complexity_summary(blobs: DataFrame, ignored: Iterable[str] = (), threshold: int = THRESHOLD) -> DataFrame:
    """One row: functions, mean complexity, functions above the threshold."""
    return summary_of(complexity_functions(blobs, ignored), threshold)


def summary_of(functions: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    return functions.agg(F.count("*").alias("functions"), F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("average"), F.count_if(F.col("complexity") > threshold).alias("above"))


def complexity_by_language(blobs: DataFrame, ignored: Iterable[str] = ()) -> DataFrame:
    """language (a language's first file ending), files with functions, functions."""
    language = F.lit(None).cast("string")
    for endings, _, _ in fixed.LANGUAGES:
        language = F.when(ends_with_any(F.col("path"), endings), F.lit(endings.split()[0])).otherwise(language)
    found = complexity_functions(blobs, ignored).groupBy("path").agg(F.count("*").alias("n"))
    return found.groupBy(language.alias("language")).agg(F.count("*").alias("files"), F.sum("n").alias("functions"))


def hint(path: Column, complexity: Column) -> Column:
    by_value, by_file = F.lit(None).cast("string"), F.lit(None).cast("string")
    for least, text in reversed(fixed.HINTS_BY_VALUE):
        by_value = F.when(complexity > least, F.lit(text)).otherwise(by_value)
    for endings, text in fixed.HINTS_BY_FILE:
        by_file = F.when(ends_with_any(path, endings), F.lit(text)).otherwise(by_file)
    return F.concat_ws("; ", by_value, by_file)


def complexity_hints(blobs: DataFrame, ignored: Iterable[str] = (), threshold: int = THRESHOLD) -> DataFrame:
    """Functions above the threshold, counted by keywords that a line holds, with a hint for each."""
    kept = blobs.filter(outside(F.col("path"), fixed.SKIP_CODE, ignored))
    rules = [(e, fixed.SCRIPT_HEADER if e.startswith(".ts") else h, e == ".py", ("bare words" if e == ".py" else "words", *fixed.HINT_KEYWORDS)) for e, h, _ in fixed.LANGUAGES]
    found = scanned(kept, rules).filter(F.col("complexity") > threshold)
    return found.withColumn("hint", hint(F.col("path"), F.col("complexity")))


def complexity_snapshot(blobs: DataFrame, ignored: Iterable[str] = (), threshold: int = THRESHOLD) -> DataFrame:
    """One row by the snapshot's own way of counting: Rust headers in files of several languages."""
    kept = blobs.filter(outside(F.col("path"), fixed.SKIP_CODE))
    for d in ignored:
        kept = kept.filter(~F.col("path").startswith(d))
    found = scanned(kept, [(fixed.SNAPSHOT_CODE_FILES, fixed.LANGUAGES[0][1], False, ("words", *fixed.SNAPSHOT_KEYWORDS))])
    return found.agg(F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("complexity_avg"), F.count_if(F.col("complexity") > threshold).alias("complexity_above"))
