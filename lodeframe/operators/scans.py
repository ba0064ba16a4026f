"""Line and path scans with fixed patterns. Inputs are lines (path, line_no, line), blobs (path, size, content), commits and
file_changes. Patterns are literals of one projection, so each is compiled once a task and nothing is joined or shuffled.

A rule is tried on lines of files with its endings, and its regular expression only on those that hold a literal which its matches
can't do without (told from its pattern)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions import rule_tables as fixed
from lodeframe.functions.text import ends_with_any, java, literals, needles, not_a_test, outside, shortened, there, trimmed
from lodeframe.operators.activity import newest

COMMENT = r"(?U)^\s*(//|#|/\*|\*)"


def hits(rules: Sequence[tuple]) -> Column:
    """The rules that a line fits, as structs in their order, by their patterns alone."""

    def hit(no: int, rule: tuple) -> Column:
        name, severity, endings, pattern, description = rule
        fits = ends_with_any(F.col("path"), endings) & F.col("line").rlike(java(pattern))
        if "yaml.load" in name:
            fits = fits & ~F.col("line").contains("SafeLoader")
        return F.when(fits, F.struct(F.lit(no).alias("rule_no"), F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.lit(description).alias("description")))

    return F.array_compact(F.array(*[hit(no, r) for no, r in enumerate(rules)]))


def folded(line: Column) -> Column:
    """A line in the lower case that patterns which disregard case go by: `ſ`, `ı`, `İ` and the Kelvin sign fit ASCII letters too."""
    plain = line
    for other, letter in ("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"):
        plain = F.replace(plain, F.lit(other), F.lit(letter))
    has = line.contains("\u0130") | line.contains("\u0131") | line.contains("\u017f")
    return F.lower(F.when(has, plain).otherwise(line))


def fits(rule: tuple, line: Column, low: Column) -> Column:
    """Whether a line (low: folded) fits a rule, whatever its path. The pattern is tried only on lines that hold a literal which it
    can't do without."""
    name, _, _, pattern, _ = rule
    found, by_low = needles(pattern)
    out = line.rlike(there(pattern))
    if found:
        # A literal that holds another one adds nothing.
        least = [x for x in found if not any(y != x and y in x for y in found)]
        out = reduce(or_, [(low if by_low else line).contains(x) for x in least]) & out
    return out & ~line.contains("SafeLoader") if "yaml.load" in name else out


#: Signs that are rare in prose. Rules that can't do without one are looked at only on lines that hold it.
SIGNS = ("(", "=", "{", ":")


def fitting(rules: Sequence[tuple], line: Column, low: Column) -> Column:
    """The numbers of the rules that a line fits. Only the rules for the path's ending are tried."""
    none = F.array().cast("array<int>")
    signs = [next((s for s in SIGNS if any(all(s in x for x in f) for f in literals(r[3])[0])), None) for r in rules]
    out = none
    for e in sorted({e for r in rules for e in r[2].split()}, key=lambda e: (len(e), e)):
        own = [no for no, r in enumerate(rules) if e.endswith(tuple(r[2].split()))]
        parts = []
        for sign in (None, *SIGNS):
            if some := [F.when(fits(rules[no], line, low), F.lit(no)) for no in own if signs[no] == sign]:
                part = F.array_compact(F.array(*some))
                parts.append(part if sign is None else F.when(line.contains(sign), part).otherwise(none))
        out = F.when(F.col("path").endswith(e), F.concat(*parts)).otherwise(out)
    return out


def with_low(line: Column, make: Callable[[Column], Column]) -> Column:
    """make(folded line), which is worked out once: as a column it would be put in wherever it's named, and worked out each time."""
    return F.element_at(F.transform(F.array(folded(line)), make), 1)


def told(rules: Sequence[tuple], no: Column) -> Column:
    """A rule by its number: struct(rule, severity, description)."""
    return F.get(F.array(*[F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("severity"), F.lit(r[4]).alias("description")) for r in rules]), no)


def findings(lines: DataFrame, rules: Sequence[tuple], code: bool = False) -> DataFrame:
    """A row for each line and rule that fits: path, line_no, line, rule_no, rule, severity, description. code: not on lines
    that are comments."""
    known = lines.filter(ends_with_any(F.col("path"), sorted({e for r in rules for e in r[2].split()})))
    found = with_low(F.col("line"), lambda low: fitting(rules, F.col("line"), low))
    rows = known.select("path", "line_no", "line", F.explode(found).alias("rule_no"))
    if code:
        rows = rows.filter(~F.col("line").rlike(COMMENT))
    return rows.withColumn("of", told(rules, F.col("rule_no"))).select("path", "line_no", "line", "rule_no", "of.*")


def no_sample(line: Column) -> Column:
    return ~F.lower(line).rlike("test|mock|fixture|example")


def line_scans(lines: DataFrame, ignored: Iterable[str] = ()) -> DataFrame:
    """All scans of lines in one pass: path, line_no, line, scan (secrets, dangerous, sast, remediation, addresses), nth, and
    rule, severity and description (of addresses, the address as rule). Each scan finds what its own function does."""
    path, line = F.col("path"), F.col("line")
    place = {
        "secrets": (fixed.SECRETS, outside(path, fixed.SKIP_SECRETS, ignored)),
        "dangerous": (fixed.DANGEROUS, outside(path, fixed.SKIP_DANGEROUS, ignored) & not_a_test(path)),
        "sast": (fixed.SAST, code_file(path, ignored)),
        "remediation": (fixed.SAST_REMEDIATION, code_file(path, ignored)),
    }
    of = lambda scan, nth, ip: F.struct(F.lit(scan).alias("scan"), nth.alias("nth"), ip.alias("ip"))
    none = F.lit(None).cast("string")

    def found(low: Column) -> Column:
        each = []
        for scan, (rules, where) in place.items():
            fit = F.when(where, fitting(rules, line, low)).otherwise(F.array().cast("array<int>"))
            each.append(F.transform(fit, lambda no: of(scan, no, none)))  # noqa: B023
        return F.concat(*each)

    ips = F.when(address_line(path, line, ignored) & line.rlike(java(r"\d\.\d")), addresses(line)).otherwise(F.array().cast("array<string>"))
    ips = F.filter(F.transform(ips, lambda x, i: of("addresses", i, x)), lambda x: ~x["ip"].isin(*fixed.SAFE_ADDRESSES))
    rows = lines.select("path", "line_no", "line", F.explode(F.concat(with_low(line, found), ips)).alias("hit")).select("path", "line_no", "line", "hit.*")
    scan = F.col("scan")
    rows = rows.filter(F.when(scan == "secrets", no_sample(line)).when(scan.isin("sast", "remediation"), ~line.rlike(COMMENT)).otherwise(True))
    rule = F.struct(F.col("ip").alias("rule"), none.alias("severity"), none.alias("description"))
    for name, (rules, _) in place.items():
        rule = F.when(scan == name, told(rules, F.col("nth"))).otherwise(rule)
    return rows.withColumn("of", rule).select("path", "line_no", "line", "scan", "nth", "of.*")


def secrets(lines: DataFrame, ignored: Iterable[str] = ()) -> DataFrame:
    """Lines that hold a credential word or a long base64 run, without those that look like tests."""
    kept = lines.filter(outside(F.col("path"), fixed.SKIP_SECRETS, ignored) & no_sample(F.col("line")))
    return findings(kept, fixed.SECRETS).select("path", "line_no", F.col("rule").alias("pattern"))


def dangerous_patterns(lines: DataFrame, ignored: Iterable[str] = ()) -> DataFrame:
    kept = lines.filter(outside(F.col("path"), fixed.SKIP_DANGEROUS, ignored) & not_a_test(F.col("path")))
    return findings(kept, fixed.DANGEROUS).select("path", "line_no", F.col("rule").alias("pattern"))


def sensitive_files(blobs: DataFrame, ignored: Iterable[str] = ()) -> DataFrame:
    return blobs.filter(outside(F.col("path"), fixed.SKIP_SENSITIVE, ignored) & F.col("path").rlike(java(fixed.SENSITIVE_PATH))).select("path")


def sensitive_commits(commits: DataFrame, changes: DataFrame, n: int = 20, among: int = 500) -> DataFrame:
    """The newest commits that touch security-related paths, with these paths in order."""
    some = newest(commits.select("oid", "ts", "message"), among)
    touched = changes.filter(F.col("path").rlike(java(fixed.SENSITIVE_CHANGE))).join(F.broadcast(some), "oid")
    paths = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"]), ", ")
    rows = touched.groupBy("oid", "ts", "message").agg(paths.alias("paths"))
    return rows.orderBy(F.desc("ts"), "oid").limit(n).select(F.substring("oid", 1, 7).alias("hash"), shortened(trimmed(F.col("message")), 50).alias("message"), "paths")


def secret_commits(commits: DataFrame, n: int = 20) -> DataFrame:
    found = commits.withColumn("message", trimmed(F.col("message"))).filter(F.col("message").rlike(java(fixed.SECRET_MESSAGE)))
    return newest(found, n).select(F.substring("oid", 1, 7).alias("hash"), shortened(F.col("message"), 70).alias("message"))


def address_line(path: Column, line: Column, ignored: Iterable[str]) -> Column:
    plain = line.contains("example") | line.contains("test") | (line.contains("//") & line.contains("localhost"))
    return outside(path, fixed.SKIP_DANGEROUS, ignored) & ends_with_any(path, fixed.ADDRESS_FILES) & ~plain


def addresses(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(java(fixed.ADDRESS)), F.lit(1))


def hardcoded_ips(lines: DataFrame, ignored: Iterable[str] = ()) -> DataFrame:
    """Every address on a line, but for the harmless ones; parts are not range-checked."""
    kept = lines.filter(address_line(F.col("path"), F.col("line"), ignored) & F.col("line").rlike(java(r"\d\.\d")))
    found = kept.select("path", "line_no", F.posexplode(addresses(F.col("line"))).alias("nth", "ip"))
    return found.filter(~F.col("ip").isin(*fixed.SAFE_ADDRESSES)).select("path", "line_no", "nth", "ip")


def gitignore_coverage(text: DataFrame) -> DataFrame:
    """For each row (content, null where there is no file): whether each wanted entry is there."""
    wanted = F.explode(F.array(*map(F.lit, fixed.IGNORED_BY_RIGHTS))).alias("entry")
    return text.select("content", wanted).select("entry", F.coalesce(F.col("content").contains(F.col("entry")), F.lit(False)).alias("ignored"))


def code_file(path: Column, ignored: Iterable[str]) -> Column:
    return outside(path, fixed.SKIP_CODE, ignored) & not_a_test(path, ("/test/", "/tests/"))


def sast(lines: DataFrame, rules: Sequence[tuple] = fixed.SAST, ignored: Iterable[str] = ()) -> DataFrame:
    """Rule findings on code lines that are neither comments nor in test files."""
    return findings(lines.filter(code_file(F.col("path"), ignored)), rules, code=True)


def sast_report(lines: DataFrame, ignored: Iterable[str] = ()) -> DataFrame:
    return sast(lines, ignored=ignored).select("path", "line_no", "rule", "severity", "description")


def sast_by_severity(lines: DataFrame, ignored: Iterable[str] = ()) -> DataFrame:
    return sast(lines, ignored=ignored).groupBy("severity").agg(F.count("*").alias("findings"))


def sast_top(lines: DataFrame, n: int = 20, ignored: Iterable[str] = ()) -> DataFrame:
    """The first n findings of each severity in file, line and rule order."""
    order = Window.partitionBy("severity").orderBy("path", "line_no", "rule_no")
    return sast(lines, ignored=ignored).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n).select("severity", "nth", "path", "line_no", "rule")


def remedied(found: DataFrame) -> DataFrame:
    """Findings with the first remediation whose name is part of the rule's."""
    guidance, example = F.lit(None).cast("string"), F.lit(None).cast("string")
    for part, how, sample in reversed(fixed.REMEDIATIONS):
        fits = F.lower("rule").contains(part.lower())
        guidance, example = F.when(fits, F.lit(how)).otherwise(guidance), F.when(fits, F.lit(sample)).otherwise(example)
    found = found.withColumn("bare", trimmed(F.col("line")))
    code = F.when(F.octet_length("bare") > 80, F.concat(F.substring("bare", 1, 77), F.lit("..."))).otherwise(F.col("bare"))
    return found.select("path", "line_no", "rule", "severity", code.alias("code"), F.coalesce(guidance, F.col("description")).alias("guidance"), example.alias("example"))


def sast_remediation(lines: DataFrame, ignored: Iterable[str] = ()) -> DataFrame:
    """Findings of the short rule set, remedied."""
    return remedied(sast(lines, fixed.SAST_REMEDIATION, ignored))


def outside_as_typed(path: Column, ignored: Iterable[str]) -> Column:
    """The snapshot takes ignored folders as they are typed: `doc` leaves out `docs/` too."""
    kept = F.lit(True)
    for d in ignored:
        kept = kept & ~path.startswith(d)
    return kept


def sast_snapshot(lines: DataFrame, ignored: Iterable[str] = ()) -> DataFrame:
    """One row of counts by severity, comments and tests included."""
    kept = lines.filter(outside(F.col("path"), fixed.SKIP_CODE) & outside_as_typed(F.col("path"), ignored))
    of = lambda s: F.count_if(F.col("severity") == s)
    return findings(kept, fixed.SAST_SNAPSHOT).agg(of("HIGH").alias("sast_high"), of("MEDIUM").alias("sast_medium"), of("INFO").alias("sast_info"))


def snapshot_secrets(lines: DataFrame, ignored: Iterable[str] = ()) -> DataFrame:
    kept = lines.filter(outside(F.col("path"), fixed.SKIP_CODE) & outside_as_typed(F.col("path"), ignored))
    return kept.filter(F.col("line").rlike(java(fixed.SNAPSHOT_SECRET))).agg(F.count("*").alias("secrets_found"))
