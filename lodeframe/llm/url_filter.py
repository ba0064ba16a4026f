"""URL filtering with token-indexed pattern rules (operator 9).

A rule is a regular expression over host + path. The literal tokens that any match must hold are read off the expression
itself, and the rule is filed under the rarest of these, by counts over all urls. A url's own tokens fetch the candidate
rules; only those are run. Rules come as a tuple or as a table.
"""

from __future__ import annotations

import re
import re._parser as sre_parse
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.base import table

TOKEN = "[a-z0-9]+"
#: A-Z in hosts are folded beforehand; elsewhere they stand between tokens.
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


#: Rules of a table that are read at most: a rule set has to fit into every worker.
MOST_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    verdict: str
    #: Listed rules come before patterns, and the longest listed one wins.
    listed: bool = False


def tokens_of(pattern: str) -> tuple[str, ...]:
    """Tokens that every text with a match holds as a whole: literal runs of the expression's outer sequence that end, on
    either side, at a literal of another kind, at an end of the text or at a look-around that bars more of the run. A
    pattern that ignores case or has branches outside of groups has the tokens that can be told all the same, or none."""
    parsed = sre_parse.parse(pattern)
    if parsed.state.flags & re.IGNORECASE:
        return ()
    wall = "wall"  # what no token goes across

    def ends_in_wall(part) -> bool:
        op, value = part[-1]
        return op is sre_parse.LITERAL and not re.fullmatch(TOKEN, chr(value))

    line: list[str | None] = []
    for op, value in parsed:
        if op is sre_parse.LITERAL:
            line.append(chr(value) if re.fullmatch(TOKEN, chr(value)) else wall)
        elif op is sre_parse.AT and value in (sre_parse.AT_BEGINNING_STRING, sre_parse.AT_END_STRING, sre_parse.AT_BEGINNING):
            line.append(wall)
        elif op is sre_parse.ASSERT_NOT and value[1].data == BARRED:
            line.append(wall)
        elif op is sre_parse.MAX_REPEAT and line[-1:] == [wall] and len(value[2]) and ends_in_wall(value[2]):
            line.append(wall)  # whether it's there or not
        else:
            line.append(None)  # anything may stand here
    found, run, walled = [], "", False
    for x in [*line, None]:
        if x not in (wall, None):
            run += x
            continue
        if run and walled and x == wall:
            found.append(run)
        run, walled = "", x == wall
    return tuple(found)


#: How a look-around that bars token characters is parsed.
BARRED = sre_parse.parse("[a-z0-9]").data


def rules_of(table: DataFrame) -> tuple[Rule, ...]:
    """Rules of a table (name, pattern, verdict, listed), in the order of its column `place`, if it has one, else of names."""
    n = table.count()
    if n > MOST_RULES:
        raise ValueError(f"{n} rules; at most {MOST_RULES} fit into a worker")
    order = "place" if "place" in table.columns else "name"
    return tuple(Rule(r["name"], r["pattern"], r["verdict"], bool(r["listed"])) for r in table.orderBy(order).collect())


def site(place: str, verdict: str) -> Rule:
    """A rule for a host, its subdomains, and paths under a prefix: `example.net/en/`."""
    host, slash, path = place.partition("/")
    return Rule(place, rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", verdict, True)


def words(name: str, first: str, second: str) -> list[Rule]:
    """Block hosts in which a word of first and a word of second stand beside each other (with or without a hyphen)."""
    made = []
    for b in second.split():
        made += [Rule(f"{name}:{a}-{b}", rf"\A[^/]*(?<![a-z0-9]){a}-{b}(?![a-z0-9])", "block") for a in first.split()]
        made += [Rule(f"{name}:{a}{b}", rf"\A[^/]*(?<![a-z0-9]){a}{b}(?![a-z0-9])", "block") for a in first.split()]
    return made


def word(name: str, *listed: str) -> list[Rule]:
    """Block hosts in which one of these words stands."""
    return [Rule(f"{name}:{w}", rf"\A[^/]*(?<![a-z0-9]){w}(?![a-z0-9])", "block") for w in listed]


#: The listed rules of the query.
LISTED = (site("net/", "block"), site("example.net/en/", "allow"), site("example.com/de/", "block"), site("org/fr/", "allow"))
#: The patterns that decide where no listed rule fits.
PATTERNS = (
    *words("pharmacy", "cheap buy discount online", "pills meds pharmacy viagra"),
    *words("gambling", "free online best live", "bets bet casino poker slots"),
    *words("spam", "spam link seo", "farm farms links network"),
    *word("adult", "adult", "xxx", "porn", "sex", "escort"),
    *word("gambling", "casino", "poker", "betting", "jackpot"),
    *words("malware", "free cracked", "keygen warez serials"),
)


def token_counts(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """Urls that hold each token of the rules; as many rows as the rules have tokens."""
    wanted = sorted({t for r in rules for t in tokens_of(r.pattern)})
    if not wanted:
        return {}
    found = F.array_intersect(F.regexp_extract_all("url", F.lit(f"({TOKEN})"), F.lit(1)), F.array(*map(F.lit, wanted)))
    return {r["t"]: r["n"] for r in urls.select(F.explode(found).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}


def index_of(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Each rule under its rarest token; a rule without tokens under the empty one, which every url has."""
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(tokens_of(r.pattern), key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return index


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty without a `://`."""
    if not url or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.partition("://")[2], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = LISTED + PATTERNS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (listed rule that decides, else null), pattern (pattern that decides, else null), verdict, n_run.

    The longest fitting listed rule wins; else the first fitting pattern (in the order given); else `allow`. Null urls and
    such without `://` have an empty host and path and are allowed. Ids may be null or repeated; other columns are
    ignored. n_run counts the regular expressions that were run.
    """
    if isinstance(rules, DataFrame):
        rules = rules_of(rules)
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    index = index_of(rules, token_counts(urls, rules))
    order = {r: i for i, r in enumerate(rules)}
    kind = urls.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r: re.compile(r.pattern) for r in order}
        tokens = re.compile(TOKEN)
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = parts(url)
                place = host + path
                near = [r for t in {"", *tokens.findall(place)} for r in index.get(t, ())]
                fit = [r for r in near if compiled[r].search(place)]
                rule = max((r for r in fit if r.listed), key=lambda r: len(r.name), default=None)
                pattern = None if rule else min((r for r in fit if not r.listed), key=order.get, default=None)
                by = rule or pattern
                out.append((host, path, rule and rule.name, pattern and pattern.name, by.verdict if by else "allow", len(near)))
            columns = zip(*out, strict=True) if out else [()] * 6
            kinds = [pa.string()] * 5 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "host", "path", "rule", "pattern", "verdict", "n_run"])

    out = urls.mapInArrow(run, f"id {kind}, host string, path string, rule string, pattern string, verdict string, n_run int")
    return out.withColumnRenamed("id", id_col)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
