"""URL verdicts from rules that are indexed by their rarest literal token.

Two kinds of rules: host and path rules (`example.org/es/` holds for the host, its subdomains and every path
that begins so; the longest one wins), and patterns (regular expressions with the literal tokens that any
match must contain), which judge what no host rule fits.  Each rule is filed under the one of its literal
tokens that is rarest in the table.  A URL's tokens fetch the candidates; only those are tried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainkit.llm.common import map_rows

HOST_PATH = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
TOKEN = re.compile(r"[a-z0-9]+")  # of lower-cased text; every other sign, letters of other alphabets too, ends a token as it does in patterns
TOKEN_SPLIT = r"[^a-z0-9]+"
RULES_AT_ONCE = 200_000  # rules in one broadcast; more are applied in several passes

ALLOW, BLOCK = "allow", "block"
#: The contract's host and path rules.
HOST_RULES = [("org/", ALLOW), ("example.org/es/", BLOCK), ("example.org/en/1", BLOCK), ("com/fr/", ALLOW), ("com/de/", BLOCK)]
#: The method's own list, in the syntax of `parse_filter`; any table of such lines does.
FILTERS = [rf"/(^|[^a-z0-9]){word}([^a-z0-9]|$)/{word}" for word in ("casino", "pills", "bets", "adult", "spam", "ads")]


def parse_filter(line: str | None) -> tuple[str, list[str], str] | None:
    """(regular expression over lower-cased host and path, literal tokens of any match, verdict) of one line of a filter list.

    `||` begins at a host or below it, `|` at the start or end, `^` is a sign or the end, `*` anything, `@@` allows,
    `/expression/tokens` is a regular expression with tokens (runs of a-z and 0-9, nothing like them beside them) that any match has, `!` begins
    a comment; what follows `$` is left out.  None for other lines.
    """
    line = (line or "").strip().lower()
    if not line or line[0] in "![" or "##" in line:
        return None
    verdict, line = (ALLOW, line[2:]) if line.startswith("@@") else (BLOCK, line)
    if line.startswith("/") and "/" in line[1:]:
        expression, _, tokens = line[1:].rpartition("/")
        try:
            re.compile(expression)
        except re.error:
            return None
        return expression, TOKEN.findall(tokens), verdict
    body = line.partition("$")[0]
    start, stop = "", ""
    if body.startswith("||"):
        start, body = r"^([^/]*\.)?", body[2:]
    elif body.startswith("|"):
        start, body = "^", re.sub(r"^[a-z]+://", "", body[1:])
    if body.endswith("|"):
        stop, body = "$", body[:-1]
    if not body.strip("*"):
        return None
    # A run of letters and digits is a whole token of any match if a sign or an anchor stands on either side.
    runs = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(body)]
    whole = [t for a, b, t in runs if (a > 0 and body[a - 1] != "*" or a == 0 and start) and (b < len(body) and body[b] != "*" or b == len(body) and stop)]
    pieces = {"*": ".*", "^": r"([^a-z0-9_.%-]|$)"}
    return start + "".join(pieces.get(c, re.escape(c)) for c in body) + stop, whole, verdict


def read_filters(lines: DataFrame, line_col: str = "line") -> list[tuple[str, list[str], str]]:
    """The patterns of a table with one line of a filter list per row; rules are broadcast, so the driver holds the list."""
    found = lines.select(F.col(line_col).alias("line")).where("line IS NOT NULL").distinct().orderBy("line").collect()
    return [f for f in (parse_filter(r["line"]) for r in found) if f is not None]


PATTERNS = [f for f in map(parse_filter, FILTERS) if f is not None]


def host_and_path(url: str | None) -> tuple[str, str]:
    found = HOST_PATH.search(url or "")
    return (found[1].translate(UPPER), found[2]) if found else ("", "")


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule_tokens(rule: str) -> list[str]:
    """Tokens that every URL of a host and path rule has; a path's last piece may go on, so it is none."""
    host, _, path = rule.lower().partition("/")
    pieces = TOKEN.findall(path)
    if pieces and path.endswith(pieces[-1]):
        pieces.pop()
    return TOKEN.findall(host) + pieces


class RuleIndex:
    """Rules by their rarest literal token; rules without any literal are tried on every URL."""

    def __init__(self, host_rules: Iterable[tuple[str, str]], patterns: Iterable[tuple[str, list[str], str]], frequency: Counter):
        self.by_token: dict[str, list[tuple]] = {}
        self.always: list[tuple] = []
        for rule, verdict in host_rules:
            host, _, path = rule.partition("/")
            self._file((True, rule, host.lower(), "/" + path, verdict), rule_tokens(rule), frequency)
        for pattern, tokens, verdict in patterns:
            self._file((False, pattern, re.compile(pattern), None, verdict), tokens, frequency)

    def _file(self, rule: tuple, tokens: list[str], frequency: Counter) -> None:
        if tokens:
            self.by_token.setdefault(min(tokens, key=lambda t: (frequency[t], t)), []).append(rule)
        else:
            self.always.append(rule)

    def judge(self, host: str, path: str) -> tuple[str | None, str | None, str | None]:
        """(longest host rule, its verdict, verdict of the patterns)."""
        best = ("", None)
        blocked = allowed = False
        candidates = list(self.always)
        whole = (host + path).lower()
        for token in set(TOKEN.findall(whole)):
            candidates += self.by_token.get(token, ())
        for is_host, text, head, tail, verdict in candidates:
            if is_host:
                if (host == head or host.endswith("." + head)) and path.startswith(tail) and (-len(text), text) < (-len(best[0]), best[0]):
                    best = (text, verdict)
            elif head.search(whole):
                blocked, allowed = blocked or verdict == BLOCK, allowed or verdict == ALLOW
        return (best[0] or None), best[1], (BLOCK if blocked else ALLOW if allowed else None)


def token_frequencies(urls: DataFrame, url_col: str, tokens: set[str]) -> Counter:
    """Rows in which each literal of the rules occurs; the result is bounded by the rules."""
    if not tokens:
        return Counter()
    session = urls.sparkSession
    wanted = session.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    whole = F.lower(F.concat(host_of(F.col(url_col)), path_of(F.col(url_col))))
    seen = urls.select(F.explode(F.array_distinct(F.split(whole, TOKEN_SPLIT))).alias("token"))
    # Only the rules' own tokens are grouped.
    counts = seen.join(F.broadcast(wanted) if len(tokens) <= RULES_AT_ONCE else wanted, "token").groupBy("token").count()
    return Counter({r["token"]: r["count"] for r in counts.collect()})



def _judge(index: RuleIndex) -> Callable:
    def judge(inputs: list[pa.Array]) -> list[pa.Array]:
        out = []
        for url in inputs[0].to_pylist():
            host, path = host_and_path(url)
            out.append((host, path, *index.judge(host, path)))
        return [pa.array(c, pa.string()) for c in zip(*out, strict=True)]

    return judge


def judge_urls(
    pages: DataFrame,
    carry: list[Column],
    url_col: str = "url",
    host_rules: list[tuple[str, str]] = HOST_RULES,
    patterns: list[tuple[str, list[str], str]] = PATTERNS,
    default: str = ALLOW,
    rules_at_once: int = RULES_AT_ONCE,
) -> DataFrame:
    """`carry` as c0, c1, ... with host, path, rule, verdict: one row per input row; the URLs are not shuffled.

    The longest fitting host rule decides (of equally long ones the first in text order).  Where none fits,
    rule is null: a blocking pattern blocks, else an allowing one allows, else `default` holds.  A null URL, or
    one without `://`, has an empty host and path.  Very long URLs are read whole; repeated rows are judged each; carried
    columns may have any names.  An empty table gives an empty result.
    """
    tokens = {t for rule, _ in host_rules for t in rule_tokens(rule)} | {t for _, ts, _ in patterns for t in ts}
    frequency = token_frequencies(pages, url_col, tokens)
    context = pages.sparkSession.sparkContext
    fields = "host string, path string, rule string, by_rule string, by_pattern string"
    rows, n = None, len(carry)
    for at in range(0, max(len(host_rules), len(patterns), 1), rules_at_once):
        part = slice(at, at + rules_at_once)
        shared = context.broadcast(RuleIndex(host_rules[part], patterns[part], frequency))
        if rows is None:
            rows = map_rows(pages, [*carry, F.col(url_col)], [F.col(url_col)], lambda s=shared: _judge(s.value), fields)
            continue
        held = [F.col(f"c{i}") for i in range(n + 1)]
        more = map_rows(rows, [*held, *map(F.col, ("host", "path", "rule", "by_rule", "by_pattern"))], [F.col(f"c{n}")], lambda s=shared: _judge(s.value), fields)
        before, a, b = n + 1, F.col(f"c{n + 3}"), F.col("rule")
        newer = b.isNotNull() & (a.isNull() | (F.length(b) > F.length(a)) | ((F.length(b) == F.length(a)) & (b < a)))
        old_verdict, old_pattern = F.col(f"c{before + 3}"), F.col(f"c{before + 4}")
        rows = more.select(
            *held,
            "host",
            "path",
            F.when(newer, b).otherwise(a).alias("rule"),
            F.when(newer, F.col("by_rule")).otherwise(old_verdict).alias("by_rule"),
            F.when((old_pattern == BLOCK) | (F.col("by_pattern") == BLOCK), BLOCK).otherwise(F.coalesce(old_pattern, "by_pattern")).alias("by_pattern"),
        )
    return rows.select(*[f"c{i}" for i in range(n)], "host", "path", "rule", F.coalesce("by_rule", "by_pattern", F.lit(default)).alias("verdict"))
