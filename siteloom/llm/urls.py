"""URL filters: pattern rules indexed by their rarest literal token.

Rules are lines of a filter list:

* ``*`` is any text, ``^`` a separator: anything but an ASCII letter or digit, or the URL's start or end;
* ``||`` at the front is the start of the host or of one of its labels, ``|`` at the front or the end is the URL's start or end;
* ``@@`` in front makes an exception: a URL that it fits is allowed whatever blocks it;
* ``/.../`` is a regular expression; lines that begin with ``!`` or ``#`` are comments; anything else is literal text.

Patterns are tried on the URL with A-Z lower-cased, so case is ignored for ASCII letters alone. A run of letters and digits of a
pattern that other characters or separators bound on both sides is a token that every fitting URL holds. Token frequencies are counted
over all URLs; a rule is filed under its rarest token. A URL's tokens fetch the candidate rules, and only those run their
expression, so the cost of a URL does not grow with the number of rules. Rules without a token run on every URL.

Rules are sent to the tasks in parts of ``PART_RULES``; each part judges all URLs and the best verdict of all parts holds, so
there is no limit on their number.

Defined results: a null URL, or one without ``://``, has empty host and path and is allowed; equal URLs have
equal verdicts; an empty table gives no rows; other columns pass through; clashing names raise ``ValueError``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F, types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that are sent to a task at once.
PART_RULES = 100_000
#: Tokens that are looked for as a literal list; more are joined.
FEW_TOKENS = 64
TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = str.maketrans(UPPER, LOWER)


class Rule(NamedTuple):
    name: str
    verdict: str
    pattern: str  # searched in the lower-cased URL, or in host + path where ``place``
    tokens: tuple[str, ...]  # lower-case runs of a-z and 0-9 in every match, bounded on both sides
    tier: int = 0  # a lower tier decides first
    weight: int = 0  # in a tier the largest decides
    place: bool = False


def site_rule(site: str, verdict: str, tier: int = 0) -> Rule:
    """A rule for a host, its subdomains and a path prefix, such as ``example.com/en/7``. The path's case counts."""
    host, slash, path = site.partition("/")
    pattern = r"\A(?:[^/]*\.)?" + re.escape(host) + (re.escape(slash + path) if slash else r"(?![^/])")
    whole = TOKEN.findall(host) + [t.group() for t in TOKEN.finditer(path.translate(_LOWER)) if t.end() < len(path)]
    return Rule(site, verdict, pattern, tuple(dict.fromkeys(whole)), tier, len(site), True)


#: What ``^`` and ``||`` stand for, in the syntax that Python's and RE2's expressions share.
SEPARATOR, LABEL = r"(?:[^a-z0-9]|^|$)", r"^[a-z][a-z0-9+.\-]*://(?:[^/?#]*[.@])?"


def parse_rule(line: str) -> Rule | None:
    """The rule of a line of a filter list; None for a comment or an empty line. Exceptions are tier 1, blocks tier 2."""
    line = line.strip()
    if not line or line[0] in "!#":
        return None
    allow = line.startswith("@@")
    body = line[2 * allow :].translate(_LOWER)
    verdict, tier = ("allow", 1) if allow else ("block", 2)
    if len(body) > 2 and body[0] == body[-1] == "/" and re.search(r"[\\^$.|?*+()\[\]{}]", body[1:-1]):
        return Rule(line, verdict, line[2 * allow + 1 : -1], (), tier, len(line))
    label = body.startswith("||")
    start = not label and body.startswith("|")
    body = body[2 * label + start :]
    end = body.endswith("|")
    body = body[: len(body) - end]
    pattern = LABEL if label else "^" if start else ""
    for part in re.split(r"([*^])", body):
        pattern += ".*" if part == "*" else SEPARATOR if part == "^" else re.escape(part)
    pattern += "$" if end else ""
    # A run is a whole token if what stands beside it cannot be a letter or digit.
    tokens = [t.group() for t in TOKEN.finditer(body) if (label or start if t.start() == 0 else body[t.start() - 1] != "*") and (end if t.end() == len(body) else body[t.end()] != "*")]
    return Rule(line, verdict, pattern, tuple(dict.fromkeys(tokens)), tier, len(line))


def parse_list(lines: Iterable[str]) -> tuple[Rule, ...]:
    """The rules of a filter list, each line once."""
    return tuple(dict.fromkeys(r for r in map(parse_rule, lines) if r))


#: What the method blocks by itself: spam, gambling, adult, malware and advertising hosts and paths.
METHOD_LINES = """
^spam^
^cheap-pills^
^online-pharmacy^
^casino^
^poker^
^betting^
^jackpot^
^payday-loan^
^payday-loans^
^viagra^
^cialis^
^porn^
^xxx^
^escort^
^escorts^
^warez^
^keygen^
^torrent^
^torrents^
^malware^
^phishing^
^free-download-crack^
^clickbait^
||adserver^
||doubleclick^
||ads.*^banner^
/wp-content/uploads/*.exe|
^download^*^setup.exe^
@@^anti-spam^
@@^malware-removal^
@@^phishing-awareness^
""".strip().split("\n")
METHOD_RULES = parse_list(METHOD_LINES)


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url):
    """Behind the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(df: DataFrame, url: str, tokens: set[str]) -> dict[str, int]:
    """In how many of all URLs each of the rules' tokens is found: one row for each such token at most."""
    if not tokens:
        return {}
    parts = F.array_distinct(F.split(F.translate(F.col(url), UPPER, LOWER), "[^a-z0-9]+"))
    wanted = F.array_intersect(parts, F.array(*[F.lit(t) for t in sorted(tokens)])) if len(tokens) <= FEW_TOKENS else parts
    found = df.select(F.explode(wanted).alias("token"))
    if len(tokens) > FEW_TOKENS:
        # Sent to every task like the rules themselves, whose tokens these are.
        found = found.join(F.broadcast(df.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "token string")), "token")
    return {r.token: r.n for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}


def index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules by their rarest token, and those without a token."""
    by_token: dict[str, list[int]] = {}
    always: list[int] = []
    for k, rule in enumerate(rules):
        if rule.tokens:
            by_token.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(k)
        else:
            always.append(k)
    return by_token, always


class Judge:
    """The rules of a part with their index; expressions are compiled when they first run."""

    def __init__(self, rules: tuple[Rule, ...], counts: dict[str, int]):
        self.rules = rules
        self.by_token, self.always = index(rules, counts)
        self.order = [(r.tier, -r.weight, r.name) for r in rules]
        self.tests: dict[int, object] = {}

    def fits(self, k: int, url: str, place: str) -> bool:
        test = self.tests.get(k)
        if test is None:
            test = self.tests[k] = re.compile(self.rules[k].pattern, re.S).search
        return test(place if self.rules[k].place else url) is not None

    def best(self, url: str, place: str) -> Rule | None:
        """The rule that decides; candidates are tried in order of precedence."""
        tokens = set(TOKEN.findall(url))
        found = sorted((k for k in (*self.always, *(k for t in tokens for k in self.by_token.get(t, ())))), key=self.order.__getitem__)
        return next((self.rules[k] for k in found if self.fits(k, url, place)), None)


RESULT = T.StructType([T.StructField("tier", T.IntegerType()), T.StructField("order", T.IntegerType()), T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])


def judge(df: DataFrame, rules: tuple[Rule, ...], url: str = "url") -> DataFrame:
    """Add host, path, rule (of the deciding rule, else null), tier and verdict."""
    added = ("host", "path", "rule", "tier", "verdict")
    if taken := set(added) & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(taken)} exist already")
    counts = token_counts(df, url, {t for r in rules for t in r.tokens})
    at = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    found = []
    for k in range(0, max(1, len(rules)), PART_RULES):
        shared = df.sparkSession.sparkContext.broadcast(Judge(tuple(rules[k : k + PART_RULES]), counts))

        @F.pandas_udf(RESULT)
        def run(urls, places):
            import pandas as pd

            best = shared.value.best  # noqa: B023
            hits = [best(u, p) if u is not None else None for u, p in zip(urls, places)]
            columns = {"tier": [h and h.tier for h in hits], "order": [h and -h.weight for h in hits], "rule": [h and h.name for h in hits], "verdict": [h and h.verdict for h in hits]}
            return pd.DataFrame({n: pd.Series(x, dtype="Int32" if n in ("tier", "order") else object) for n, x in columns.items()})

        subject = F.when(F.instr(F.col(url), "://") > 0, F.translate(F.col(url), UPPER, LOWER))
        found.append(F.when(subject.isNotNull(), run(subject, F.concat("host", "path"))))
    # Of several parts the first in order decides; a part without a hit has a null tier.
    best = found[0] if len(found) == 1 else F.array_min(F.filter(F.array(*found), lambda h: h["tier"].isNotNull()))
    out = at.withColumn("_judged", best)
    return out.select(*df.columns, "host", "path", "_judged.rule", "_judged.tier", F.coalesce("_judged.verdict", F.lit("allow")).alias("verdict"))
