"""URL filter: host rules, then pattern rules indexed by their rarest literal token.

A pattern is literal text with two signs: ``*`` for any characters and ``^`` for a separator
(anything but letters, digits and ``_-.%``) or the end.  A run of letters and digits in it is
a token of every URL it fits, if the pattern bounds it on both sides.  Each rule is filed
under the one of its tokens that is rarest in the URLs at hand; a URL's tokens fetch the
rules filed under them, and only these run their regular expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayrisk.llm.common import lower_ascii, map_column


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    pattern: str
    allow: bool = False

    @property
    def regex(self) -> str:
        signs = {"*": ".*", "^": r"([^a-z0-9_.%-]|$)"}
        return "".join(signs.get(c) or re.escape(c) for c in self.pattern)

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that stand alone in every URL the pattern fits."""
        return [m[0] for m in re.finditer(r"[a-z0-9]+", self.pattern) if self._bound(m.start() - 1) and self._bound(m.end())]

    def _bound(self, at: int) -> bool:
        return 0 <= at < len(self.pattern) and self.pattern[at] != "*"


# --- fixed values -------------------------------------------------------------
HOST_RULES = (
    HostRule("org", "/", True),
    HostRule("example.org", "/es/", False),
    HostRule("example.org", "/en/1", False),
    HostRule("com", "/fr/", True),
    HostRule("com", "/de/", False),
)
PATTERN_RULES = tuple(
    PatternRule(p)
    for p in ("/ads/", "/banner^", "^casino^", "^poker^", "^porn^", "^xxx^", "/login^", "/cart^", "/checkout^", "/wp-admin/", "/tracking^*^pixel^", "^sessionid=", "^phpsessid=", "^page=*^ref=")
) + (PatternRule("/education/", allow=True), PatternRule("^gov^", allow=True))
# --------------------------------------------------------------------------------
URL_TOKEN = "[a-z0-9]+"


def token_counts(urls: DataFrame, rules: tuple[PatternRule, ...], url: str = "url") -> dict[str, int]:
    """How often each token of the rules occurs in the URLs; at most one count per token."""
    wanted = sorted({t for r in rules for t in r.tokens})
    found = urls.select(F.explode(F.regexp_extract_all(lower_ascii(F.col(url)), F.lit(URL_TOKEN), F.lit(0))).alias("token"))
    rows = found.where(F.col("token").isin(wanted)).groupBy("token").count().collect() if wanted else []
    return {r["token"]: r["count"] for r in rows}


class Judge:
    def __init__(self, hosts: tuple[HostRule, ...], patterns: tuple[PatternRule, ...], counts: dict[str, int]):
        self.hosts: dict[str, list[HostRule]] = {}
        for h in hosts:
            self.hosts.setdefault(h.host, []).append(h)
        self.filed: dict[str, list[tuple[re.Pattern, bool]]] = {}
        self.unfiled: list[tuple[re.Pattern, bool]] = []
        for p in patterns:
            tokens = sorted(p.tokens, key=lambda t: (counts.get(t, 0), t))
            (self.filed.setdefault(tokens[0], []) if tokens else self.unfiled).append((re.compile(p.regex, re.S), p.allow))
        self.tokens = re.compile(URL_TOKEN)
        self.lower = {c: c + 32 for c in range(65, 91)}

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        host, path = self.parts(url)
        rule = self.host_rule(host, path)
        allow = rule.allow if rule else self.patterns_allow(url)
        return host, path, rule.name if rule else None, "allow" if allow else "block"

    def parts(self, url: str | None) -> tuple[str, str]:
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        return rest[:cut].translate(self.lower), re.split("[?#]", rest[cut:], maxsplit=1)[0]

    def host_rule(self, host: str, path: str) -> HostRule | None:
        names, best = host.split("."), None
        for k in range(len(names)):
            for rule in self.hosts.get(".".join(names[k:]), ()):
                if path.startswith(rule.path) and (best is None or len(rule.name) > len(best.name)):
                    best = rule
        return best

    def patterns_allow(self, url: str | None) -> bool:
        """Without a fitting pattern a URL is allowed; an allowing pattern outdoes a blocking one."""
        low, blocked = (url or "").translate(self.lower), False
        candidates = list(self.unfiled)
        for token in set(self.tokens.findall(low)):
            candidates += self.filed.get(token, ())
        for regex, allow in candidates:
            if (allow or not blocked) and regex.search(low):
                if allow:
                    return True
                blocked = True
        return not blocked


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    keep: list[str] | None = None,
    hosts: tuple[HostRule, ...] = HOST_RULES,
    patterns: tuple[PatternRule, ...] = PATTERN_RULES,
) -> DataFrame:
    """Columns ``keep`` plus ``host, path, rule, verdict`` of every URL.

    The longest host rule that fits decides (``rule`` names it); else the patterns do.  A
    null URL, or one without ``://``, has an empty host and path.
    """
    counts = token_counts(pages, patterns, url)

    def start():
        judge = Judge(hosts, patterns, counts).judge
        return lambda urls: [list(c) for c in zip(*map(judge, urls), strict=True)] if urls else [[]] * 4

    kinds = [(n, "string", pa.string()) for n in ("host", "path", "rule", "verdict")]
    return map_column(pages, pages.columns if keep is None else keep, url, start, kinds)
