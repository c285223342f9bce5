"""URL filter: pattern rules indexed by their rarest literal token.

A URL is read as host and path; rules are matched against ``"." + host + path``. Every rule lists the literal tokens
(runs of a-z and 0-9, lower-cased) that any URL it fits must hold in full. The index files each rule under the one of
them that the fewest URLs of the table hold, so that a URL's own tokens fetch its few candidate rules, and only those
run their regular expressions. Rules without such a token go to a list that every URL tries.

Host rules (``example.org/es/``) fit the host and its subdomains where the path starts with the rule's; the longest
one wins, on equal length the first by code point. Pattern rules have ``*`` for any characters and are tried where no
host rule fits: block beats allow. Where nothing fits the verdict is allow.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no host rule and is allowed unless
a pattern fits "."; repeated rows get a row each; urls of any length are whole; other columns pass through, and an output
name that is among them is refused (``names`` names the outputs); an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import refuse_clash
from .text import LOWER, UPPER

TOKEN = "[a-z0-9]+"
#: Labels of hosts that name what they sell, and parts of paths that hold no prose: adverts, trackers, traps, pirated files.
SOLD = "casino cheap-pills replica-watches online-casino sportsbook slots poker-bonus payday-loans cheap-viagra buy-pills replica-bags xxx porn escorts webcam-girls warez keygen crack-download torrents free-ringtones lottery-winner work-from-home get-rich-quick miracle-diet essay-writers buy-followers link-farm parked-domain"
PARTS = "ads adserver adclick banners doubleclick popunder affiliate tracking.gif pixel.gif free-download serial-keygen cracked warez torrent cgi-bin/redirect wp-login.php xmlrpc.php phpmyadmin .git .env"
#: Patterns that the default filter blocks.
PATTERNS = (*(f"*.{x}.*" for x in SOLD.split()), *(f"*/{x}/*" for x in PARTS.split()))
#: More rules than this are an error: the index goes to every executor, so its size is bounded.
MAX_RULES = 100_000


@dataclass(frozen=True)
class UrlRule:
    text: str
    verdict: str
    kind: str  # host or pattern

    def regex(self) -> str:
        if self.kind == "host":
            return r"\A[^/]*\." + re.escape(self.text)
        return r"(?s)\A" + ".*".join(map(re.escape, self.text.split("*"))) + r"\Z"

    def tokens(self) -> list[str]:
        """Tokens that are whole in every URL that fits: neither end may be open to more token characters."""
        low = self.text.translate(str.maketrans(UPPER, LOWER))
        out = []
        for m in re.finditer(TOKEN, low):
            left = low[m.start() - 1] != "*" if m.start() else True
            right = low[m.end()] != "*" if m.end() < len(low) else self.kind == "pattern"
            if left and right:
                out.append(m[0])
        return sorted(set(out))


def host_rules(allow: Sequence[str] = (), block: Sequence[str] = ()) -> list[UrlRule]:
    return [*(UrlRule(x, "allow", "host") for x in allow), *(UrlRule(x, "block", "host") for x in block)]


def pattern_rules(block: Sequence[str] = PATTERNS, allow: Sequence[str] = ()) -> list[UrlRule]:
    return [*(UrlRule(x, "block", "pattern") for x in block), *(UrlRule(x, "allow", "pattern") for x in allow)]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path columns."""
    cut = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", 1), F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", 2)
    return F.translate(F.coalesce(cut[0], F.lit("")), UPPER, LOWER), F.coalesce(cut[1], F.lit(""))


def token_counts(pages: DataFrame, rules: Sequence[UrlRule], key: str) -> dict[str, int]:
    """How many rows hold each token of the rules: counted over all rows, one number for each token of a rule."""
    wanted = sorted({t for r in rules for t in r.tokens()})
    if not wanted:
        return {}
    low = F.translate(F.col(key), UPPER, LOWER)
    held = F.array_intersect(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)), F.array(*map(F.lit, wanted)))
    got = pages.select(F.explode(held).alias("t")).groupBy("t").count().collect()
    return {r["t"]: r["count"] for r in got}


def build_index(rules: Sequence[UrlRule], counts: dict[str, int]) -> dict[str, list[UrlRule]]:
    """Token to rules; the rules under "" are tried for every URL."""
    index: dict[str, list[UrlRule]] = {}
    for r in rules:
        own = r.tokens()
        index.setdefault(min(own, key=lambda t: (counts.get(t, 0), -len(t), t)) if own else "", []).append(r)
    return index


def url_filter(pages: DataFrame, rules: Sequence[UrlRule], url: str = "url", names: tuple[str, str, str, str] = ("host", "path", "rule", "verdict")) -> DataFrame:
    """``pages`` with four more columns, named by ``names``; the host rule that decided is in the third."""
    refuse_clash(pages, names)
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    host, path = url_parts(F.col(url))
    out = pages.withColumn(names[0], host).withColumn(names[1], path)
    key = out.select(F.concat(F.lit("."), names[0], names[1]).alias("key"))
    index = build_index(rules, token_counts(key, rules, "key"))
    low = str.maketrans(UPPER, LOWER)

    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        token = re.compile(TOKEN)
        ready = {t: [(re.compile(r.regex()), r) for r in rs] for t, rs in index.items()}
        always = ready.get("", [])

        def one(x: str) -> tuple[str | None, str]:
            found = [r for t in set(token.findall(x.translate(low))) if t in ready for p, r in ready[t] if p.match(x)]
            found += [r for p, r in always if p.match(x)]
            if own := [r for r in found if r.kind == "host"]:
                best = min(own, key=lambda r: (-len(r.text), r.text))
                return best.text, best.verdict
            return None, "block" if any(r.verdict == "block" for r in found) else "allow"

        for s in batches:
            yield pd.DataFrame([one(x) for x in s], columns=["rule", "verdict"])

    judged = F.pandas_udf(decide, "rule string, verdict string")
    return out.withColumn("_url_judged", judged(F.concat(F.lit("."), names[0], names[1]))).withColumn(names[2], F.col("_url_judged.rule")).withColumn(names[3], F.col("_url_judged.verdict")).drop("_url_judged")
