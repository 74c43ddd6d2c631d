"""URL filter: site rules first, then a weighted vocabulary found with an Aho-Corasick automaton.

A strict term rejects a URL by itself, soft terms when the weights of the distinct ones add up to
`reject_weight`. A term counts only between boundaries: the characters beside it are not ASCII letters or digits.
Terms are looked for in the whole url with its percent-escaped letters and digits decoded; host, path and rules take it as written.
Null and empty URLs have an empty host and path and are allowed; repeated rows are judged one by one;
columns of the input named like a result column are not passed on; very long URLs are searched whole, in one pass; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

#: (host, path prefix, verdict): fixed values of the contract.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Own vocabulary: term -> weight. Terms of STRICT_WEIGHT reject alone.
STRICT_WEIGHT = 2.0
STRICT_TERMS = (
    "adult bdsm blowjob bukkake camgirl camgirls camsex casino casinos cumshot deepfakes dildo ejaculation escort escorts fetish gambling gangbang "
    "hardcore hentai livesex milf nsfw nudist onlyfans orgasm pornhub porn porno pornography redtube rule34 sex sexcam sexy shemale slots "
    "sportsbook striptease swingers threesome upskirt viagra cialis warez xhamster xnxx xvideos xxx youporn"
)
SOFT_TERMS = (
    "ads advert hookup slot affiliate backlink backlinks bet bets betting bingo blackjack bonus bonuses cheap cheats click clickbait coupon coupons crack cracked cracks "
    "dating deal deals debt discount discounts erotic essay essays followers forex free freebies giveaway girls gamble hack hacked jackpot keygen kinky lingerie "
    "likes loan loans lottery lotto mature meds miracle naked nude nudes nulled payday penny pharmacy pill pills pirate poker popup promo promos rapidshare refinance replica "
    "roulette signup singles spam spin spins steroids sweepstakes teen teens tits torrent torrents track tracker tramadol unlocked uncensored webcam "
    "weightloss win winner winners winning xanax"
)
VOCABULARY = dict.fromkeys(STRICT_TERMS.split(), STRICT_WEIGHT) | dict.fromkeys(SOFT_TERMS.split(), 1.0)
REJECT_WEIGHT = 2.0
if len(VOCABULARY) < len(STRICT_TERMS.split()) + len(SOFT_TERMS.split()):
    raise ValueError("a term is both strict and soft, or comes twice")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Percent escapes of ASCII letters and digits; a term written so counts as well.
ESCAPED = "%(3[0-9]|[46][1-9a-f]|[57][0-9a])"
_ESCAPE = re.compile(ESCAPED)
_HOST = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
RESULT = "host string, path string, rule string, verdict string, strict_terms int, soft_terms int, weight double"


def split_url(url: str | None) -> tuple[str, str]:
    start = (url or "").find("://")
    if start < 0:
        return "", ""
    host = _HOST.match(url, start + 3)
    return host[0].translate(_LOWER), _PATH.match(url, host.end())[0]


def site_rule(host: str, path: str, rules: dict) -> tuple[str, str] | None:
    """The longest rule for the host or a domain above it, among those whose path starts the URL's path.
    rules: host -> [(path prefix, verdict)], so the work is a few look-ups however many rules there are."""
    best, at = None, 0
    while True:
        name = host[at:]
        for prefix, verdict in rules.get(name, ()):
            if path.startswith(prefix) and (best is None or len(name + prefix) > len(best[0])):
                best = (name + prefix, verdict)
        at = host.find(".", at) + 1
        if not at:
            return best


@lru_cache(8)
def automaton(vocabulary: tuple):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in vocabulary:
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def searched(url: str | None) -> str:
    """What terms are looked up in: A-Z lower-cased, escaped letters and digits decoded once (`%2565` isn't an e)."""
    low = (url or "").translate(_LOWER)
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)), low).translate(_LOWER) if "%" in low else low


def terms_in(url: str, vocabulary: tuple) -> dict[str, float]:
    """The distinct terms of a lower-cased URL that stand between boundaries."""
    out = {}
    for end, (term, weight) in automaton(vocabulary).iter(url):
        start = end - len(term)
        if (start < 0 or url[start] not in _WORD) and (end + 1 == len(url) or url[end + 1] not in _WORD):
            out[term] = weight
    return out


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, vocabulary=None, reject_weight: float = REJECT_WEIGHT) -> DataFrame:
    """id_col and the columns of RESULT for every row: one pass over the two columns, no shuffle."""
    terms = tuple(sorted((VOCABULARY if vocabulary is None else vocabulary).items()))
    by_host: dict[str, list] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, verdict))
    narrow = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"))
    id_type = narrow.schema["id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule = site_rule(host, path, by_host)
                found = terms_in(searched(url), terms)
                strict = sum(w >= STRICT_WEIGHT for w in found.values())
                weight = float(sum(found.values()))
                rejected = strict > 0 or weight >= reject_weight
                rows.append((host, path, rule and rule[0], rule[1] if rule else "block" if rejected else "allow", strict, len(found) - strict, weight))
            kinds = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.float64()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "host", "path", "rule", "verdict", "strict_terms", "soft_terms", "weight"])

    return map_arrow(narrow, judge, f"id {id_type}, {RESULT}").withColumnRenamed("id", id_col)


def url_filter_sql(vocabulary=None) -> str:
    """The same judgement as DuckDB SQL, term by term."""
    terms = VOCABULARY if vocabulary is None else vocabulary
    hit = lambda t: f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS INTEGER)"
    strict = " + ".join(hit(t) for t, w in terms.items() if w >= STRICT_WEIGHT)
    soft = " + ".join(hit(t) for t, w in terms.items() if w < STRICT_WEIGHT)
    fits = lambda h, p: f"((host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}'))"
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ordered)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ordered)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    low = lower.format("coalesce(url, '')")
    decoded = f"array_to_string(list_transform(regexp_extract_all({low}, '{ESCAPED}|(?s:.)'), lambda x: CASE WHEN length(x) = 3 THEN chr(CAST('0x' || x[2:3] AS INTEGER)) ELSE x END), '')"
    return f"""
WITH a AS (SELECT page_id, {lower.format(decoded)} AS u,
                  CASE WHEN url LIKE '%://%' THEN url[position('://' IN url) + 3 :] ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM a),
c AS (SELECT page_id, u, {lower.format("raw_host")} AS host, regexp_extract(rest[length(raw_host) + 1 :], '^[^?#]*') AS path FROM b),
d AS (SELECT *, {strict} AS strict_terms, {soft} AS soft_terms FROM c)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN strict_terms > 0 OR soft_terms >= 2 THEN 'block' ELSE 'allow' END AS verdict,
       strict_terms, soft_terms, CAST(2.0 * strict_terms + soft_terms AS DOUBLE) AS weight FROM d"""
