"""URL verdicts from host and path rules and a weighted vocabulary.

Rules name a host and a path prefix; the longest that fits decides. URLs without a rule go through
one Aho-Corasick automaton over the vocabulary: a term counts where it is bounded by characters
that are no ASCII letters or digits. One strict term rejects; so do several distinct soft terms, as
many as it takes for their weights to reach a sum. The vocabulary is a parameter, or a table.

Scale: a map over rows without any exchange, linear in a URL's length; automaton and rules are of the
size of their lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.shipping import ship

from .common import slices, tidied

#: (host, path, verdict)
DEFAULT_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: (term, strict, weight): any strict term rejects, soft ones together. The built-in words are a start for tests and small
#: crawls; vocabulary_table() takes others from a table.
VOCABULARY = (
    # Sex.
    *((t, True, 9) for t in ("porn", "porno", "pornhub", "xxx", "xvideos", "adult-x", "camgirls", "escorts", "hentai", "milf", "sexcam", "sex-chat")),
    *((t, False, 3) for t in ("adult", "nude", "nudes", "sex", "sexy", "erotic", "fetish", "webcam", "hookup")),
    # Gambling.
    *((t, True, 8) for t in ("casino", "jackpot", "free-bets", "slot-machine", "sportsbook", "roulette", "blackjack")),
    *((t, False, 3) for t in ("poker", "slots", "bets", "bet", "betting", "lottery", "bingo", "wager")),
    # Medicines without a doctor.
    *((t, True, 9) for t in ("viagra", "cialis", "cheap-pills", "levitra", "tramadol", "no-prescription")),
    *((t, False, 2) for t in ("pills", "pharmacy", "meds", "steroids", "weight-loss", "diet-pill")),
    # Stolen goods and harmful programs.
    *((t, True, 8) for t in ("warez", "malware", "phishing", "keylogger", "ransomware", "botnet", "carding")),
    *((t, False, 3) for t in ("keygen", "torrent", "torrents", "crack", "cracked", "serial-key", "nulled", "replica")),
    *((t, False, 2) for t in ("hack", "hacks", "cheats", "unlocker", "proxy-list")),
    # Spam, advertising and loans.
    *((t, True, 8) for t in ("spam-farm", "ads-track", "link-farm", "click-fraud")),
    *((t, False, 3) for t in ("spam", "tracker", "adserver", "doubleclick")),
    *((t, False, 2) for t in ("cheap", "free", "win", "ads", "track", "bonus", "loan", "loans", "payday", "dating", "farm", "click", "clicks", "promo", "discount", "crypto", "airdrop", "popunder")),
    *((t, False, 1) for t in ("deal", "deals", "offer", "offers", "coupon", "coupons", "sale", "buy", "shop", "gift", "prize", "cash", "credit", "best", "top", "hot")),
)
#: Distinct soft terms reject when there are so many, and their weights add up to so much.
MIN_SOFT, SOFT_WEIGHT = 2, 4
#: Terms of a table that the driver takes at most; a longer one is an error.
MAX_TERMS = 1_000_000

_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): after the first :// up to one of / ? #, A-Z lower-cased; then up to ? or #. Else both empty."""
    if not url:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    for sign in "#?":
        cut = rest.find(sign)
        if cut >= 0:
            rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path


class RuleSet:
    """The longest of the rules that fit a host and path; of equally long ones, the one with the longer host."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host.translate(_LOWER), []).append((path, host + path, verdict))
        self.sizes = sorted({len(h) for h in self.by_host if h})

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[int, int] = (-1, -1)
        found: tuple[str | None, str | None] = (None, None)
        for size in self.sizes:
            # Only ends of the host that are as long as a rule's host can be one.
            if size > len(host) or (size < len(host) and host[-size - 1] != "."):
                continue
            for prefix, name, verdict in self.by_host.get(host[-size:], ()):
                if path.startswith(prefix) and (len(name), size) > best:
                    best, found = (len(name), size), (name, verdict)
        return found


def vocabulary_table(terms: DataFrame, most: int = MAX_TERMS) -> tuple[tuple[str, bool, int], ...]:
    """A vocabulary from a table (term, strict, weight): of a term's rows a strict one counts, then the heaviest. Empty and null terms are left out."""
    rows = terms.where("length(term) > 0").groupBy(F.lower("term").alias("term")).agg(F.max(F.struct("strict", "weight")).alias("w"))
    found = rows.select("term", "w.*").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} terms")
    return tuple(sorted((r["term"], bool(r["strict"]), int(r["weight"] or 0)) for r in found))


class Vocabulary:
    def __init__(self, terms):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, strict, weight in terms:
            self.automaton.add_word(term.translate(_LOWER), (len(term), term, strict, weight))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, url: str | None) -> tuple[int, int, int, int]:
        """Distinct strict terms and soft terms, and the sums of their weights."""
        if not url or not len(self.automaton):
            return 0, 0, 0, 0
        low = url.translate(_LOWER)
        found = {}
        for end, (size, term, strict, weight) in self.automaton.iter(low):
            start = end - size + 1
            if (start and low[start - 1] in _ALNUM) or (end + 1 < len(low) and low[end + 1] in _ALNUM):
                continue
            found[term] = (strict, weight)
        hard, soft = [w for s, w in found.values() if s], [w for s, w in found.values() if not s]
        return len(hard), len(soft), sum(hard), sum(soft)


_OUT = "id bigint, host string, path string, rule string, verdict string, strict_hits int, soft_hits int, weight bigint"


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=DEFAULT_RULES, vocabulary=VOCABULARY, min_soft: int = MIN_SOFT, soft_weight: int = SOFT_WEIGHT
) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, strict_hits, soft_hits, weight (of all distinct terms).

    A null URL and one without :// have an empty host and path, fit no rule and are judged by the
    vocabulary alone (null: allow). Repeated and null ids are returned as they come; an empty table
    gives an empty result; other columns are not read.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, terms = RuleSet(rules), Vocabulary(vocabulary)
        for batch in slices(batches):
            out = ([], [], [], [], [], [], [])
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule, verdict = known.find(host, path)
                n_strict, n_soft, hard, soft = terms.hits(url)
                verdict = verdict or ("block" if n_strict or (n_soft >= min_soft and soft >= soft_weight) else "allow")
                for column, value in zip(out, (host, path, rule, verdict, n_strict, n_soft, hard + soft)):
                    column.append(value)
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64())
            names = ["id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "weight"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types))], names)

    ship(pages.sparkSession)
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    return source.mapInArrow(tidied(judge), _OUT).withColumnRenamed("id", id_col)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def judge_sql(rules=DEFAULT_RULES, vocabulary=VOCABULARY, min_soft: int = MIN_SOFT, soft_weight: int = SOFT_WEIGHT, table: str = "pages") -> str:
    """DuckDB SQL for the same verdicts."""
    lower = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def pattern(term: str) -> str:
        escaped = "".join(c if c.isalnum() else "\\" + c for c in term)
        return _quoted(f"(^|[^a-z0-9]){escaped}([^a-z0-9]|$)")

    terms = ", ".join(f"({pattern(t)}, {strict}, {weight})" for t, strict, weight in vocabulary)
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    fits = [f"WHEN (host = {_quoted(h)} OR suffix(host, {_quoted('.' + h)})) AND starts_with(path, {_quoted(p)}) THEN " for h, p, _ in ordered]
    rule = " ".join(f + _quoted(h + p) for f, (h, p, _) in zip(fits, ordered))
    verdict = " ".join(f + _quoted(v) for f, (_, _, v) in zip(fits, ordered))
    return rf"""
        WITH v AS (SELECT * FROM (VALUES {terms}) AS x(pattern, strict, weight)),
        a AS (SELECT page_id, url, {lower} AS low,
            CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)([^?#]*)', ['h', 'p']) END AS parts FROM {table}),
        u AS (SELECT DISTINCT low FROM a),
        n AS (SELECT low, count(*) FILTER (strict)::INT AS strict_hits, count(*) FILTER (NOT strict)::INT AS soft_hits,
            sum(weight)::BIGINT AS weight, coalesce(sum(weight) FILTER (NOT strict), 0) AS soft FROM u JOIN v ON regexp_matches(low, pattern) GROUP BY low),
        b AS (SELECT page_id, translate(coalesce(parts.h, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(parts.p, '') AS path,
            coalesce(strict_hits, 0) AS strict_hits, coalesce(soft_hits, 0) AS soft_hits, coalesce(weight, 0) AS weight, coalesce(soft, 0) AS soft FROM a LEFT JOIN n USING (low))
        SELECT page_id, host, path, CASE {rule} END AS rule,
            CASE {verdict} WHEN strict_hits > 0 OR (soft_hits >= {min_soft} AND soft >= {soft_weight}) THEN 'block' ELSE 'allow' END AS verdict,
            strict_hits, soft_hits, weight FROM b"""
