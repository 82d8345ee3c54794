"""URL filter: pattern rules found through their rarest literal token.

A rule can fit only a url that has all of the rule's literal tokens. Each rule is filed under the
one of them that the fewest urls have, counted over the whole table. A url's tokens fetch the rules
filed under them, and only those rules' expressions run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longitab.llm.common import bounded_batches

_TOKEN = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_URL = re.compile(r"(?s).*?://([^/?#]*)([^?#]*)")
#: Words that stand for unwanted hosts when no host rule fits.
UNWANTED = ("spam", "casino", "pills", "viagra", "porn", "phishing", "malware", "warez")


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains when the path starts with ``path``. The longest rule wins,
    then the longer host, then the smaller verdict."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def tokens(self) -> set[str]:
        """Tokens of the host, and of the path but its last, which may go on in a url."""
        path = _TOKEN.findall(self.path.translate(_LOWER))
        if path and _TOKEN.fullmatch(self.path.translate(_LOWER)[-1]):
            path.pop()
        return set(_TOKEN.findall(self.host)) | set(path)

    def fits(self, host: str, path: str) -> bool:
        return (host == self.host or host.endswith("." + self.host)) and path.startswith(self.path)

    @property
    def rank(self) -> tuple:
        return -len(self.name), -len(self.host), self.verdict


@dataclass(frozen=True)
class PatternRule:
    """An expression searched in ``host + path`` when no host rule fits; a fit that contains the
    ``tokens``. The longest expression wins, then the smaller verdict."""

    expression: str
    tokens: frozenset[str]
    verdict: str

    def fits(self, host: str, path: str) -> bool:
        return re.search(self.expression, host + path) is not None

    @property
    def rank(self) -> tuple:
        return -len(self.expression), self.expression, self.verdict


def host_words(words=UNWANTED, verdict: str = "block") -> list[PatternRule]:
    """Rules for words that are a whole part of a host name between dots and hyphens."""
    return [PatternRule(rf"^(?:[^/]*[.-])?{re.escape(w)}(?:[.-]|/|$)", frozenset([w]), verdict) for w in words]


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z in lower case, and path. Without ``://`` both are empty."""
    m = _URL.match(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def tokens_of(host: str, path: str) -> set[str]:
    return set(_TOKEN.findall((host + path).translate(_LOWER)))


def judge(host: str, path: str, index: dict, default: str) -> tuple[str | None, str]:
    """Name of the host rule that wins, and the verdict."""
    fetched = [r for t in tokens_of(host, path) for r in index.get(t, ())]
    fetched += index.get(None, ())
    for kind in (HostRule, PatternRule):
        fit = min((r for r in fetched if type(r) is kind and r.fits(host, path)), key=lambda r: r.rank, default=None)
        if fit:
            return (fit.name if kind is HostRule else None), fit.verdict
    return None, default


def filter_urls(pages: DataFrame, hosts: list[HostRule], patterns: list[PatternRule] | None = None,
                default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule`` (of a host rule, else null),
    ``verdict``.

    A null url, or one without ``://``, has an empty host and path and gets ``default`` unless a
    rule without tokens fits. Repeated rows each give a row. Other columns are ignored. The rules
    are a parameter of the call and go to every task.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    rules = [*hosts, *(host_words() if patterns is None else patterns)]
    wanted = frozenset(t for r in rules for t in r.tokens)
    urls = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))

    def count(batches):
        for batch in batches:
            n = {}
            for url in batch.column(0).to_pylist():
                for t in tokens_of(*split_url(url)) & wanted:
                    n[t] = n.get(t, 0) + 1
            yield pa.record_batch({"token": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})

    counts = urls.select("url").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    seen = {r.token: r.n for r in counts.collect()}  # at most the tokens of the rules
    index: dict = {}
    for r in rules:
        key = min(r.tokens, key=lambda t: (seen.get(t, 0), t), default=None)
        index.setdefault(key, []).append(r)
    schema = pa.schema([("id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()),
                        ("verdict", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for page, url in zip(*(batch.column(c).to_pylist() for c in range(2))):
                host, path = split_url(url)
                rows.append((page, host, path, *judge(host, path, index, default)))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else
                                  [pa.array([], f.type) for f in schema], schema=schema)

    return urls.mapInArrow(run, "id long, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
