"""URL filters: a trie over reversed host labels and path segments.

A rule is (verdict, host, path). It fits its host and every subdomain when
the url's path starts with the rule's path. Of the rules that fit, the one
with the longest host and path text wins (ties: allow before block). The
trie is walked along the labels of the host from the right; at each node
that ends a rule's host, the segments of the path are walked.

Edge cases: a null url, or one without ``://``, has an empty host and path
and fits no rule; it gets the default verdict (allow: the lists only say
what they name). Host labels are compared after lower-casing A-Z; a port is
part of the host, as written. Repeated rows and extra columns are kept; a
column called host, path, rule or verdict is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

#: The trie is broadcast: beyond so many rules it is refused.
MAX_RULES = 1_000_000
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_HOST, _PATHS, _END = 0, 1, 2  # a host node: labels, path trie; a path node: segments, -, {last part: rule}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a url; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:cut].translate(_LOWER), rest[cut:]
    cut = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    return host, rest[:cut]


class RuleTrie:
    def __init__(self, rules: Iterable[tuple[str, str, str]], default: str = "allow"):
        self.root: list = [{}, None]
        self.default = default
        n = 0
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r}")
            if (n := n + 1) > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node[_HOST].setdefault(label, [{}, None])
            if node[_PATHS] is None:
                node[_PATHS] = [{}, {}]
            node = node[_PATHS]
            *whole, last = path.split("/")
            for segment in whole:
                node = node[0].setdefault(segment, [{}, {}])
            old = node[1].get(last)
            if old is None or verdict == "allow":  # a tie: allow
                node[1][last] = (len(host) + len(path), verdict, host.translate(_LOWER) + path)

    def match(self, host: str, path: str) -> tuple[int, str, str] | None:
        """(length, verdict, rule) of the longest rule that fits."""
        best = None
        node = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")) if host else ():
            node = node[_HOST].get(label)
            if node is None:
                break
            at = node[_PATHS]
            for k, segment in enumerate(segments):
                if at is None:
                    break
                for last, rule in at[1].items() if len(at[1]) <= len(segment) else ((segment[:j], at[1].get(segment[:j])) for j in range(len(segment) + 1)):
                    if rule and segment.startswith(last) and (best is None or (rule[0], rule[1] == "allow") > (best[0], best[1] == "allow")):
                        best = rule
                at = at[0].get(segment) if k + 1 < len(segments) else None
        return best


def judge(df: DataFrame, rules: Iterable[tuple[str, str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule (null: none fits) and verdict. The rules
    are a list kept by the caller, checked against MAX_RULES and broadcast;
    a map-only job."""
    trie = df.sparkSession.sparkContext.broadcast(RuleTrie(rules, default))

    def verdicts(urls: pa.Array) -> list[pa.Array]:
        t, out = trie.value, []
        for url in urls.to_pylist():
            host, path = split_url(url)
            best = t.match(host, path)
            out.append((host, path, best and best[2], best[1] if best else t.default))
        return [pa.array(column, pa.string()) for column in (zip(*out) if out else ([],) * 4)]

    return add_columns(df, [url_col], [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")], verdicts, rows=1000)
