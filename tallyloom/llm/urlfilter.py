"""URL filters: a trie over reversed host labels, then path segments, broadcast to the executors.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's. Of the rules that fit,
the one with the most host labels wins, then the one with the longest path; of an allow and a block entry with the
same host and path, block wins. Where no rule fits, the verdict is the default one (allow).

Defined cases: null urls and urls without ``://`` have an empty host and path; very long urls are read to the end; repeated
rows are judged each for itself; an empty table gives an empty result; an input column that has the name of an added one is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import free, lean

#: The most rules that are broadcast, and the most characters of theirs (a trie takes some ten times as many bytes).
MAX_RULES, MAX_CHARS = 1_000_000, 16 << 20
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ADDED = ("host", "path", "rule", "verdict")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    start = at + 3
    ends = [i for i in (url.find("?", start), url.find("#", start)) if i >= 0]
    end = min(ends, default=len(url))
    slash = url.find("/", start, end)
    stop = end if slash < 0 else slash
    return url[start:stop].translate(FOLD), url[stop:end]


class Trie:
    """Nodes are [children, ends, longest end]. Under a host node, the child "/" is the root of its paths; a rule's last,
    possibly unfinished segment is an end of its node: {segment start: (rule, verdict)}. Ends are looked up by the segment's
    starts, so a node with many ends costs no more than one with few."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: list = [{}, {}, 0]
        chars = 0
        for n, (verdict, host, path) in enumerate(rules):
            chars += len(host) + len(path)
            if n >= MAX_RULES or chars > MAX_CHARS:
                raise ValueError(f"more than {MAX_RULES} rules or {MAX_CHARS} characters")
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict}")
            node = self.root
            for label in reversed(host.translate(FOLD).split(".")):
                node = node[0].setdefault(label, [{}, {}, 0])
            node = node[0].setdefault("/", [{}, {}, 0])
            *whole, rest = path.split("/")
            for segment in whole:
                node = node[0].setdefault(segment, [{}, {}, 0])
            if node[1].get(rest, ("", ""))[1] != "block":
                node[1][rest] = (host + path, verdict)
                node[2] = max(node[2], len(rest))

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        """The winning rule and its verdict."""
        nodes, node = [], self.root
        for label in reversed(host.split(".")):
            if (node := node[0].get(label)) is None:
                break
            if "/" in node[0]:
                nodes.append(node[0]["/"])
        for node in reversed(nodes):  # the most labels first
            best, segments = None, path.split("/")
            for i, segment in enumerate(segments):
                if node[1]:
                    starts = (segment[:n] for n in range(min(len(segment), node[2]), -1, -1))
                    best = next((node[1][k] for k in starts if k in node[1]), best)
                if i == len(segments) - 1 or (node := node[0].get(segment)) is None:
                    break
            if best:
                return best
        return None


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (None: all), host, path, rule (null: none fits) and verdict of each url.
    ``rules``: (allow or block, host, path)."""
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))
    kept = [c for c in (pages.columns if keep is None else keep) if c.lower() not in ADDED]
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField(k, T.StringType()) for k in ADDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = trie.value.judge
        for batch in batches:
            cuts = [split_url(u) for u in batch.column(len(kept)).to_pylist()]
            found = [judge(*c) or (None, default) for c in cuts]
            new = [[c[0] for c in cuts], [c[1] for c in cuts], [f[0] for f in found], [f[1] for f in found]]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *(pa.array(x, pa.string()) for x in new)], names=[*kept, *ADDED])

    return pages.select(*[pages[f"`{c}`"] for c in kept], pages["url"].alias(free(kept, "__url"))).mapInArrow(lean(run), schema)
