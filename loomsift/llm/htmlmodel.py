"""Main text of web pages by a tree-structured graphical model.

Each block element is a node with two states, boilerplate and content. Unary potentials come from its tag, names in its
attributes and the shape of its own text; pairwise potentials tie it to its parent, one 2 x 2 table for each kind of
element. One upward and one downward sweep of sum-product messages give the exact marginals; the weights are trained on
labelled pages by gradient ascent on the conditional likelihood (observed minus expected features). A page's text is
the text runs of elements that are more likely content.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import Tree, parse
from .htmlpages import pages
from .session import bounded_batches

_TAGS = "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th form fieldset figure figcaption blockquote pre address".split()
_GOOD = re.compile(r"article|content|post|entry|story|main|text|(?<![a-z])body")
_BAD = {
    "nav": r"nav|menu|crumb|toc",
    "head": r"header|masthead|topbar|logo",
    "foot": r"foot|copyright|legal|disclaimer|bottom",
    "ad": r"(?<![a-z])ads?(?![a-z])|advert|sponsor|promo|banner",
    "side": r"sidebar|(?<![a-z])side|aside|widget|rail",
    "note": r"cookie|consent|notice|gdpr|alert|newsletter|subscri|popup|modal|dialog",
    "talk": r"comment|repl(?:y|ies)|discuss|disqus|respon",
    "share": r"share|social|toolbar|sharing",
    "more": r"related|recommend|more|teaser|popular|trending",
    "form": r"form|search|login|signup",
    "hidden": r"hidden",
}
_BAD_RE = [re.compile(x) for x in _BAD.values()]
FEATURES = ["bias", *(f"tag:{x}" for x in _TAGS), "tag:other", "good", *(f"bad:{x}" for x in _BAD), "named", "empty", "links:none", "links:some", "links:most", "len:10", "len:40", "len:120", "len:long", "stop", "no stop", "top"]
_AT = {k: i for i, k in enumerate(FEATURES)}
_KIND = {**dict.fromkeys("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split(), 0), **dict.fromkeys("ul ol li dl dt dd table tr td th thead tbody".split(), 1), **dict.fromkeys("html body main article".split(), 2), **dict.fromkeys("nav aside header footer form".split(), 3)}
KINDS = 5


@lru_cache(4096)
def _named(attrs: str) -> tuple[int, ...]:
    out = [_AT[f"bad:{k}"] for k, r in zip(_BAD, _BAD_RE) if r.search(attrs)]
    if _GOOD.search(attrs):
        out.append(_AT["good"])
    return (*out, _AT["named"])


def node_features(t: Tree) -> list[list[int]]:
    n = len(t.tag)
    size, links, stops = [0] * n, [0] * n, [False] * n
    for e, text, link in t.runs:
        size[e] += len(text)
        links[e] += link
        stops[e] = stops[e] or text[-1] in ".!?:;\"'"
    out = []
    for i in range(n):
        f = [0, _AT.get(f"tag:{t.tag[i]}", _AT["tag:other"])]
        if t.attrs[i].strip():
            f.extend(_named(t.attrs[i]))
        if not size[i]:
            f.append(_AT["empty"])
        else:
            share = links[i] / size[i]
            f.append(_AT["links:none" if share < 0.02 else "links:some" if share < 0.6 else "links:most"])
            f.append(_AT["len:10" if size[i] < 10 else "len:40" if size[i] < 40 else "len:120" if size[i] < 120 else "len:long"])
            f.append(_AT["stop" if stops[i] else "no stop"])
        if t.parent[i] == 0:
            f.append(_AT["top"])
        out.append(f)
    return out


def _kind(tag: str) -> int:
    return _KIND.get(tag, 4)


@dataclass
class TreeModel:
    unary: list[float]
    #: KINDS tables [parent state][child state] of log potentials.
    pair: list[list[list[float]]]

    def marginals(self, t: Tree, feats: list[list[int]], edges: list | None = None) -> list[float]:
        """P(content) of each node; ``edges`` gets the pairwise marginals of (parent, child)."""
        n = len(t.tag)
        w = self.unary
        e = [[[math.exp(x) for x in row] for row in table] for table in self.pair]
        kinds = [_kind(x) for x in t.tag]
        b0, b1 = [1.0] * n, [1.0] * n
        for i in range(n):
            u = sum(w[k] for k in feats[i])
            b1[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, u))))
            b0[i] = 1 - b1[i] or 1e-13
        m0, m1 = [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            (a, b), (c, d) = e[kinds[i]]
            x, y = a * b0[i] + b * b1[i], c * b0[i] + d * b1[i]
            s = x + y
            m0[i], m1[i] = x / s, y / s
            p = t.parent[i]
            x, y = b0[p] * m0[i], b1[p] * m1[i]
            s = x + y
            b0[p], b1[p] = max(x / s, 1e-200), max(y / s, 1e-200)
        s = b0[0] + b1[0]
        b0[0], b1[0] = b0[0] / s, b1[0] / s
        for i in range(1, n):
            p = t.parent[i]
            (a, b), (c, d) = e[kinds[i]]
            x, y = b0[p] / m0[i], b1[p] / m1[i]  # the parent without this child
            s = x + y
            x, y = x / s, y / s
            if edges is not None:
                q = [[x * a * b0[i], x * b * b1[i]], [y * c * b0[i], y * d * b1[i]]]
                s = sum(map(sum, q))
                edges.append((i, kinds[i], [[v / s for v in row] for row in q]))
            x, y = b0[i] * (x * a + y * c), b1[i] * (x * b + y * d)
            s = x + y
            b0[i], b1[i] = max(x / s, 1e-200), max(y / s, 1e-200)
        return b1

    def extract(self, html: str | None) -> str:
        if not html:
            return ""
        t = parse(html)
        if not t.runs:
            return ""
        p = self.marginals(t, node_features(t))
        return "\n\n".join(text for e, text, _ in t.runs if p[e] > 0.5)


def train(labelled: list[str], epochs: int = 30, rate: float = 0.5) -> TreeModel:
    """Adagrad on the conditional log-likelihood of pages whose content elements carry ``data-label="1"``."""
    m = TreeModel([0.0] * len(FEATURES), [[[0.0, 0.0], [0.0, 0.0]] for _ in range(KINDS)])
    data = []
    for html in labelled:
        t = parse(html)
        y = [int(k == "1") for k in t.keep]
        for i in range(len(y) - 1, 0, -1):  # what holds content counts as content
            if y[i]:
                y[t.parent[i]] = 1
        data.append((t, node_features(t), y))
    gu, gp = np.full(len(FEATURES), 1e-6), np.full((KINDS, 2, 2), 1e-6)
    for _ in range(epochs):
        for start in range(0, len(data), 20):
            du, dp = np.zeros(len(FEATURES)), np.zeros((KINDS, 2, 2))
            some = data[start : start + 20]
            for t, feats, y in some:
                edges: list = []
                p = m.marginals(t, feats, edges)
                for i, f in enumerate(feats):
                    for k in f:
                        du[k] += y[i] - p[i]
                for i, kind, q in edges:
                    dp[kind] -= q
                    dp[kind, y[t.parent[i]], y[i]] += 1
            du = du / len(some) - 2e-3 * np.array(m.unary)
            dp = dp / len(some) - 2e-3 * np.array(m.pair)
            gu += du * du
            gp += dp * dp
            m.unary = (np.array(m.unary) + rate * du / np.sqrt(gu)).tolist()
            m.pair = (np.array(m.pair) + rate * dp / np.sqrt(gp)).tolist()
    return m


@lru_cache(2)
def trained(n: int = 400) -> TreeModel:
    """The model trained on ``n`` generated pages; the same in each process, and fitted once in it."""
    return train(pages(n))


def _run(model: TreeModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.extract(h) for h in batch.column(2).to_pylist()]
            cols = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    return run


def extract_text(table: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html.

    Null, empty and contentless pages give an empty text; a null url stays null; repeated rows give repeated results;
    further columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(table.sparkSession)
    model = model or trained()
    rows = table.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_run(model), "page_id long, url string, text string, n_chars long")
