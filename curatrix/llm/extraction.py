"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

A page's block elements are its nodes. Each has features of its subtree (text, density, links, punctuation), its attribute
tokens and those of the elements around it, its depth, and how it compares with its siblings. Boosted trees give each node
the odds that its subtree holds main text. The decoding chooses, for all nodes of a page at once, the likeliest labels in
which no node is kept inside a dropped one and no element is kept for nothing, so ancestors never contradict descendants.

The trees are fitted on TRAINING_PAGES pages of page_samples (a fixed, bounded sample; the corpus has no labelled pages), by
NumPy on the driver in a few seconds; what is broadcast is the model, of a fixed size. Pages are read where they are
stored and never shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from curatrix.llm.arrow import batch_of, map_texts
from curatrix.llm.dom import Dom, parse
from curatrix.llm.page_samples import MARK, sample
from curatrix.sources.shared import table

TRAINING_PAGES = 2000
TREES, DEPTH, RATE, BINS, RIDGE = 80, 4, 0.2, 32, 5.0
_ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NAME = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?。，、]")
_CACHE = 50_000


@lru_cache(_CACHE)
def tokens(attributes: str) -> tuple[str, ...]:
    """The words of an element's class, id, role, itemprop and label."""
    found = _ATTRIBUTE.findall(attributes)
    return tuple(sorted({w for value in found for w in _NAME.findall(_CAMEL.sub(" ", value).lower())})) if found else ()


def _features(dom: Dom, odds: dict[str, float]) -> np.ndarray:
    """A row of features for each node."""
    n = len(dom.parent)
    parent, end, depth = (np.array(x, np.int64) for x in (dom.parent, dom.end, dom.depth))
    up = np.maximum(parent, 0)
    own = np.array([sum(odds.get(t, 0.0) for t in tokens(a)) if a else 0.0 for a in dom.attributes])
    tag = np.array([odds.get(f"<{t}>", 0.0) for t in dom.tag])
    named = own + tag
    low, high = np.zeros(n), np.zeros(n)
    for i, p in enumerate(dom.parent):
        if p >= 0:
            low[i], high[i] = min(low[p], named[p]), max(high[p], named[p])
    chars = np.array([len(t) for t in dom.text], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) if t else 0 for t in dom.text], float)
    linked, inner = np.array(dom.linked, float), np.array(dom.n_tags, float)
    paragraph = np.array([t == "p" for t in dom.tag])
    here = np.arange(n)

    def below(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(x)))
        return sums[end] - sums[here]

    all_chars, all_linked, all_tags, blocks = below(chars), below(linked), below(inner), below(chars > 0)
    children = np.bincount(up[1:], minlength=n) if n > 1 else np.zeros(n, np.int64)
    index = np.zeros(n)
    last: dict[int, int] = {}
    before, after = np.zeros(n), np.zeros(n)
    same: dict[tuple[int, str], int] = defaultdict(int)
    for i, p in enumerate(dom.parent):
        j = last.get(p)
        if j is not None:
            index[i] = index[j] + 1
            before[i], after[j] = all_chars[j], all_chars[i]
        last[p] = i
        same[p, dom.tag[i]] += 1
    alike = np.array([same[p, t] for p, t in zip(dom.parent, dom.tag, strict=True)], float)
    siblings = np.maximum(1, children[up])
    total = max(1.0, all_chars[0])
    sums = np.concatenate(([0], np.cumsum(chars)))
    density = all_linked / np.maximum(1, all_chars)
    mean = all_chars[up] / siblings
    heading = np.array([len(t) == 2 and t[0] == "h" and t[1].isdigit() for t in dom.tag], float)
    return np.column_stack((
        own, tag, low, high, depth, np.log1p(all_chars), np.log1p(chars), density, np.log1p(all_chars / np.maximum(1, all_tags)), all_chars / total, np.log1p(children),
        below(paragraph & (chars > 0)) / np.maximum(1, blocks), below(marks) / np.maximum(1, all_chars), np.log1p(all_chars / np.maximum(1, blocks)), index / siblings, np.log1p(siblings), alike / siblings,
        np.log1p(all_chars) - np.log1p(mean), density[up], sums[here] / total, sums[end] / total, np.log1p(before), np.log1p(after), heading, np.log1p(all_chars[up]), named[up],
    ))


def _bits(x: np.ndarray, feature: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The leaf of each row in a tree whose levels all ask one question each."""
    leaf = np.zeros(len(x), np.int64)
    for f, e in zip(feature, edge, strict=True):
        leaf = 2 * leaf + (x[:, f] > e)
    return leaf


@dataclass
class Model:
    """odds: what a tag or attribute token says by itself; feature, edge (trees x DEPTH) and value (trees x 2**DEPTH)."""

    odds: dict[str, float]
    base: float
    feature: np.ndarray
    edge: np.ndarray
    value: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, e, v in zip(self.feature, self.edge, self.value, strict=True):
            out += v[_bits(x, f, e)]
        return out


def _boost(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Boosting of the logistic loss; a level of a tree has the one split that lowers the loss most over all its leaves."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin, features, edges, values = np.full(len(y), base), [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        leaf, feature, edge = np.zeros(len(y), np.int64), [], []
        for level in range(DEPTH):
            best = (-1.0, 0, 0.0)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                width = len(cut) + 1
                slot = leaf * width + binned[:, f]
                gs, hs = (np.bincount(slot, v, minlength=width << level).reshape(-1, width).cumsum(1) for v in (g, h))
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = (gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE)).sum(0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, float(cut[k]))
            feature.append(best[1])
            edge.append(best[2])
            leaf = 2 * leaf + (x[:, best[1]] > best[2])
        gs, hs = (np.bincount(leaf, v, minlength=1 << DEPTH) for v in (g, h))
        value = RATE * gs / (hs + RIDGE)
        margin += value[leaf]
        features.append(feature)
        edges.append(edge)
        values.append(value)
    return base, np.array(features), np.array(edges), np.array(values)


def _labels(dom: Dom) -> np.ndarray:
    """Whether each node's subtree has marked text."""
    marked = [MARK in a for a in dom.attributes]
    for i, p in enumerate(dom.parent):
        marked[i] |= dom.tag[i] == "#text" and p >= 0 and MARK in dom.attributes[p]
    sums = np.concatenate(([0], np.cumsum([m and bool(t) for m, t in zip(marked, dom.text, strict=True)])))
    return (sums[np.array(dom.end)] > sums[:-1]).astype(float)


@lru_cache(4)
def fit(pages: int = TRAINING_PAGES, seed: int = 7) -> Model:
    """Token odds are taken on one half of the pages and the trees fitted on the other, so that they learn how far to trust names."""
    doms = [parse(html) for html in sample(pages, seed)]
    labels = [_labels(d) for d in doms]
    half = len(doms) // 2
    count: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for dom, y in zip(doms[:half], labels[:half], strict=True):
        for i in range(len(y)):
            for t in (f"<{dom.tag[i]}>", *tokens(dom.attributes[i].replace(MARK, ""))):
                count[t][int(y[i])] += 1
    share = sum(y.sum() for y in labels[:half]) / max(1, sum(map(len, labels[:half])))
    odds = {t: float(np.log((b + 4 * share) / (a + 4 * (1 - share))) - np.log(share / (1 - share))) for t, (a, b) in count.items() if a + b >= 4}
    x = np.concatenate([_features(d, odds) for d in doms[half:]])
    return Model(odds, *_boost(x, np.concatenate(labels[half:])))


def decode(dom: Dom, log_odds: np.ndarray) -> list[bool]:
    """The likeliest labels that are whole: a kept node's parent is kept, and a kept node has text or a kept child."""
    n = len(dom.parent)
    yes, no = (-np.logaddexp(0, -log_odds)).tolist(), (-np.logaddexp(0, log_odds)).tolist()
    drop, keep, lift = no[:], yes[:], [float("-inf")] * n
    some = [False] * n
    for i in range(n - 1, -1, -1):
        if not dom.text[i] and not some[i]:
            keep[i] += lift[i]
        p = dom.parent[i]
        if p >= 0:
            drop[p] += drop[i]
            gain = keep[i] - drop[i]
            keep[p] += max(keep[i], drop[i])
            some[p] |= gain > 0
            lift[p] = max(lift[p], gain)
    kept = [False] * n
    forced: set[int] = set()
    for i in range(n):
        p = dom.parent[i]
        kept[i] = (p < 0 or kept[p]) and (keep[i] > drop[i] or i in forced)
        if kept[i] and not dom.text[i] and not some[i]:
            j, best = i + 1, None
            while j < dom.end[i]:
                if best is None or keep[j] - drop[j] > keep[best] - drop[best]:
                    best = j
                j = dom.end[j]
            if best is not None:
                forced.add(best)
    return kept


def main_text(html: str, model: Model) -> str:
    dom = parse(html)
    kept = decode(dom, model.log_odds(_features(dom, model.odds)))
    return " ".join(t for t, k in zip(dom.text, kept, strict=True) if k and t)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars, one row for each of pages; other columns aren't read.

    A null or empty page, and one without main text, has the empty text. Repeated rows are extracted alike.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or fit())

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        doms = [parse(html or "") for html in piece.column(piece.schema.get_field_index("html")).to_pylist()]
        odds = model.log_odds(np.concatenate([_features(d, model.odds) for d in doms]))
        texts, at = [], 0
        for dom in doms:
            kept = decode(dom, odds[at : at + len(dom.parent)])
            at += len(dom.parent)
            texts.append(" ".join(t for t, k in zip(dom.text, kept, strict=True) if k and t))
        return batch_of(["text", "n_chars"], [texts, [len(t) for t in texts]], [pa.string(), pa.int64()])

    return map_texts(pages.select("page_id", "url", "html"), run, "text string, n_chars long", column="html", keep=["page_id", "url"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
