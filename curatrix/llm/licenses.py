"""Licenses named or reproduced in texts, by ordered signatures.

A text's words are looked up among the rules' keywords first, and only rules whose required words are all there are tried on
it. Detections that overlap are settled by priority: one that stands inside another of an earlier rule is suppressed,
whether that one stays or not (what contains it in turn contains both). All is done where a text stands.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.arrow import batch_of, map_texts
from curatrix.llm.kernels import LOWER, NOT_ALNUM, text_arrays
from curatrix.llm.license_rules import BASE, rules
from curatrix.sources.shared import table

_RULES = rules()
_KEYWORDS = frozenset(w for _, _, required, _ in _RULES for some in required for w in some)
_compiled: dict[int, re.Pattern[bytes]] = {}
#: Words in lower case, anything else a space.
_TABLE = np.where(NOT_ALNUM[LOWER], np.uint8(0x20), LOWER).tobytes()
_MATCH = pa.struct([("label", pa.string()), ("rule", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64()), ("base", pa.bool_()), ("stays", pa.bool_()), ("words", pa.string())])


def _pattern(rule: int) -> re.Pattern[bytes]:
    if rule not in _compiled:
        _compiled[rule] = re.compile(b" (?:" + _RULES[rule][3] + b")(?= )")
    return _compiled[rule]


def detections(parts: list[bytes]) -> list[tuple[int, int, int]]:
    """Rule, start and end (in words) of each place where a rule's pattern stands in these words, by rule, then start."""
    met = _KEYWORDS.intersection(parts)
    if not met:
        return []
    tried = [r for r, (_, _, required, _) in enumerate(_RULES) if not any(met.isdisjoint(some) for some in required)]
    if not tried:
        return []
    joined = b" " + b" ".join(parts) + b" "
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    found = [(r, *m.span()) for r in tried for m in _pattern(r).finditer(joined)]
    if not found:
        return []
    r, a, b = np.array(found).T
    return list(zip(r.tolist(), np.searchsorted(spaces, a).tolist(), np.searchsorted(spaces, b).tolist(), strict=True))


def suppressed(found: list[tuple[int, int, int]]) -> list[bool]:
    """Of detections by rule, then start: whether an earlier one's interval contains it.

    Ends of earlier detections are kept by their starts in a tree of prefix maxima, so that many in a long text stay cheap.
    """
    starts = sorted({s for _, s, _ in found})
    furthest, out = [0] * (len(starts) + 1), []
    for _, s, e in found:
        at = i = bisect_left(starts, s) + 1
        most = 0
        while i:
            most, i = max(most, furthest[i]), i & (i - 1)
        out.append(most >= e)
        while at < len(furthest):
            furthest[at] = max(furthest[at], e)
            at += at & -at
    return out


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (doc_id), n_words and matches, one row for each of docs.

    matches: label, rule, start and end in words, weight, base (it is a base phrase), stays (no earlier rule's match contains
    it) and the words themselves, of each detection by rule, then start. A null or empty text has no words and none; repeated
    rows and ids are rows like any other; no documents give no rows; columns that aren't kept, whatever their names, aren't
    read. A long text is taken whole, at some 60 bytes of memory for each of its words.
    """
    first_base = len(_RULES) - len(BASE)

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        buf, at = text_arrays(piece.column(piece.schema.get_field_index("text")))
        data, n_words, out = buf.tobytes().translate(_TABLE), [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            parts = data[a:b].split()
            found = detections(parts)
            n_words.append(len(parts))
            out.append([{"label": _RULES[r][0], "rule": r, "start": s, "end": e, "weight": _RULES[r][1], "base": r >= first_base, "stays": not gone, "words": b" ".join(parts[s:e]).decode()} for (r, s, e), gone in zip(found, suppressed(found), strict=True)])
        return batch_of(["n_words", "matches"], [n_words, out], [pa.int64(), pa.list_(_MATCH)])

    fields = "label: string, rule: int, start: bigint, end: bigint, weight: double, base: boolean, stays: boolean, words: string"
    return map_texts(docs, run, f"n_words long, matches array<struct<{fields}>>", keep=keep or ["doc_id"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score: how surely a license is meant, 1 less the product of (1 - weight) over the labels that stay, each by its strongest match."""
    found = scan(table(spark, sf_dir, "documents"))
    base, staying = F.filter("matches", lambda m: m["base"]), F.filter("matches", lambda m: m["stays"])
    labels = lambda of: F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"])))
    found = found.select("doc_id", "n_words", base.alias("b"), staying.alias("s"), F.transform(base, lambda m: m["start"]).alias("at"))
    unsure = F.aggregate(labels("s"), F.lit(1.0), lambda left, x: left * (1 - F.array_max(F.transform(F.filter("s", lambda m: m["label"] == x), lambda m: m["weight"]))))
    return found.select(
        "doc_id", "n_words", F.size("b").cast("long").alias("n_base"), F.array_min("at").alias("first_word"), F.array_max("at").alias("last_word"),
        F.array_join(labels("b"), ",").alias("base_labels"), F.array_join(labels(F.concat("b", "s")), ",").alias("labels"), (1 - unsure).alias("score"),
    )
