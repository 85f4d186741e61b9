"""Toxicity by maximum-scoring segments over token log-odds.

Units are words and, so that inflected and compounded forms count, their beginnings of 4 to 8 letters. A unit's score is
its log-odds between toxic and other labelled documents under a Dirichlet prior in proportion to the unit's document count
in the whole corpus; units count where their z-value reaches Z_LEAST and their log-odds ODDS_LEAST (with many labels the
weakest leaning is beyond doubt, but says nothing of a passage), and any other word costs DRIFT. A document's maximal
scoring segments are all found in linear time (Ruzzo and Tompa, 1999). The extreme-value theory of such segments (Karlin
and Altschul, 1990) says how many of a score a text of that length has by chance, with lambda and K taken from the clean
labelled documents: those expected less than E_MOST times are its toxic passages. The best of them, and their sum,
corrected for their number as in Karlin and Altschul (1993), are calibrated to a probability on the labelled documents.

All counts are over all documents. Which units score is settled in the cluster. What is broadcast: ids and labels of at
most about MAX_LABELLED documents, the bounded sample that is learnt from (each different text once); FILTER_BITS bits that
tell which units may score; and the units that do, which at least TOXIC_LEAST documents of that sample must have.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.arrow import batch_of, map_texts
from curatrix.llm.kernels import distinct, pieces
from curatrix.llm.known import Known, held, strings
from curatrix.sources.shared import Scratch, materialize, table

MAX_LABELLED, FILTER_BITS = 1 << 18, 1 << 24
PRIOR, Z_LEAST, ODDS_LEAST, TOXIC_LEAST, DRIFT, E_MOST = 50.0, 4.0, 1.0, 4, 0.3, 0.05
_BEGIN = range(4, 9)
_CACHE, _UNITS, _PIECE, SPLITS = 200_000, 250_000, 3 << 19, 4  # words a worker remembers, units it counts before it sends them on, bytes taken together, partitions that one task counts


def units(word: str) -> list[str]:
    """The word, and its proper beginnings, marked so that they aren't taken for words."""
    return [word, *("^" + word[:n] for n in _BEGIN if n < len(word))]


@dataclass
class Words:
    """A piece's words: occurrence i is distinct[index[i]], text t has those from at[t] to at[t + 1]."""

    distinct: list[str]
    index: np.ndarray
    at: np.ndarray

    def by_text(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and word of each word that a text has, once."""
        text = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        both = distinct(text * max(1, len(self.distinct)) + self.index)
        return np.divmod(both, max(1, len(self.distinct)))


def words(column: pa.Array) -> Words:
    """Runs of letters and digits in lower case; null has none."""
    lists = pc.split_pattern_regex(pc.utf8_lower(column.fill_null("")), r"[^\p{L}\p{N}]+")
    flat = lists.flatten()
    there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False).astype(bool)  # none before the first and after the last separator
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    before = np.concatenate(([0], np.cumsum(there)))
    coded = flat.filter(pa.array(there)).dictionary_encode()
    return Words(strings(coded.dictionary), coded.indices.to_numpy().astype(np.int64), before[np.concatenate(([0], ends)).astype(np.int64)])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_labels(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, y: labelled documents that may be learnt from, one for each different text, at most about `most`.

    A document labelled twice is toxic if any label says so; equal texts are if most of them are.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    usable = usable.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    share = min(1.0, most / max(1, usable.count()))
    sample = usable.filter(F.col("h") < int(share * (1 << 20))).drop("h")
    texts = docs.select("doc_id", F.xxhash64("text").alias("t")).join(F.broadcast(sample), "doc_id")
    return texts.groupBy("t").agg(F.min("doc_id").alias("doc_id"), F.avg("y").alias("y")).select("doc_id", F.when(F.col("y") >= 0.5, 1).otherwise(0).alias("y"))


@dataclass
class Labelled:
    """Ids in order with their labels."""

    ids: np.ndarray
    y: np.ndarray

    def of(self, column: pa.Array) -> np.ndarray:
        """1 or 0 by label, -1 for others."""
        if not len(self.ids):
            return np.full(len(column), -1)
        ids = column.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, self.y[at], -1)


def _slot(unit: str, bits: int) -> int:
    return xxhash.xxh3_64_intdigest(unit) % bits


def _toxic_units(docs: DataFrame, shared, scratch: Scratch) -> DataFrame:
    """u: units of at least TOXIC_LEAST toxic documents."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        toxic = np.flatnonzero(shared.value.of(piece.column(0)) == 1)
        if not len(toxic):
            return None
        found = words(piece.column(1).take(pa.array(toxic)))
        count: dict[str, int] = {}
        text, word = found.by_text()
        for at in np.split(word, np.flatnonzero(np.diff(text)) + 1):
            for u in {u for w in at.tolist() for u in units(found.distinct[w])}:
                count[u] = count.get(u, 0) + 1
        return batch_of(["u", "n"], [[*count], [*count.values()]], [pa.string(), pa.int64()])

    counted = map_texts(docs.select("doc_id", "text"), run, "u string, n long").groupBy("u").agg(F.sum("n").alias("n"))
    return scratch.keep(counted.filter(F.col("n") >= TOXIC_LEAST).select("u"), "toxic-units")


def _filter(candidates: DataFrame, size: int) -> np.ndarray:
    """One of `size` bits for each slot that a candidate falls in; at most size / 64 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.array([_slot(u, size) for u in strings(batch.column(0))], np.int64)
            yield batch_of(["i", "bits"], [slots >> 6, (np.uint64(1) << (slots & 63).astype(np.uint64)).view(np.int64)], [pa.int64(), pa.int64()])

    out = np.zeros(size >> 6, np.int64)
    for r in candidates.mapInArrow(run, "i long, bits long").groupBy("i").agg(F.expr("bit_or(bits)").alias("bits")).collect():
        out[r.i] = r.bits
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def _gathered(docs: DataFrame) -> DataFrame:
    """docs in fewer partitions, SPLITS of them in one, but at least two for each core.

    A task sends each unit on once however many of its documents have it: rows go with the tasks, not with the documents.
    """
    n = docs.rdd.getNumPartitions()
    return docs.coalesce(max(1, -(-n // SPLITS), min(n, 2 * docs.sparkSession.sparkContext.defaultParallelism)))


def _counts(docs: DataFrame, may: np.ndarray, shared, most: int) -> DataFrame:
    """u, n, c, t of each task's documents: those with each unit that may be a candidate, and those of them labelled not toxic and toxic; u null: documents in all."""
    passing = docs.sparkSession.sparkContext.broadcast(np.packbits(may))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("unit counts",), dict)  # other operators' memories make room
        may = np.unpackbits(passing.value)
        known, number, no = Known(np.dtype(np.int64)), {}, set()
        count, totals = np.zeros((1 << 16, 3), np.int64), np.zeros(3, np.int64)

        def flush() -> pa.RecordBatch:
            rows = count[: len(number)]
            return batch_of(["u", "n", "c", "t"], [[*number], *rows.T], [pa.string()] + [pa.int64()] * 3)

        def number_of(u: str) -> int:
            """Its number if it may be a candidate, else -1."""
            at = number.get(u, -1)
            if at < 0 and u not in no:
                if may[_slot(u, len(may))]:
                    at = number[u] = len(number)
                elif len(no) < _CACHE:
                    no.add(u)
            return at

        for batch in batches:
            for piece in pieces(batch, most=_PIECE):
                y = shared.value.of(piece.column(0))
                totals += [len(y), (y == 0).sum(), (y == 1).sum()]
                found = words(piece.column(1))
                at = known.numbers(found.distinct)
                new = np.flatnonzero(at < 0)
                if len(new):
                    names = [found.distinct[i] for i in new.tolist()]
                    each = [[i for i in map(number_of, units(w)) if i >= 0] for w in names]
                    at[new] = known.add(names, np.array([i for x in each for i in x], np.int64), np.array([len(x) for x in each], np.int64))
                while len(number) > len(count):
                    count = np.concatenate((count, np.zeros_like(count)))
                text, word = found.by_text()
                unit, size = known.gather(at[word])
                both = distinct(np.repeat(text, size) * max(1, len(number)) + unit)
                text, unit = np.divmod(both, max(1, len(number)))
                label = y[text]
                for k, some in enumerate((unit, unit[label == 0], unit[label == 1])):
                    count[: len(number), k] += np.bincount(some, minlength=len(number))
                known.forget(_CACHE)
                if len(number) > most:
                    yield flush()
                    known = Known(np.dtype(np.int64))
                    number.clear()
                    count[:] = 0
        if number:
            yield flush()
        yield batch_of(["u", "n", "c", "t"], [[None], *totals[:, None]], [pa.string()] + [pa.int64()] * 3)

    return _gathered(docs.select("doc_id", "text")).mapInArrow(run, "u string, n long, c long, t long")


def _count(docs: DataFrame, may: np.ndarray, shared, most: int, scratch: Scratch) -> DataFrame:
    """The same of all documents."""
    return scratch.keep(_counts(docs, may, shared, most).groupBy("u").agg(*(F.sum(k).alias(k) for k in "nct")), "unit-counts")


def log_odds(counts: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and z-value of each unit from its document counts (all, not toxic, toxic)."""
    prior = PRIOR * counts[:, 0] / max(1, totals[0])
    odds = [np.log((counts[:, k] + prior) / np.maximum(totals[k] + PRIOR - counts[:, k] - prior, 1e-9)) for k in (1, 2)]
    score = odds[1] - odds[0]
    return score, score / np.sqrt(1 / (counts[:, 1] + prior) + 1 / (counts[:, 2] + prior))


def _scoring(counted: DataFrame, candidates: DataFrame) -> dict[str, float]:
    """The score of each candidate whose z-value reaches Z_LEAST and whose score ODDS_LEAST."""
    first = counted.filter("u IS NULL").first()
    totals = np.array([first.n, first.c, first.t] if first else [0, 0, 0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.column_stack([c.to_numpy() for c in batch.columns[1:]]).reshape(-1, 3)
            score, z = log_odds(counts, totals)
            some = np.flatnonzero((z >= Z_LEAST) & (score >= ODDS_LEAST) & (counts[:, 2] >= TOXIC_LEAST))
            yield batch_of(["u", "score"], [batch.column(0).take(pa.array(some)), score[some]], [pa.string(), pa.float64()])

    return {r.u: r.score for r in counted.join(candidates, "u").select("u", "n", "c", "t").mapInArrow(run, "u string, score double").collect()}


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time."""
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, and where to look on from
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left = i, before
        j = len(found) - 1
        while j >= 0 and found[j][2] >= left:
            j = found[j][4]
        while j >= 0 and found[j][3] < total:
            start, left = found[j][0], found[j][2]
            del found[j:]
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
        found.append((start, i + 1, left, total, j))
    return [(a, b, after - before) for a, b, before, after, _ in found]


def passages(scores: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """Maximal segments of words whose scores are positive, or 0 where each costs `drift`. A gap between scoring words counts as one."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    values = np.zeros(2 * len(at) - 1)
    values[::2] = scores[at]
    values[1::2] = -drift * (np.diff(at) - 1)
    places = at.tolist()
    return [(places[a // 2], places[(b - 1) // 2] + 1, s) for a, b, s in segments(values.tolist())]


def fit_units(docs: DataFrame, labels: DataFrame, bits: int = FILTER_BITS, most: int = _UNITS) -> tuple[dict[str, float], Labelled]:
    spark = docs.sparkSession
    rows = training_labels(docs, labels).toPandas().sort_values("doc_id")
    labelled = Labelled(rows["doc_id"].to_numpy(np.int64), rows["y"].to_numpy(np.int64))
    shared = spark.sparkContext.broadcast(labelled)
    scratch = Scratch(spark)
    candidates = _toxic_units(docs, shared, scratch)
    model = _scoring(_count(docs, _filter(candidates, bits), shared, most, scratch), candidates)
    scratch.clear()
    return model, labelled


def measure(docs: DataFrame, model: dict[str, float], keep: list[str]) -> DataFrame:
    """keep, then n_words, n_scoring, scoring (their sum), and all maximal segments as found (start, stop, score), of each of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        cache: dict[str, float] = held(("toxicity", id(model)), dict)
        found = words(piece.column(piece.schema.get_field_index("text")))
        value = np.zeros(len(found.distinct))
        for i, w in enumerate(found.distinct):
            s = cache.get(w)
            if s is None:
                s = max((model[u] for u in units(w) if u in model), default=0.0)
                if len(cache) < _CACHE:
                    cache[w] = s
            value[i] = s
        scores = value[found.index]
        sums, hits = np.concatenate(([0.0], np.cumsum(scores))), np.concatenate(([0], np.cumsum(scores > 0)))
        n, bounds = len(found.at) - 1, found.at.tolist()
        hit = np.diff(hits[found.at])
        each: list[list[tuple[int, int, float]]] = [[]] * n
        for t in np.flatnonzero(hit).tolist():
            each[t] = passages(scores[bounds[t] : bounds[t + 1]])
        flat = [x for found in each for x in found]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int32)
        start, stop, score = zip(*flat, strict=True) if flat else ((), (), ())
        inner = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(score, pa.float64())], ["start", "stop", "score"])
        return batch_of(["n_words", "n_scoring", "scoring", "found"], [np.diff(found.at), hit, np.diff(sums[found.at]), pa.ListArray.from_arrays(pa.array(offsets), inner)], [pa.int64(), pa.int64(), pa.float64(), None])

    return map_texts(docs, run, "n_words long, n_scoring long, scoring double, found array<struct<start int, stop int, score double>>", keep=keep, most=_PIECE)


def karlin(rate: float, mean: float, drift: float = DRIFT) -> float:
    """lambda for a background where a word scores `mean` at the given rate and else costs drift: rate * exp(l * mean) + (1 - rate) * exp(-l * drift) = 1."""
    if not 0 < rate < 1 or mean <= 0 or rate * mean >= (1 - rate) * drift:
        return 1.0
    high = 1.0
    excess = lambda x: rate * math.exp(x * mean) + (1 - rate) * math.exp(-x * drift) - 1
    while excess(high) < 0:
        high *= 2
    low = high / 2 if high > 1 else 1e-9
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def background(raw: DataFrame, clean: DataFrame | None) -> tuple[float, float]:
    """lambda and log K from the documents in clean (doc_id), or from all. K n exp(-lambda best) is exponential with mean 1, so K is a mean's inverse."""
    some = raw.join(F.broadcast(clean), "doc_id") if clean is not None else raw
    r = some.agg(F.sum("n_words"), F.sum("n_scoring"), F.sum("scoring")).first()
    n_words, n, total = (x or 0 for x in r)
    lam = karlin(n / n_words if n_words else 0.0, total / n if n else 0.0)
    tail = some.filter("n_words > 0").agg(F.avg(F.col("n_words") * F.exp(-lam * _best("found")))).first()[0]
    return lam, -math.log(tail) if tail else 0.0


def _best(column: str) -> Column:
    return F.coalesce(F.array_max(F.col(column)["score"]), F.lit(0.0))


def significant(lam: float, log_k: float, most: float = E_MOST) -> Column:
    """Of all segments, those expected less than `most` times in a text of as many words by chance; bits: how rare, as a power of 2."""
    chance = F.log(F.greatest("n_words", F.lit(1))) + log_k
    rated = F.transform("found", lambda x: F.struct(x["start"], x["stop"], x["score"], ((lam * x["score"] - chance) / math.log(2)).alias("bits")))
    return F.filter(rated, lambda x: x["bits"] > -math.log2(most))


def _features() -> list[Column]:
    n = F.size("passages")
    # the sum of n passages' bits is reached by chance n! times as easily in any of their orders
    orders = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, k: a + F.log2(k))
    total = F.aggregate("passages", F.lit(0.0), lambda a, x: a + x["bits"]) - orders
    share = F.aggregate("passages", F.lit(0.0), lambda a, x: a + x["stop"] - x["start"]) / F.greatest("n_words", F.lit(1))
    best = F.coalesce(F.array_max(F.col("passages")["bits"]), F.lit(0.0))
    return [F.when(n > 0, 1.0).otherwise(0.0), F.log1p(best), F.log1p(F.greatest(total, F.lit(0.0))), share]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the constant last, by Newton's method."""
    x = np.column_stack((x, np.ones(len(x))))
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs, then held_out, score, predicted, best (its highest segment), n_passages and passages
    (start, stop in words, score, bits) of significance; a row for each of docs.

    A null, empty or wordless text has no passage and the score that such texts earn. Without labels of both kinds every
    score is the share of toxic labels (0 without any). Repeated rows score alike, equal best passages are all kept, no
    documents give no rows. Columns that aren't in `keep` are never read, so their names clash with nothing; a long text is
    taken whole, at some 40 bytes of memory for each of its words.
    """
    keep = ["doc_id"] if keep is None else keep
    spark = docs.sparkSession
    model, labelled = fit_units(docs, labels)
    raw = materialize(measure(docs.select(*dict.fromkeys([*keep, "doc_id", "text"])), model, [*dict.fromkeys([*keep, "doc_id"])]), "toxicity")
    positive = int(labelled.y.sum())
    marked = spark.createDataFrame(pd.DataFrame({"doc_id": labelled.ids, "y": labelled.y}), "doc_id long, y long")
    both = 0 < positive < len(labelled.y)
    lam, log_k = background(raw, marked.filter("y = 0").select("doc_id") if both else None)
    rated = raw.withColumn("best", _best("found")).withColumn("passages", significant(lam, log_k)).drop("found")
    if both:
        features = _features()
        rows = rated.join(F.broadcast(marked), "doc_id").select("y", *(f.alias(f"f{i}") for i, f in enumerate(features))).toPandas()
        w = _logistic(rows.drop(columns="y").to_numpy(float), rows["y"].to_numpy(float))
        linear = sum((float(a) * f for a, f in zip(w, features, strict=False)), F.lit(float(w[-1])))
        value = 1 / (1 + F.exp(-linear))
    else:
        value = F.lit(positive / max(1, len(labelled.y)))
    scored = rated.select(*keep, held_out().alias("held_out"), value.alias("score"), "best", F.size("passages").alias("n_passages"), "passages")
    return scored.select(*keep, "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "best", "n_passages", "passages")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("passages")
