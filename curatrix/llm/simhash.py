"""Near-duplicates by SimHash and pigeonring filtering.

A fingerprint's 64 bits are cut into a ring of SEGMENTS segments. If two fingerprints differ in at most DISTANCE bits,
the pigeonring principle says that from some segment on every chain of l consecutive segments has at most
l * DISTANCE / SEGMENTS differences. As long as that budget rounds down to 0 the chain must be equal, so its bits are a
join key (seven segments, 28 bits, for the values used). Fingerprints that share no chain with another are pruned there,
and before it those that share no BLOCKS - DISTANCE of BLOCKS blocks with another (38 bits, so that few of them share one
by chance even among many billions).

Survivors of one chain are compared without pairing a bucket's members with each other: two of them differ in at most
two bits if and only if they have a midpoint at one bit or less from both. Each sends its midpoints (only bits outside
the chain can differ), and those that meet at one are linked to the least of them; a midpoint is met by at most one
fingerprint for each bit and one more, however many copies there are. Longer chains, up to all segments but one, have a
budget of one difference, so of two differences one at least stands in the ring's last segment: midpoints that are only met
by flips before it are over budget and pruned (such a pair has another chain). Equal fingerprints are one from the start.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.arrow import batch_of, map_texts
from curatrix.llm.kernels import text_arrays
from curatrix.llm.rows import packed, unpacked
from curatrix.operators.graph import connected_components
from curatrix.sources.shared import materialize, table

WORDS, SEED, DISTANCE, SEGMENTS, BLOCKS = 3, 42, 2, 16, 5
_LOWER = bytes(range(256)).lower()
_ROWS = 1 << 16  # hashes whose bits are unpacked at a time


def simhash(text: bytes, width: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of a text: a bit is 1 if it is set in over half of the shingles' XXH64."""
    parts = text.translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    end = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    begin = np.concatenate(([0], end[:-width] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(begin, end[width - 1 :].tolist(), strict=True)], np.uint64)
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _ROWS):
        some = hashes[i : i + _ROWS]
        count += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs and fp, the fingerprint as a signed long; a null text has no words."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        buf, at = text_arrays(piece.column(piece.schema.get_field_index("text")))
        data = buf.tobytes()
        out = np.array([simhash(data[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.uint64)
        return batch_of(["fp"], [out.view(np.int64)], [pa.int64()])

    return map_texts(docs, run, "fp long", keep=["doc_id"] if keep is None else keep)


def _with_company(distinct: DataFrame, distance: int, blocks: int = BLOCKS) -> DataFrame:
    """Those of distinct (fp) that agree with another in all but `distance` of the blocks, as all within that distance of one do."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    mask = lambda chosen: sum((1 << edges[b + 1]) - (1 << edges[b]) for b in chosen)
    signed = [m - (1 << 64) if m >> 63 else m for m in map(mask, combinations(range(blocks), blocks - distance))]
    keyed = distinct.select("fp", F.posexplode(F.array(*(F.lit(m).cast("long") for m in signed))).alias("i", "m")).select("fp", "i", F.col("fp").bitwiseAND(F.col("m")).alias("key"))
    # a key's fingerprints differ, so there is another if the least and the greatest do
    shared = keyed.groupBy("i", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b").select("i", "key")
    return materialize(keyed.join(shared, ["i", "key"], "left_semi").select("fp").distinct(), "with-company")


def links(distinct: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """src, dst: fingerprints (column fp, each once) at most `distance` bits apart, enough of them to connect all that are."""
    if distance not in (1, 2):
        raise ValueError("a midpoint one bit from both joins fingerprints of at most two differing bits")
    wide = 64 // segments
    chain = wide * (-(-segments // distance) - 1)  # bits whose budget of differences rounds down to 0
    rest = 64 - chain
    turned = F.expr(f"transform(sequence(0, {segments - 1}), i -> struct(i AS i, shiftleft(fp, i * {wide}) | shiftrightunsigned(fp, 64 - i * {wide}) AS x))")
    # a shift by 64 is one by 0: at i = 0 both halves are fp itself
    rows = _with_company(distinct, distance).select("fp", F.explode(turned).alias("r")).select("fp", "r.i", "r.x", F.expr(f"shiftrightunsigned(r.x, {rest})").alias("chain"))
    shared = rows.groupBy("i", "chain").count().filter("count > 1").drop("count")
    left = rows.join(shared, ["i", "chain"], "left_semi")
    # bits below `wide` are the last segment; nothing flipped counts as there, as it takes no budget
    middle = F.expr(f"concat(array(struct(x AS m, true AS last)), transform(sequence(0, {rest - 1}), b -> struct(x ^ shiftleft(1L, b) AS m, b < {wide} AS last)))")
    each = left.select("fp", "i", F.explode(middle).alias("e")).select("fp", "i", F.col("e.m").alias("middle"), F.col("e.last").alias("last"))
    met = each.groupBy("i", "middle").agg(F.collect_list("fp").alias("fps"), F.bool_or("last").alias("last")).filter("size(fps) > 1 AND last")
    pairs = met.select(F.array_min("fps").alias("src"), F.explode("fps").alias("dst")).filter("src <> dst").distinct()
    return pairs.filter(f"bit_count(src ^ dst) <= {distance}")


def components(marked: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fp, component (the least fp) and component_id (the least doc_id reachable over links) of each distinct fingerprint in marked (doc_id, fp)."""
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    found = connected_components(links(distinct, distance))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.select("fp", "component").join(least, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, one row for each of docs.

    Rows without words have fingerprint 0 and are linked like any other; repeated rows share a component; a null doc_id is
    never the least (a component of nothing else has a null component_id). No documents give no rows; other columns of docs,
    whatever their names, are left out. A long text is taken whole, at some 100 bytes of memory for each of its words.
    """
    marked = materialize(fingerprints(docs.select("doc_id", "text")), "simhash")
    named = marked.join(components(marked, distance), "fp", "left")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of docs, in its columns, for each component: that of the least doc_id.

    Of repeated rows with that id any one stays; so does one row of a component that has no id.
    """
    marked = materialize(fingerprints(packed(docs), keep=["doc_id", "text", "row"]).withColumn("d", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))), "simhash")
    found = components(marked.select("doc_id", "fp"), distance)
    # settled on ids and fingerprints; texts are shuffled once, by both, so that copies of one fingerprint don't meet in a task
    least = marked.select("d", "doc_id", "fp").join(found, "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = least.groupBy("component").agg(F.min(F.struct("fp", "d")).alias("at")).select("at.fp", "at.d")
    return unpacked(marked.join(kept, ["fp", "d"]).dropDuplicates(["fp", "d"]), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
