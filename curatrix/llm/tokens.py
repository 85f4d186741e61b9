"""Token ids of a corpus in a compressed binary file, in the order of the documents.

Texts are encoded once where they are read and the ids kept as a table; the ids' counts over the whole corpus give one
frequency table (bounded by the vocabulary, so it may be broadcast); ids are range-sorted by document and each task
writes blocks of whole documents. A block is decoded on its own, and inside it from any checkpoint.
The container is Parquet, which any of the cluster's file systems takes: a row is a block, in binary, with its place.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.llm.arrow import batch_of, map_texts
from curatrix.llm.known import Known, held, strings
from curatrix.llm.rans import Table, decode_block, encode_block, quantise
from curatrix.llm.rows import row_key
from curatrix.sources.shared import drop_path, new_path, table

END_ID = 1
BLOCK_TOKENS = 1 << 18
_CACHE = 400_000  # words, and parts of words, whose ids a worker keeps: the first it meets, as frequent ones come early
_PIECE = 4 << 20  # bytes of text whose words are told apart together
_TOGETHER = 1024  # new parts that the tokenizer is given as one text

#: The steps of the tokenizer's file before its model for which words can be encoded one by one.
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Words of letters up to U+024F but U+0130, which lower case makes two of, without what only some take for white space.
_LATIN = "^[\\x00-\\x1b!-\\x7f\\x{86}-\\x{9f}\\x{a1}-\\x{12f}\\x{131}-\\x{24f}]+$"
_CUT = "\x1f"  # which no such word has


class WordEncoder:
    """Encodes texts word by word with a tokenizer whose pre-tokenizer never joins over white space.

    The words of a piece of texts are told apart by Arrow; only its distinct ones are looked up, and the ids of all are
    gathered from one flat table, so no word is a Python object where it occurs. The tokenizer is asked only for parts of
    words that are new to this worker. How Latin words fall into parts is its file's own pattern, applied to them in lower
    case, where its normalization is just that; new parts are given to it many at a time, as one text: where a part ends,
    its vocabulary tells. All other words, and texts with what may be a special token, are given to it whole. So is every
    text if the file's steps aren't those known to work word by word.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.type = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        model = file.get("model", {})
        mark = model.get("end_of_word_suffix")
        special = [t["content"] for t in file.get("added_tokens", [])]
        self.wordwise = bool(mark) and model.get("type") == "BPE" and {k: file.get(k) for k in _STEPS} == _STEPS and all(t.startswith("<|") and not t.split()[1:] for t in special)
        if self.wordwise:
            self.last = np.zeros(self.size, bool)  # ids that only stand at the end of a part
            self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(mark)]] = True
            self.pattern = file['pre_tokenizer']['pretokenizers'][0]['pattern']['Regex']
            # the same without normalization, for what is normalized already
            self.bare = Tokenizer.from_str(json.dumps(file | {"normalizer": None}))
            self.words, self.parts = Known(self.type), Known(self.type)
        self.end = np.array([END_ID], self.type)

    def _ask(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after another, and how many each has."""
        found = [np.array(e.ids, self.type) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, self.type), *found]), np.array([len(x) for x in found], np.int64)

    def _ask_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for parts of words."""
        ids = [np.zeros(0, self.type)]
        for i in range(0, len(parts), _TOGETHER):
            ids.append(np.array(self.bare.encode_batch_fast([" ".join(parts[i : i + _TOGETHER])], add_special_tokens=False)[0].ids, self.type))
        together = np.concatenate(ids)
        end = np.flatnonzero(self.last[together]) + 1
        if len(end) != len(parts):  # a vocabulary that doesn't tell
            return self._ask(parts)
        return together, np.diff(end, prepend=0)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Adds new words, each once, to what is known, and returns their numbers."""
        out, latin = np.empty(len(words), np.int64), pc.match_substring_regex(words, _LATIN)
        is_latin = latin.to_numpy(zero_copy_only=False)
        simple, rest = words.filter(latin), words.filter(pc.invert(latin))
        if len(simple):
            lists = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(simple), self.pattern, f"{_CUT}\\0"), _CUT)
            # before the first cut stands nothing
            n = pc.list_value_length(lists).to_numpy() - 1
            flat = lists.flatten()
            flat = flat.filter(pc.not_equal(flat, ""))
            if len(flat) != n.sum():
                raise ValueError("the pattern leaves part of a word out")
            coded = flat.dictionary_encode()
            distinct = strings(coded.dictionary)
            number = self.parts.numbers(distinct)
            new = np.flatnonzero(number < 0)
            if len(new):
                fresh = [distinct[i] for i in new.tolist()]
                number[new] = self.parts.add(fresh, *self._ask_parts(fresh))
            ids, size = self.parts.gather(number[coded.indices.to_numpy()])
            sums = np.concatenate(([0], np.cumsum(size)))
            ends = np.cumsum(n)
            out[is_latin] = self.words.add(strings(simple), ids, sums[ends] - sums[ends - n])
            self.parts.forget(_CACHE)
        if len(rest):
            other = strings(rest)
            out[~is_latin] = self.words.add(other, *self._ask(other))
        return out

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text (null: none), END_ID last, as binary."""
        texts = texts.fill_null("")
        n = len(texts)
        whole = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False).astype(bool) if self.wordwise else np.ones(n, bool)
        ids, size = np.zeros(0, self.type), np.zeros(n, np.int64)
        if not whole.all():
            lists = pc.ascii_split_whitespace(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
            coded = lists.flatten().dictionary_encode()
            known = self.words.numbers(strings(coded.dictionary))
            new = np.flatnonzero(known < 0)
            if len(new):
                known[new] = self._learn(coded.dictionary.take(pa.array(new)))
            ids, each = self.words.gather(known[coded.indices.to_numpy()])
            self.words.forget(_CACHE)
            sums, ends = np.concatenate(([0], np.cumsum(each))), np.cumsum(pc.list_value_length(lists).to_numpy())
            at = sums[np.concatenate(([0], ends))]
            size = np.diff(at)
        if whole.any():
            some = np.flatnonzero(whole)
            more, size[some] = self._ask(texts.filter(pa.array(whole)).to_pylist())
            where = np.repeat(whole, size)
            both = np.zeros(len(where), self.type)
            both[where], both[~where] = more, ids
            ids = both
        stop = np.cumsum(size + 1)
        out = np.full(int(stop[-1]) if n else 0, END_ID, self.type)
        inside = np.ones(len(out), bool)
        inside[stop - 1] = False
        out[inside] = ids
        at = np.concatenate(([0], stop)) * self.type.itemsize
        return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)])


def encoder(path: str) -> WordEncoder:
    return held(("tokens", path), lambda: WordEncoder(path))


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, k (tells equal ids apart), ids (binary) of each row of docs; null texts are empty."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = encoder(path).encode(piece.column(piece.schema.get_field_index("text")))
        return batch_of(["ids"], [found.cast(pa.binary())], [pa.binary()])

    rows = docs.select("doc_id", row_key().alias("k"), "text")
    return map_texts(rows, run, "ids binary", keep=["doc_id", "k"], most=_PIECE)


def count_ids(ids: DataFrame, size: int, kind: str) -> np.ndarray:
    """How often each id of the vocabulary occurs; each task sends at most one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(size, np.int64)
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                count += np.bincount(np.frombuffer(b"".join(batch.column(0).slice(row, 256).to_pylist()), kind), minlength=size)
        some = np.flatnonzero(count)
        yield batch_of(["id", "n"], [some, count[some]], [pa.int64(), pa.int64()])

    out = np.zeros(size, np.int64)
    for r in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def write(docs: DataFrame, tokenizer: str, out: str | None = None, block_tokens: int = BLOCK_TOKENS, partitions: int | None = None) -> tuple[str, Table]:
    """Writes the ids of docs in ascending doc_id (null first; rows of one id by content) and returns the path and table.

    Under the path: blocks (pid, block, start, n, doc_ids, payload; start counts ids from the partition's first), and table,
    the shared frequencies. docs without rows give a path without blocks. A null text has the end id alone; other columns of docs, whatever their names,
    aren't read. A long text is taken whole, at some 60 bytes of memory for each of its words, and is a block of its own.
    """
    spark = docs.sparkSession
    out = out or new_path(spark, "tokens")
    raw = new_path(spark, "ids")
    enc = encoder(tokenizer)
    size, kind = enc.size, enc.type.str
    found = tokenize(docs, tokenizer)
    found.write.option("compression", "zstd").parquet(raw)
    ids = spark.read.schema(found.schema).parquet(raw)
    freq = quantise(count_ids(ids, size, kind))
    spark.createDataFrame([(bytes(freq.freq.astype("<u4").tobytes()), int(freq.crc))], "freq binary, crc long").coalesce(1).write.parquet(f"{out}/table")
    shared = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, block, start = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        names: list[int | None] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, n
            values = np.frombuffer(b"".join(held), kind)
            lengths = np.array([len(x) // np.dtype(kind).itemsize for x in held], np.int64)
            row = batch_of(_BLOCK, [[pid], [block], [start], [len(values)], [names], [encode_block(values, lengths, shared.value)]], [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.binary()])
            block, start, n = block + 1, start + len(values), 0
            held.clear()
            names.clear()
            return row

        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(x)
                names.append(doc_id)
                n += len(x) // np.dtype(kind).itemsize
                if n >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    by_id = (F.col("doc_id"), F.col("k"), F.col("ids"))
    parted = ids.repartitionByRange(partitions, "doc_id", "k") if partitions else ids.repartitionByRange("doc_id", "k")
    parted.sortWithinPartitions(*by_id).select("doc_id", "ids").mapInArrow(run, _SCHEMA).write.option("compression", "uncompressed").parquet(f"{out}/blocks")
    drop_path(spark, raw)
    return out, freq


_BLOCK = ["pid", "block", "start", "n", "doc_ids", "payload"]
_SCHEMA = "pid long, block long, start long, n long, doc_ids array<long>, payload binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files under path alone."""
    row = spark.read.schema("freq binary, crc long").parquet(f"{path}/table").first()
    freq = Table(np.frombuffer(bytes(row.freq), "<u4"))
    if freq.crc != row.crc:
        raise ValueError("the frequency table's checksum doesn't match")
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.schema(_SCHEMA).parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pid, _, start, _, names, payload = (batch.column(c)[i].as_py() for c in range(6))
                ids, lengths = decode_block(payload, shared.value)
                data, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths.astype(np.int64))
                begins = ends - lengths
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield batch_of(["doc_id", "pid", "start", "n_tokens", "ids_crc32"], [names, [pid] * len(names), start + begins, lengths.astype(np.int64), crc], [pa.int64()] * 5)

    found = blocks.mapInArrow(run, "doc_id long, pid long, start long, n_tokens long, ids_crc32 long")
    # one row for each partition of the writer, so neither the window nor the broadcast grows with the documents
    sizes = blocks.groupBy("pid").agg(F.sum("n").alias("n"))
    base = sizes.select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("base"))
    return found.join(F.broadcast(base), "pid").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, write(table(spark, sf_dir, "documents"), word_bpe())[0])
