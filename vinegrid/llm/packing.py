"""Best-fit packing of tokenised documents into sequences of fixed capacity."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vinegrid.llm.common import keep_only, materialize, table, worker_cache

CAPACITY = 2048
SEPARATOR = 0
#: Parts that the ranking of one length is split into; counts per (length, part) are at most CAPACITY * RANK_PARTS rows.
RANK_PARTS = 256
#: Entries of one generation of a worker's cache of encoded chunks.
CACHE = 250_000

_LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)").fullmatch


#: The kind of tokenizer whose texts fall apart at white space: lower-casing, words and digits and marks apart, byte letters.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [_SPLIT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins for bytes of byte-level BPE: printable Latin-1 bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class ChunkEncoder(dict):
    """Chunk between white space -> its ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins over it, so a text's ids are those of its chunks in turn. Two generations
    bound the memory. Chunks of Latin letters, the common case, go to the vocabulary's model straight away (lower-cased, as
    byte letters), all others through the whole tokenizer. A tokenizer whose normalizer and pre-tokenizer are not of that kind
    encodes texts as a whole.
    """

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.old: dict[str, bytes] = {}
        self.whole = Tokenizer.from_file(file)
        self.model = self.whole.model
        self.letters = _byte_letters()
        own = json.loads(self.whole.to_str())
        self.by_chunk = own["normalizer"] == _NORMALIZER and own["pre_tokenizer"] == _PRE_TOKENIZER and own["post_processor"] is None
        self.words: dict[str, bytes] = {}
        self.tails = {x: self._full(x) for x in ("", ".", ",")}

    def _full(self, chunk: str) -> bytes:
        return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            spelt = word if word.isascii() else word.encode().decode("latin1").translate(self.letters)
            found = np.array([x.id for x in self.model.tokenize(spelt)], "<u4").tobytes()
            if len(self.words) >= CACHE:
                self.words = {}
            self.words[word] = found
        return found

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            latin = _LATIN(chunk)
            found = self._word(latin[1].lower()) + self.tails[latin[2]] if latin else self._full(chunk)
        if len(chunk) <= 64:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        if not self.by_chunk:
            return self._full(text)
        chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, chunks))


_ENCODERS: dict[str, ChunkEncoder] = worker_cache({})


def encoder(file: str) -> ChunkEncoder:
    """One encoder for each Python worker."""
    if file not in _ENCODERS:
        _ENCODERS[file] = ChunkEncoder(file)
    return _ENCODERS[file]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenise each text, add the separator and cut what is longer than ``capacity``.

    Returns ``(doc_id, piece, start, length, ids_crc32)`` and, if asked, ``ids`` (little-endian bytes). A null text counts as
    empty: one piece with the separator alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(_ENCODERS)
        encode, end, step = encoder(tokenizer_file(tokenizer)).encode, np.array([SEPARATOR], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            ids, piece, start, length, crc, raw = [], [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    ids.append(key), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if keep_ids:
                        raw.append(part)
            columns = [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * keep_ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return thin.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths, not over items.

    Open sequences are kept as runs with the same room left. From the longest length on, each run that fits best takes as many
    items each as it holds. Returns rows ``(length, rank_from, rank_to, sequence_from, per_sequence, offset)``: the item of
    rank r goes to sequence ``sequence_from + (r - rank_from) div per_sequence``.

    The number of rows is bounded by the capacity alone: a length opens at most two runs and splits one, so there are below
    4 * capacity runs, each hit by at most sqrt(2 * capacity) different lengths; some 20 MB for 2048, in practice far less.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    plan, opened = [], 0
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left, rank = histogram[length], 0

        def place(first: int, n: int, space: int) -> tuple[int, int]:
            """Fill as many as needed of n sequences with that room; how many items and sequences it took."""
            nonlocal left, rank
            each = space // length
            for sequences, items in ((min(n, left // each), each), (1, left % each)):
                if sequences and items and n and left >= items:
                    plan.append((length, rank, rank + sequences * items, first, each, capacity - space))
                    room.setdefault(space - items * length, []).append((first, sequences))
                    rank, left, first, n = rank + sequences * items, left - sequences * items, first + sequences, n - sequences
            return first, n

        for space in sorted(x for x in room if x >= length):
            runs = room.pop(space)
            while runs and left:
                first, n = place(*runs.pop(), space)
                if n:
                    runs.append((first, n))
            if runs:
                room[space] = room.get(space, []) + runs
            if not left:
                break
        if left:
            n = -(-left // (capacity // length))
            place(opened, n, capacity)
            opened += n
    return plan


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece a sequence and an offset.

    ``pieces`` must be a written table (it is read twice). Counts by length (``capacity`` rows at most) go to the driver,
    which plans over counts; the pieces then join their planned slots on length and rank. The rank within a length comes from
    counts of hashed parts, so a length that a third of all pieces share is ranked by many tasks.
    """
    spark = pieces.sparkSession
    parts = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_PARTS)).cast("int"))
    counts = materialize(parts.groupBy("length", "part").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_best_fit(histogram, capacity)
    slots = spark.createDataFrame(plan, "length long, rank_from long, rank_to long, sequence_from long, per_sequence long, base long")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    offsets = counts.select("length", "part", before.alias("before"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = parts.withColumn("in_part", F.row_number().over(order)).join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("in_part") - 1)
    # the plan's size depends on the capacity only, see plan_best_fit
    return (
        ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (ranked["rank"] >= slots["rank_from"]) & (ranked["rank"] < slots["rank_to"]))
        .drop(slots["length"])
        .withColumn("sequence_id", F.expr("sequence_from + (rank - rank_from) div per_sequence"))
        .withColumn("offset", F.expr("base + ((rank - rank_from) % per_sequence) * length"))
        .drop("part", "in_part", "before", "rank", "rank_from", "rank_to", "sequence_from", "per_sequence", "base")
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "word_bpe_49k.json", keep_ids: bool = False) -> DataFrame:
    """Tokenise documents and pack the pieces into as few sequences as best fit gives.

    Null texts are empty texts; null or repeated ids keep one row for each piece. An empty table gives no rows. Columns of the
    input other than ``doc_id`` and ``text`` are ignored.
    """
    return best_fit_pack(materialize(token_pieces(docs, capacity, tokenizer, keep_ids=keep_ids), "pack-pieces"), capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
