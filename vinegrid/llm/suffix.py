"""Repeated substrings: two-stage suffix sorting in content buckets, adjacent common prefixes, byte spans to remove."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinegrid.llm.common import grouped_batches, keyed_documents, materialize, table

#: Bytes of a string that counts as repeated, of the gram that names its bucket.
LENGTH = 100
GRAM = 32
#: Windows of one context at most; contexts that a task sorts in one bucket (larger buckets go by window hash).
CONTEXT = 128
BUCKET = 20_000
#: Bytes that are hashed at once.
CHUNK = 1 << 18

_NONE = np.zeros(0, np.int64)


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base, of its inverse modulo 2**64, and a value for each byte."""
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(CHUNK + LENGTH + 1, base, np.uint64))
        down = np.cumprod(np.full(CHUNK + LENGTH + 1, pow(base, -1, 1 << 64), np.uint64))
    return up, down, np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _minima(grams: np.ndarray) -> list[np.ndarray]:
    """Minimum over the next 1, 2, 4 ... 64 places, for each place; beyond the end counts as largest."""
    levels = [grams]
    for k in range(6):
        one, width = levels[-1], 1 << k
        two = one.copy()
        two[:-width] = np.minimum(one[:-width], one[width:])
        levels.append(two)
    return levels


def _next_equal(levels: list[np.ndarray], place: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """The first place, from ``place`` on, whose value is ``goal`` or less; some place beyond if it is further than 200."""
    last = len(levels[0]) - 1
    for k in (6, 6, 6, 5, 4, 3, 2, 1, 0):
        place = np.where(levels[k][np.minimum(place, last)] > goal, place + (1 << k), place)
    return place


def chunk_contexts(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts of a chunk of texts: ``(text, start, windows, gram, doubled)``.

    low, high: byte ranges of the texts. A window is a string of LENGTH bytes; its gram is the smallest hash of the GRAM-byte
    strings in it, so equal windows have equal grams wherever they are. A context is a run of windows of one gram; doubled
    contexts hold their gram twice and so may hold a window twice.
    """
    up, down, value = _powers()
    n = len(data)
    width = LENGTH - GRAM + 1
    if n < LENGTH:
        return _NONE, _NONE, _NONE, _NONE, _NONE
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[data] * up[:n])])
        grams = (total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1]
        grams = (grams ^ (grams >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        grams ^= grams >> np.uint64(29)
    levels = _minima(grams)
    windows = n - LENGTH + 1
    six = levels[6]
    least = np.minimum(six[:windows], six[width - 64 : width - 64 + windows])
    text = np.repeat(np.arange(len(low)), high - low)[:windows]
    place = np.arange(windows)
    valid = place + LENGTH <= high[text]
    fresh = np.ones(windows, bool)
    fresh[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    fresh &= valid
    start = np.flatnonzero(fresh)
    if not len(start):
        return _NONE, _NONE, _NONE, _NONE, _NONE
    stop = np.minimum(np.append(start[1:], windows), high[text[start]] - LENGTH + 1)
    pieces = -(-(stop - start) // CONTEXT)
    at = np.repeat(np.arange(len(start)), pieces)
    start_ = start[at] + CONTEXT * (np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    count = np.minimum(stop[at] - start_, CONTEXT)
    gram = least[start_]
    first = _next_equal(levels, start_, gram)
    second = _next_equal(levels, first + 1, gram)
    return text[start_], start_, count, gram, second < start_ + count + width - 1


def merged(key: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts put in order and joined where they meet or overlap."""
    order = np.lexsort((start, key))
    key, start, stop = key[order], start[order], (start + count)[order]
    if not len(key):
        return key, start, stop
    fresh = np.ones(len(key), bool)
    # runs come in order and those of one text seldom overlap; the running end needs the largest so far in the text
    reach = stop.copy()
    same = key[1:] == key[:-1]
    for k in np.flatnonzero(same & (start[1:] <= reach[:-1])):
        reach[k + 1] = max(reach[k + 1], reach[k])
        fresh[k + 1] = False
    for k in np.flatnonzero(same & fresh[1:]):
        if start[k + 1] <= reach[k]:
            reach[k + 1] = max(reach[k + 1], reach[k])
            fresh[k + 1] = False
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(key)) - 1
    return key[first], start[first], reach[last] - start[first]


_ROW = "gram long, ctx long, key long, start long, n int, kind int"
#: Kinds of rows: windows to remove; contexts; contexts that may hold a window twice.
REMOVE, PLAIN, DOUBLED = 0, 1, 2


def _rows(gram, ctx, key, start, n, kind) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((gram, ctx, key, start, n, kind), kinds)], names=["gram", "ctx", "key", "start", "n", "kind"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of whole texts. Of equal contexts in a batch only the first goes on, the others' windows are to be removed."""
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        texts = batch.column(1).cast(pa.binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        if raw is None or not len(keys):
            continue
        data, view = np.frombuffer(raw, np.uint8), memoryview(raw)
        found: list[list[np.ndarray]] = []
        digest = xxhash.xxh3_64_intdigest
        k = 0
        while k < len(keys):
            # texts up to a chunk, or one long text in overlapping chunks
            last = max(k + 1, int(np.searchsorted(offsets, offsets[k] + CHUNK, "right")) - 1)
            for begin in range(int(offsets[k]), max(int(offsets[last]), int(offsets[k]) + 1), CHUNK):
                end = min(begin + CHUNK + LENGTH - 1, int(offsets[last]))
                text, start, n, gram, doubled = chunk_contexts(data[begin:end], np.maximum(offsets[k:last] - begin, 0), np.minimum(offsets[k + 1 : last + 1], end) - begin)
                start = start + begin
                ctx = np.array([digest(view[a:b]) for a, b in zip(start.tolist(), (start + n + LENGTH - 1).tolist())], np.uint64)
                found.append([gram.astype(np.uint64).view(np.int64), ctx.view(np.int64), keys[text + k], start - offsets[text + k], n, np.where(doubled, DOUBLED, PLAIN)])
            k = last
        gram, ctx, key, start, n, kind = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((start, key, ctx, gram))
        gram, ctx, key, start, n, kind = (x[order] for x in (gram, ctx, key, start, n, kind))
        first = np.ones(len(gram), bool)
        first[1:] = (gram[1:] != gram[:-1]) | (ctx[1:] != ctx[:-1])
        later = ~first & _elsewhere(first, key, start)
        gone = merged(key[later], start[later], n[later])
        spread = gone[0] * 31 + gone[1]  # rows to remove only travel along, dealt out evenly
        zero = np.zeros(len(spread), np.int64)
        yield _rows(*(np.concatenate(x) for x in zip((gram[first], ctx[first], key[first], start[first], n[first], kind[first]), (spread, zero, *gone, zero + REMOVE))))


def _elsewhere(first: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether a row's place differs from that of the first row of its group (a repeated row of the table has the same place)."""
    if not len(first):
        return first
    lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    return (key != key[lead]) | (start != start[lead])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over contexts sorted by (gram, ctx, key, start), with one row of memory.

    Windows of all but the first of equal contexts are to be removed. First contexts go on to be sorted if their gram has
    other contexts, too, or if they may hold a window twice.
    """
    lead = None  # first row of the class that the last batch ended in
    pending = None  # the only context of its gram so far, not yet passed on
    last_gram = None
    for batch in batches:
        gram, ctx, key, start, n, kind = (batch.column(k).to_numpy() for k in range(6))
        travel = kind == REMOVE
        out = [[x[travel] for x in (gram, ctx, key, start, n, kind)]]
        rows = [x[~travel] for x in (gram, ctx, key, start, n, kind)]
        if len(rows[0]):
            carried = lead is not None
            if carried:
                rows = [np.concatenate([[a], x]).astype(x.dtype) for a, x in zip(lead, rows)]
            gram, ctx, key, start, n, kind = rows
            first = np.ones(len(gram), bool)
            first[1:] = (gram[1:] != gram[:-1]) | (ctx[1:] != ctx[:-1])
            later = ~first & _elsewhere(first, key, start)
            gone = merged(key[later], start[later], n[later])
            zero = np.zeros(len(gone[0]), np.int64)
            out.append([zero, zero, *gone, zero + REMOVE])
            at = np.flatnonzero(first)
            own = at[1:] if carried else at  # the carried class has been dealt with already, but for pending
            group = gram[own]
            size = np.zeros(len(own), np.int64)
            if len(own):
                new = np.ones(len(own), bool)
                new[1:] = group[1:] != group[:-1]
                label = np.cumsum(new) - 1
                size = np.bincount(label)[label]
                goes = (size > 1) | (group == last_gram) if last_gram is not None else size > 1
                if pending is not None and group[0] == last_gram:
                    out.append([np.array([x]) for x in pending])
                    pending = None
                elif pending is not None:
                    if pending[5] == DOUBLED:
                        out.append([np.array([x]) for x in pending])
                    pending = None
                tail = own[-1]
                if size[-1] == 1 and not goes[-1]:  # alone so far
                    pending = [x[tail] for x in rows]
                    out.append([x[own[:-1]][(goes | (kind[own] == DOUBLED))[:-1]] for x in rows])
                else:
                    out.append([x[own][goes | (kind[own] == DOUBLED)] for x in rows])
                last_gram = group[-1]
            lead = [x[at[-1]] for x in rows]
        yield _rows(*(np.concatenate(x) for x in zip(*out)))
    if pending is not None and pending[5] == DOUBLED:
        yield _rows(*([x] for x in pending))


def _words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one big-endian number; zeros follow the end."""
    word = np.concatenate([text, np.zeros(LENGTH + 8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        word[:-width] = (word[:-width] << np.uint64(8 * width)) | word[width:]
    return word


def two_stage_sort(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` (uint8, ending in 0) in order of their first LENGTH bytes at least.

    Suffixes smaller than their successor are sorted directly, in words of 8 bytes, ties going on to the next word. All others
    follow: in a scan of the buckets from the smallest first byte on, each suffix found puts the one that starts a byte
    earlier, if that is larger than its successor, at the end of what its own bucket has so far.
    """
    n = len(text)
    step = np.ones(n, bool)
    step[:-1] = text[:-1] != text[1:]
    turn = np.flatnonzero(step)
    smaller = np.ones(n, bool)  # the last one counts as smaller
    smaller[:-1] = text[:-1] < text[1:]
    smaller = smaller[turn[np.searchsorted(turn, np.arange(n))]]
    word = _words(text)
    direct = np.flatnonzero(smaller)
    key = word[direct]
    order = np.argsort(key, kind="stable")
    direct, key = direct[order], key[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(key) else key.astype(np.int64)
    for depth in range(8, LENGTH + 8, 8):
        tied = np.zeros(len(group), bool)
        tied[1:] = group[1:] == group[:-1]
        tied[:-1] |= tied[1:].copy()
        at = np.flatnonzero(tied)
        if not len(at):
            break
        key = word[np.minimum(direct[at] + depth, len(word) - 1)]
        order = np.lexsort((key, group[at]))
        direct[at], key = direct[at][order], key[order]
        split = np.zeros(len(group), np.int64)
        own = group[at]
        split[at[1:]] = (key[1:] != key[:-1]) & (own[1:] == own[:-1])
        group = group + np.cumsum(split)
    by_byte = text[direct]
    pending: dict[int, list[np.ndarray]] = defaultdict(list)
    out = []
    for byte in np.unique(text).tolist():
        bucket = pending.pop(byte, [])
        run = np.concatenate(bucket) if bucket else _NONE
        while len(run):  # repeats of the byte
            run = run[run > 0] - 1
            run = run[(text[run] == byte) & ~smaller[run]]
            bucket.append(run)
        bucket.append(direct[np.searchsorted(by_byte, byte, "left") : np.searchsorted(by_byte, byte, "right")])
        bucket = np.concatenate(bucket)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~smaller[before] & (text[before] > byte)]
        lead = text[before]
        order = np.argsort(lead, kind="stable")
        before, lead = before[order], lead[order]
        cuts = np.flatnonzero(lead[1:] != lead[:-1]) + 1
        for part in np.split(before, cuts):
            if len(part):
                pending[int(text[part[0]])].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each suffix in ``order`` shares its first LENGTH bytes with the one before it."""
    word = _words(text)
    same = np.zeros(len(order), bool)
    at = np.arange(1, len(order))
    for depth in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        a, b = np.minimum(order[at - 1] + depth, len(word) - 1), np.minimum(order[at] + depth, len(word) - 1)
        at = at[word[a] == word[b]]
    same[at] = True
    return same


def repeated_windows(contexts: list[bytes], key: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the contexts that also start earlier, as runs ``(key, start, count)``. Needs UTF-8 bytes (none is 255)."""
    text = np.frombuffer(b"\xff".join([*contexts, b""]), np.uint8) + np.uint8(1)  # the mark between contexts becomes 0
    size = np.array([len(x) + 1 for x in contexts])
    low = np.cumsum(size) - size
    order = two_stage_sort(text)
    group = np.cumsum(~common_prefixes(text, order))
    owner = np.searchsorted(low, order, "right") - 1
    window = order - low[owner] < count[owner]
    group, owner, place = group[window], owner[window], start[owner[window]] + (order - low[owner])[window]
    keys = key[owner]
    by = np.lexsort((place, keys, group))
    group, keys, place = group[by], keys[by], place[by]
    first = np.ones(len(group), bool)
    first[1:] = group[1:] != group[:-1]
    later = ~first & _elsewhere(first, keys, place)
    return merged(keys[later], place[later], np.ones(int(later.sum()), np.int64))


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in grouped_batches(batches, 1):
        key, start, n = (part[c].to_numpy() for c in ("key", "start", "n"))
        gone = repeated_windows(part["bytes"].to_pylist(), key, start, n)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in gone], names=["key", "start", "n"])


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, contexts of the text) to a row for each context with its bytes."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for key, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
            data = text.as_py()
            for w in wanted:
                for column, x in zip(out, (w["gram"], key, w["start"], w["n"], data[w["start"] : w["start"] + w["n"] + LENGTH - 1])):
                    column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["gram", "key", "start", "n", "bytes"])


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], []]
        for key, start, n, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
            for k in range(n):
                for column, x in zip(out, (xxhash.xxh3_128_digest(data[k : k + LENGTH]), key, start + k)):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.binary(), pa.int64(), pa.int64()))], names=["h", "key", "start"])


def removable_windows(keyed: DataFrame) -> DataFrame:
    """``(key, start, n)``: the windows start .. start + n - 1 of that text start earlier somewhere, too.

    1. Each window belongs to the bucket of its smallest gram hash, so equal windows meet in one bucket. Runs of windows of one
       bucket, some 35 on average, are one context; its hash, place and length are shuffled, not its bytes. Equal contexts of a
       batch are put together before the shuffle.
    2. Equal contexts: all but the first go. First contexts of a gram that others share, too, are fetched with their bytes.
    3. Each bucket's contexts are suffix-sorted; windows that share LENGTH bytes with a neighbour in the order are one
       group, and all but the first place go. Buckets of over BUCKET contexts are grouped by 128-bit hashes of their windows.
    """
    spark = keyed.sparkSession
    contexts = keyed.select("key", "text").mapInArrow(_contexts, _ROW)
    resolved = materialize(contexts.repartition("gram").sortWithinPartitions("gram", "ctx", "key", "start").mapInArrow(_resolve, _ROW), "suffix-contexts")
    removed = resolved.where(F.col("kind") == REMOVE).select("key", "start", F.col("n").cast("long").alias("n"))
    wanted = resolved.where(F.col("kind") != REMOVE).select("gram", "key", "start", "n").distinct()
    by_text = wanted.groupBy("key").agg(F.collect_list(F.struct("gram", "start", "n")).alias("wanted"))
    cut = materialize(keyed.select("key", "text").join(by_text, "key").mapInArrow(_cut_contexts, "gram long, key long, start long, n int, bytes binary"), "suffix-bytes")
    large = materialize(cut.groupBy("gram").agg(F.count("*").alias("m")).where(F.col("m") > BUCKET).select("gram"), "suffix-large")
    few = cut
    if not large.isEmpty():
        few = cut.join(large, "gram", "left_anti")
        windows = cut.join(large, "gram", "left_semi").select("key", "start", "n", "bytes").mapInArrow(_window_hashes, "h binary, key long, start long")
        windows = materialize(windows.distinct(), "suffix-windows")
        first = windows.groupBy("h").agg(F.min(F.struct("key", "start")).alias("first"))
        later = windows.join(first, "h").where(F.struct("key", "start") != F.col("first"))
        removed = removed.union(later.select("key", "start", F.lit(1).cast("long").alias("n")))
    sorted_ = few.repartition("gram").sortWithinPartitions("gram").mapInArrow(_sort_buckets, "key long, start long, n long")
    return removed.union(sorted_)


def _apply(keep_bytes: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text, runs in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
                data, spans = text.as_py(), []
                for start, n in sorted((r["start"], r["n"]) for r in runs or ()):
                    stop = start + n - 1 + LENGTH
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], stop)
                    else:
                        spans.append([start, stop])
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                for column, x in zip(out, (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept if keep_bytes else None)):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return apply


def remove_repeats(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """One row per document: ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept)``.

    Each byte that a string of LENGTH bytes covers which also starts earlier (smaller doc_id, or same document, earlier start)
    is removed, as judged on the input. ``kept`` holds the remaining bytes if asked for. Null texts are empty; a null id comes
    before all others; rows that repeat id and text count as one document, rows that repeat only the id are put in order by
    their text's hash. An empty table gives no rows.
    """
    keyed = keyed_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))).withColumnRenamed("_key", "key")
    runs = removable_windows(keyed).groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    joined = keyed.join(runs, "key", "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(_apply(keep_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<bigint>>, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
