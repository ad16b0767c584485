"""Substring dedup by paragraphs: MinHash banding, exact Jaccard, removal by components.

Two kinds of paragraphs are banded: the lines of a text, and pieces of PIECE words that start at words picked by their content,
so that a passage within longer lines has the same pieces wherever it stands. A piece that repeats ends where the pick ends it,
not where the passage does, so each repeated stretch is then compared, word by word, with what surrounds its first copy, and
goes up to its first and last word.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vinegrid.llm.common import bound_batches, connected_components, discard, grouped_batches, keep_only, keyed_documents, local_roots, materialize, sliced, table, worker_cache
from vinegrid.llm.trie import trie_pairs

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
#: Lines of fewer words are left alone, but for pieces that they are part of: short lines repeat by chance.
MIN_WORDS = 20
#: Words of a piece. Of each so many words in a row one starts a piece, so any passage of 2 * PIECE - 1 words (51) holds a whole
#: piece, the same one wherever the passage stands. Pieces have bands of their own: there are many, most without a copy. Equal
#: ones, which passages have, meet in any band; the recall is that of pieces just at the threshold.
PIECE = 26
PIECE_RECALL = 0.98
PIECE_HASHES = 9
#: Up to so many distinct paragraphs of a band bucket make pairs; larger buckets are compared in tiles of TILE rows.
PAIRED = 16
TILE = 1024
#: Differing bits up to which whole texts are candidates (see simhash.keep_one_of_group).
TEXT_BUDGET = 24
#: Words that are hashed at once, and entries of a worker's cache of word hashes.
WORDS = 1 << 16
CACHE = 100_000


def tune_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 36) -> tuple[int, int]:
    """Rows and bands with the most rows a band, so the fewest chance candidates, that find a pair at the threshold with that
    probability, ``most`` hashes at most."""
    fit = [(r, ceil(log(1 - recall) / log(1 - threshold**r))) for r in range(1, 9)]
    return max((r, b) for r, b in fit if r * b <= most)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = worker_cache(_WordHashes())


def word_hashes(paragraph: str) -> np.ndarray:
    return hashes_of(paragraph.lower().split())


def hashes_of(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """A hash of each run of ``shingle`` words (of all, if they are fewer)."""
    size = max(min(shingle, len(words)), 1)
    code = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        code = (code ^ words[k : k + len(code)]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code


def laid_out(words: list[np.ndarray], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The shingles' hashes of all paragraphs end to end, hashed at once, and where each paragraph's begin."""
    size = np.array([len(w) for w in words])
    count = np.maximum(size - shingle + 1, 1)
    low = np.cumsum(count) - count
    codes = np.empty(int(count.sum()), np.uint64)
    start = np.cumsum(size) - size
    long = size >= shingle
    owner = np.repeat(np.arange(len(words)), count)
    own = long[owner]
    if long.any():
        codes[own] = shingle_hashes(np.concatenate(words), shingle)[(np.arange(len(codes)) + (start - low)[owner])[own]]
    for n in np.flatnonzero(~long):
        codes[low[n]] = shingle_hashes(words[n], shingle)[0]
    return codes, low


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(17).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(words: list[np.ndarray], rows: int, bands: int, shingle: int = SHINGLE) -> np.ndarray:
    """Paragraphs x bands: MinHash signatures of the shingles, hashed band by band. Each paragraph needs a word at least."""
    codes, low = laid_out(words, shingle)
    keys = np.empty((len(words), bands), np.uint64)
    mult = _multipliers(rows * bands)
    for band in range(bands):
        key = np.full(len(words), np.uint64(band))
        for k in range(rows):
            least = np.minimum.reduceat(codes * mult[band * rows + k], low)
            key = (key ^ least) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        keys[:, band] = key
    return keys


def paragraphs(text: str | None) -> list[str]:
    """Lines of a text; joined with line feeds they give it back."""
    return (text or "").split("\n")


def _whole(text: str | None) -> list[str]:
    return [text or ""]


def piece_starts(words: np.ndarray, low: np.ndarray, high: np.ndarray, width: int = PIECE) -> np.ndarray:
    """Places of the words that start a piece, in texts laid end to end (low, high: their ranges).

    A word is picked if it has the smallest hash, the first of equals, of any ``width`` words in a row of its text.
    """
    n = len(words)
    if n < width:
        return np.zeros(0, np.int64)
    place = np.arange(n, dtype=np.uint64)
    value = ((words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(28) << np.uint64(28)) | place
    span, least = 1, value
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: n - width + 1], least[width - span : width - span + n - width + 1])
    end = np.repeat(high, high - low)
    picked = np.unique((least & np.uint64((1 << 28) - 1))[np.arange(n - width + 1) + width <= end[: n - width + 1]]).astype(np.int64)
    return picked[picked + width <= end[picked]]


def piece_hashes(words: np.ndarray, starts: np.ndarray, width: int = PIECE) -> np.ndarray:
    """A hash of the ``width`` words from each start."""
    code = np.ones(len(starts), np.uint64)
    for k in range(width):
        code = (code + words[starts + k]) * np.uint64(0xD6E8FEB86659FD93)
        code ^= code >> np.uint64(32)
    return code


def piece_keys(codes: np.ndarray, starts: np.ndarray, rows: int, bands: int, shingles: int) -> np.ndarray:
    """Pieces x bands, as band_keys; codes: hashes of the shingles from each word of the texts."""
    part = codes[starts + np.arange(shingles)[:, None]]
    keys = np.empty((len(starts), bands), np.uint64)
    mult = _multipliers(rows * bands)
    for band in range(bands):
        key = np.full(len(starts), np.uint64(1000 + band))
        for k in range(rows):
            key = (key ^ (part * mult[band * rows + k]).min(axis=0)) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        keys[:, band] = key
    return keys


def fingerprint(codes: np.ndarray) -> int:
    """SimHash of the shingles' hashes, as signed 64-bit integer."""
    counts = np.zeros(64, np.int64)
    for low in range(0, len(codes), 1 << 16):
        part = codes[low : low + (1 << 16)] * np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(31)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(codes)).view(np.int64)[0])


# A paragraph's place is (key, par): par is 2 * n for line n, 2 * n + 1 for a piece from word n on, and a whole text's fingerprint.
_ROW = ["bucket", "hash", "key", "par", "band"]


def _banded(min_words: int, shingle: int, lines: tuple[int, int], pieces: tuple[int, int], whole: bool = False):
    split = _whole if whole else paragraphs

    def rows_of(keys: np.ndarray, code: np.ndarray, key: np.ndarray, par: np.ndarray) -> list[np.ndarray]:
        bands = keys.shape[1]
        own = np.repeat(code[:, None], bands, axis=1)
        own[:, 1:] >>= np.uint64(32)  # copies go by the first band; in the others half a hash, which packs better, tells classes apart
        return [keys.view(np.int64).ravel(), own.view(np.int64).ravel(), np.repeat(key, bands), np.repeat(par, bands), np.tile(np.arange(bands), len(key))]

    def known(first_key: np.ndarray, first_par: np.ndarray, key: np.ndarray, par: np.ndarray) -> list[np.ndarray]:
        """Copies of a paragraph of the batch only travel along, dealt out evenly; hash and band hold the first place."""
        return [key * 31 + par * 0x9E3779B9, first_key, key, par, np.full(len(key), -1) if whole else -1 - first_par]

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row (bucket, words' hash, key, par, band) for each band of each line and piece. Of equal ones of a batch only the
        first is banded, the others are known as its copies. With ``whole``, texts are banded as they are, without pieces."""
        keep_only(_HASHES)
        for batch in sliced(batches, 1000):
            out: list[list[np.ndarray]] = []
            places: dict[int, tuple[int, int]] = {}
            copies: list[tuple[int, int, int, int]] = []
            cut: list[list[np.ndarray]] = []
            texts: list[tuple[int, np.ndarray]] = []
            held: list[tuple[int, int, int, np.ndarray]] = []
            size = 0

            def flush() -> None:
                if held:
                    hashes, keys, pars = np.array([h[0] for h in held], np.uint64), *(np.array([h[k] for h in held], np.int64) for k in (1, 2))
                    out.append(rows_of(band_keys([h[3] for h in held], *lines, shingle), hashes, keys, pars))
                if texts:
                    words = np.concatenate([w for _, w in texts])
                    high = np.cumsum([len(w) for _, w in texts])
                    low = high - np.array([len(w) for _, w in texts])
                    starts = piece_starts(words, low, high)
                    owner = np.searchsorted(high, starts, "right")
                    at = 2 * (starts - low[owner]) + 1
                    cut.append([piece_keys(shingle_hashes(words, shingle), starts, *pieces, PIECE - shingle + 1), piece_hashes(words, starts), np.array([k for k, _ in texts], np.int64)[owner], at])
                held.clear()
                texts.clear()

            for key, at in sorted(zip(batch.column(0).to_pylist(), range(batch.num_rows))):
                found = [word_hashes(line) for line in split(batch.column(1)[at].as_py())]
                if not whole:
                    texts.append((key, np.concatenate(found)))
                size += sum(map(len, found))
                for n, words in enumerate(found):
                    if len(words) < min_words:
                        continue
                    if not len(words):  # all texts without words are equal
                        words = np.zeros(1, np.uint64)
                    own = xxhash.xxh3_64_intdigest(words.tobytes())
                    par = fingerprint(shingle_hashes(words, shingle)) if whole else 2 * n
                    if own in places:
                        copies.append((*places[own], key, par))
                    else:
                        places[own] = key, par
                        held.append((own, key, par, words))
                if size >= WORDS:
                    flush()
                    size = 0
            flush()
            if copies:
                out.append(known(*(np.array(x, np.int64) for x in zip(*copies))))
            if cut:
                keys, code, key, par = (np.concatenate(x) for x in zip(*cut))
                order = np.lexsort((par, key, code))
                keys, code, key, par = (x[order] for x in (keys, code, key, par))
                first = np.ones(len(code), bool)
                first[1:] = code[1:] != code[:-1]
                lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
                later = ~first & ((key != key[lead]) | (par != par[lead]))
                out.append(rows_of(keys[first], code[first], key[first], par[first]))
                out.append(known(key[lead[later]], par[lead[later]], key[later], par[later]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], names=_ROW)

    return banded


#: Kinds of rows: a copy of the first equal paragraph; a copy of the first one of its batch; a candidate pair; a paragraph of a
#: bucket too large for pairs; with whole texts, the first of each class of equal ones with its fingerprint.
COPY, KNOWN, PAIR, LARGE, TEXT = 0, 1, 2, 3, 4
_FOUND = "kind int, bucket long, key_a long, par_a long, key_b long, par_b long"


def _apart(key_a: np.ndarray, par_a: np.ndarray, key_b: np.ndarray, par_b: np.ndarray) -> np.ndarray:
    """Pieces of a text that overlap are no pair."""
    return (key_a != key_b) | (par_a % 2 == 0) | (np.abs(par_b - par_a) >= 2 * PIECE)


def _bucketed(whole: bool = False):
    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets sorted by (bucket, hash, key, par) to copies, candidate pairs and members of large buckets."""
        for part in grouped_batches(batches, 1):
            bucket, code, key, par, band = (part.column(k).to_numpy() for k in range(5))
            known = band < 0
            zero = np.zeros(int(known.sum()), np.int64)
            rows = [[zero + KNOWN, zero, key[known], par[known], code[known], par[known] if whole else -1 - band[known]]]
            bucket, code, key, par, band = (x[~known] for x in (bucket, code, key, par, band))
            first = np.ones(len(bucket), bool)
            first[1:] = (bucket[1:] != bucket[:-1]) | (code[1:] != code[:-1])
            lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
            copy = np.flatnonzero(~first & (band == 0) & ((key != key[lead]) | (par != par[lead])))
            zero = np.zeros(len(copy), np.int64)
            rows.append([zero + COPY, zero, key[copy], par[copy], key[lead[copy]], par[lead[copy]]])
            own = np.flatnonzero(first)
            if whole:
                text = own[band[own] == 0]
                zero = np.zeros(len(text), np.int64)
                rows.append([zero + TEXT, zero, key[text], par[text], zero, zero])
                # by fingerprint, as the trie's self-join needs them
                own = own[np.lexsort((par[own].view(np.uint64), bucket[own]))]
            new = np.ones(len(own) + 1, bool)
            new[1:-1] = bucket[own[1:]] != bucket[own[:-1]]
            edge = np.flatnonzero(new)
            size = np.diff(edge)
            pairs = [np.zeros((2, 0), np.int64)]
            if whole:
                node = np.stack([edge[:-1], edge[1:]], 1)[(size > 1) & (size <= PAIRED)]
                zero = np.zeros(len(node), np.int64)
                pairs.append(np.stack(trie_pairs(par[own].view(np.uint64), node, node, zero, zero, TEXT_BUDGET)))
            else:
                for n in np.unique(size[(size > 1) & (size <= PAIRED)]):
                    at = edge[:-1][size == n]
                    i, j = (np.array(x) for x in zip(*combinations(range(n), 2)))
                    pairs.append(np.stack([(at[:, None] + i).ravel(), (at[:, None] + j).ravel()]))
            a, b = own[np.concatenate(pairs, axis=1)]
            turn = (key[a] > key[b]) | ((key[a] == key[b]) & (par[a] > par[b]))
            a, b = np.where(turn, b, a), np.where(turn, a, b)
            apart = _apart(key[a], par[a], key[b], par[b])
            a, b = a[apart], b[apart]
            zero = np.zeros(len(a), np.int64)
            rows.append([zero + PAIR, zero, key[a], par[a], key[b], par[b]])
            a = own[np.repeat(size > PAIRED, size)]
            zero = np.zeros(len(a), np.int64)
            rows.append([zero + LARGE, bucket[a], key[a], par[a], zero, zero])
            kind, *others = (np.concatenate(x) for x in zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), *(pa.array(x) for x in others)], names=["kind", "bucket", "key_a", "par_a", "key_b", "par_b"])

    return bucketed


def _short(words: np.ndarray) -> np.ndarray:
    """Word hashes in 32 bits, for comparisons side by side."""
    return (words >> np.uint64(32)).astype(np.uint32)


def _around(words: list[str], start: int) -> tuple[np.ndarray, np.ndarray]:
    """Short hashes of the words before a piece, nearest first, and behind it, PIECE - 1 at most."""
    before, behind = words[max(start - PIECE + 1, 0) : start], words[start + PIECE : start + 2 * PIECE - 1]
    return _short(hashes_of(before[::-1])), _short(hashes_of(behind))


def _looked_up(shingle: int, whole: bool = False):
    split = _whole if whole else paragraphs

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingles of the wanted paragraphs, and of the wanted pieces the words before (nearest first) and behind them."""
        for batch in sliced(batches, 500):
            out: list[list] = [[], [], [], [], []]
            for key, text, wanted, around in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                text = text.as_py() or ""
                lines, words = split(text), text.lower().split()  # words are the same whether or not lines are cut first
                for par in wanted:
                    part = word_hashes(text if whole else lines[par // 2]) if whole or par % 2 == 0 else hashes_of(words[par // 2 : par // 2 + PIECE])
                    part = part if len(part) else np.zeros(1, np.uint64)
                    for column, x in zip(out, (key, par, np.unique(shingle_hashes(part, shingle)).tobytes(), None, None)):
                        column.append(x)
                for par in around:
                    for column, x in zip(out, (key, par, None, *(x.tobytes() for x in _around(words, par // 2)))):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["key", "par", "shingles", "before", "behind"])

    return looked_up


def _verified(threshold: float):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (4, 5))
            near = []
            for x, y in zip(a, b):
                n = (len(x) + len(y)) // 8
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                near.append(shared >= threshold * (n - shared))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near, pa.bool_())) for c in batch.columns[:4]], names=["key_a", "par_a", "key_b", "par_b"])

    return verified


def _tile_links(threshold: float):
    def links(part: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in part["shingles"].to_pylist()]
        key, par = part["key"].to_numpy(), part["par"].to_numpy()
        size = np.array([len(s) for s in sets])
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size)
        shared = np.zeros((len(sets), len(sets)), np.float32)
        more = times > 1  # what stands in one set only is not shared
        row, column = row[more[column]], (np.cumsum(more) - 1)[column[more[column]]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        width = 1 << 12  # columns at once, to bound the dense block
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, low), np.searchsorted(column, low + width)
            block = np.zeros((len(sets), width), np.float32)
            block[row[a:b], column[a:b] - low] = 1
            shared += block @ block.T
        i, j = np.nonzero(np.triu(shared >= threshold * (size[:, None] + size - shared), 1))
        apart = _apart(key[i], par[i], key[j], par[j])
        i, j = i[apart], j[apart]
        order = np.lexsort((par, key))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        root = local_roots(len(order), place[i], place[j])
        at = np.flatnonzero(root != np.arange(len(root)))
        a, b = order[at], order[root[at]]
        return pa.table({"key_a": pa.array(key[a]), "par_a": pa.array(par[a]), "key_b": pa.array(key[b]), "par_b": pa.array(par[b])})

    return links


_ENDS = ["key_a", "par_a", "key_b", "par_b"]


def paragraph_groups(keyed: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, min_words: int = MIN_WORDS, shingle: int = SHINGLE, whole: bool = False, joined: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """``(key, par, first_key)`` of each line or piece that has a copy earlier in the corpus, and what surrounds pieces.

    keyed: (_key, text). Lines of ``min_words`` words or more and pieces are banded; equal ones of a bucket are one class, named
    by its first place, and all but that go. Classes that meet in a band are verified by the exact Jaccard similarity of their word shingles: small
    buckets as pairs, large ones in tiles, a task each, of which a forest of links comes back. Links make components of
    classes, and the first place of each is not in the result. first_key: a text that holds the like earlier. With ``whole``, texts are taken as one paragraph each, without pieces, and
    of the texts of a small bucket only those are verified whose fingerprints differ in TEXT_BUDGET bits at most, found by the
    self-join of the fingerprints' trie. ``joined`` gives further candidates (key_a, par_a, key_b, par_b) from the distinct texts
    (key, par), par being their fingerprint. Candidates that stand in one large bucket are compared in its tiles alone.

    The second table has ``(key, start, before, behind)`` for each repeated piece without another one right before or behind
    it in its text: up to PIECE - 1 words, as 32-bit hashes, on either side of its first copy. None with ``whole``. Both read the written tables
    that come third, which may be discarded once the results are written.
    """
    lines, pieces = tune_bands(threshold, recall), tune_bands(threshold, PIECE_RECALL, PIECE_HASHES)
    thin = keyed.select(F.col("_key").alias("key"), "text")
    banded = thin.mapInArrow(_banded(min_words, shingle, lines, pieces, whole), "bucket long, hash long, key long, par long, band long")
    found = materialize(banded.repartition("bucket").sortWithinPartitions("bucket", "hash", "key", "par").mapInArrow(_bucketed(whole), _FOUND), "par-found", release=True)
    pairs = found.where(F.col("kind") == PAIR).select(*_ENDS)
    large = found.where(F.col("kind") == LARGE).select("bucket", F.col("key_a").alias("key"), F.col("par_a").alias("par"))
    if joined:
        pairs = pairs.union(joined(found.where(F.col("kind") == TEXT).select(F.col("key_a").alias("key"), F.col("par_a").alias("par"))).select(*_ENDS)).distinct()
        buckets = large.groupBy("key", "par").agg(F.collect_set("bucket").alias("buckets"))
        for x in "ab":
            pairs = pairs.join(buckets.select(F.col("key").alias(f"key_{x}"), F.col("par").alias(f"par_{x}"), F.col("buckets").alias(f"buckets_{x}")), [f"key_{x}", f"par_{x}"], "left")
        pairs = pairs.where("NOT coalesce(arrays_overlap(buckets_a, buckets_b), false)").select(*_ENDS)
    pairs = materialize(pairs.distinct(), "par-pairs")
    wanted = pairs.select(F.col("key_a").alias("key"), F.col("par_a").alias("par")).union(pairs.select("key_b", "par_b")).union(large.select("key", "par")).distinct()
    copies = found.where(F.col("kind").isin(COPY, KNOWN)).select(*_ENDS)
    null = F.lit(None).cast("long")
    requests = wanted.select("key", F.col("par").alias("wanted"), null.alias("around"))
    if not whole:
        place = Window.partitionBy("key").orderBy("par")
        ends = copies.where("par_a % 2 = 1").select(F.col("key_a").alias("key"), F.col("par_a").alias("par"), "key_b", "par_b")
        ends = ends.withColumn("gap_before", F.col("par") - F.lag("par").over(place)).withColumn("gap_behind", F.lead("par").over(place) - F.col("par"))
        ends = ends.where(f"coalesce(gap_before, {2 * PIECE + 1}) > {2 * PIECE} OR coalesce(gap_behind, {2 * PIECE + 1}) > {2 * PIECE}")
        # the first of a batch may have its first copy elsewhere
        up = found.where((F.col("kind") == COPY) & (F.col("par_a") % 2 == 1)).select(F.col("key_a").alias("key_b"), F.col("par_a").alias("par_b"), F.col("key_b").alias("key_c"), F.col("par_b").alias("par_c"))
        ends = ends.join(up, ["key_b", "par_b"], "left").select("key", "par", F.coalesce("key_c", "key_b").alias("key_b"), F.coalesce("par_c", "par_b").alias("par_b"))
        ends = materialize(ends, "par-ends")
        requests = requests.union(ends.select(F.col("key_b").alias("key"), null, F.col("par_b")).distinct())
    by_text = requests.groupBy("key").agg(F.collect_list("wanted").alias("wanted"), F.collect_list("around").alias("around"))
    looked_up = thin.join(by_text, "key").mapInArrow(_looked_up(shingle, whole), "key long, par long, shingles binary, before binary, behind binary")
    looked_up = materialize(looked_up, "par-sets", release=True)
    sets = looked_up.where("shingles IS NOT NULL").select("key", "par", "shingles")
    side = lambda x: sets.select(F.col("key").alias(f"key_{x}"), F.col("par").alias(f"par_{x}"), F.col("shingles").alias(f"set_{x}"))
    both = pairs.join(side("a"), ["key_a", "par_a"]).join(side("b"), ["key_b", "par_b"]).select(*_ENDS, "set_a", "set_b")
    links = both.mapInArrow(_verified(threshold), "key_a long, par_a long, key_b long, par_b long")
    tiles = large.groupBy("bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = (
        large.join(tiles, "bucket").join(sets, ["key", "par"])
        .withColumn("tile", F.pmod(F.xxhash64("key", "par"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("bucket", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"), "key", "par", "shingles")
    )
    forest = dealt.groupBy("bucket", "tile_a", "tile_b").applyInArrow(_tile_links(threshold), "key_a long, par_a long, key_b long, par_b long")
    edges = links.union(forest).select(F.struct(F.col("key_a").alias("key"), F.col("par_a").alias("par")).alias("src"), F.struct(F.col("key_b").alias("key"), F.col("par_b").alias("par")).alias("dst"))
    comps = connected_components(edges).select("node.key", "node.par", F.col("component.key").alias("first_key"), F.col("component.par").alias("first_par"))
    gone = copies.select(F.col("key_a").alias("key"), F.col("par_a").alias("par"), F.col("key_b").alias("first_key"))
    gone = gone.union(comps.where("key <> first_key OR par <> first_par").select("key", "par", "first_key"))
    if whole:
        return gone, None, [found, pairs, looked_up]
    around = looked_up.where("before IS NOT NULL").select(F.col("key").alias("key_b"), F.col("par").alias("par_b"), "before", "behind")
    return gone, ends.join(around, ["key_b", "par_b"]).select("key", F.expr("par div 2").alias("start"), "before", "behind"), [found, pairs, looked_up, ends]


_WORD = re.compile(r"\S+")


def gone_words(words: list[str], starts: list[int], ends: list[tuple[int, bytes, bytes]]) -> np.ndarray:
    """Whether each word lies in a piece that repeats, or goes on like its first copy right before or behind it."""
    gone = np.zeros(len(words), bool)
    for start in starts:
        gone[start : start + PIECE] = True
    for start, *sides in ends:
        for own, first, step in zip(_around(words, start), sides, (-1, 1)):
            first = np.frombuffer(first, np.uint32)
            n = min(len(own), len(first))
            unlike = np.flatnonzero(own[:n] != first[:n])
            n = int(unlike[0]) if len(unlike) else n
            gone[start - n if step < 0 else start + PIECE : start if step < 0 else start + PIECE + n] = True
    return gone


def cut_text(text: str, lines_gone: set[int], starts: list[int], ends: list[tuple[int, bytes, bytes]]) -> tuple[str, int]:
    """The text without those lines and without the pieces from those words on, and how many passages went.

    A line that loses all its words goes; within a line, what follows the passage moves up to its start.
    """
    lines = paragraphs(text)
    gone = gone_words(text.lower().split(), starts, ends) if starts else None
    kept, passages, word, open_ = [], 0, 0, False
    for n, line in enumerate(lines):
        if gone is None:
            if n not in lines_gone:
                kept.append(line)
            continue
        own = gone[word : (word := word + len(line.split()))]
        if n in lines_gone or not own.any():
            open_ = False
            if n not in lines_gone:
                kept.append(line)
            continue
        spans = [m.span() for m in _WORD.finditer(line)]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
        out, at = [], 0
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            passages += not (open_ and a == 0)
            out.append(line[at : spans[a][0]] if b < len(spans) or not a else line[at : spans[a - 1][1]])
            at = spans[b][0] if b < len(spans) else len(line)
        open_ = bool(own[-1])
        if not own.all():
            kept.append("".join(out) + line[at:])
    return "\n".join(kept), passages


def _cuts(gone: DataFrame, ends: DataFrame) -> DataFrame:
    """(_key, lines, pieces, ends) to cut per text, and the texts (firsts) that hold the like earlier."""
    null = F.lit(None)
    rows = gone.select("key", "first_key", F.when(F.col("par") % 2 == 0, F.expr("par div 2")).alias("line"), F.when(F.col("par") % 2 == 1, F.expr("par div 2")).alias("piece"), null.cast("struct<start:bigint,before:binary,behind:binary>").alias("end"))
    rows = rows.union(ends.select("key", null.cast("long"), null.cast("long"), null.cast("long"), F.struct("start", "before", "behind")))
    return rows.groupBy(F.col("key").alias("_key")).agg(
        F.collect_list("line").alias("_lines"), F.collect_list("piece").alias("_pieces"), F.collect_list("end").alias("_ends"), F.sort_array(F.collect_set("first_key")).alias("_firsts")
    )


def _cut(text: str | None, lines: list[int] | None, pieces: list[int], ends: list[dict]) -> tuple[str | None, int]:
    if not lines and not pieces:
        return text, 0
    return cut_text(text, set(lines), pieces, [(e["start"], e["before"], e["behind"]) for e in ends])


def remove_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``(doc_id, n_paragraphs, n_removed, n_passages, chars_removed, first_docs, kept_text)``.

    Lines and pieces that have an equal or near copy (Jaccard of five-word shingles) earlier, by doc_id and place, are taken
    out of the text; of each group the first stays. So of each passage of 2 * PIECE - 1 words (51) or more that is there earlier
    some piece goes, and with it, up to its ends, the passage (n_passages). first_docs: ids of documents that hold the text
    removed earlier on. Lines of under ``min_words`` words go only as part of a piece; null and empty texts stay as they are. A
    null id comes first; rows that repeat id and text are one document, and each is returned. An empty table gives no rows.
    """
    keyed = keyed_documents(docs.select("doc_id", "text"))
    gone, ends, written = paragraph_groups(keyed, threshold, min_words=min_words)
    by_text = materialize(_cuts(gone, ends).withColumnRenamed("_firsts", "first_docs"), "par-cuts", release=True)
    discard(*written)
    if not getattr(keyed, "_by_id", False):  # keys are ranks: back to ids
        ids = keyed.select(F.col("_key").alias("first_key"), F.col("doc_id").alias("first_doc")).distinct()
        first = by_text.select("_key", F.explode("first_docs").alias("first_key")).join(ids, "first_key")
        first = first.groupBy("_key").agg(F.sort_array(F.collect_set("first_doc")).alias("first_docs"))
        by_text = by_text.drop("first_docs").join(first, "_key", "left")
    joined = keyed.join(by_text, "_key", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "first_docs", "text", "_lines", "_pieces", "_ends")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            out: list[list] = [[], [], [], [], []]
            for text, lines, pieces, ends in zip(batch.column(2), *(batch.column(k).to_pylist() for k in (3, 4, 5))):
                text = text.as_py()
                kept, passages = _cut(text, lines, pieces, ends)
                counted = sum(len(x) >= 2 * min_words - 1 and len(x.split()) >= min_words for x in paragraphs(text))
                for column, x in zip(out, (counted, len(set(lines or ())), passages, len(text or "") - len(kept or ""), kept)):
                    column.append(x)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(out, kinds))], names=["doc_id", "first_docs", "n_paragraphs", "n_removed", "n_passages", "chars_removed", "kept_text"])

    out = joined.mapInArrow(cut, "doc_id long, first_docs array<bigint>, n_paragraphs int, n_removed int, n_passages int, chars_removed long, kept_text string")
    return out.select("doc_id", "n_paragraphs", "n_removed", "n_passages", "chars_removed", "first_docs", "kept_text")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_paragraphs(table(spark, sf_dir, "documents"))


def without_repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts lose their repeated paragraphs and passages, ``n_chars`` follows where it is there; all rows stay."""
    bound_batches(spark)
    keyed = keyed_documents(docs)
    gone, ends, written = paragraph_groups(keyed.select("_key", "text"))
    cuts = materialize(_cuts(gone, ends).drop("_firsts"), "par-cuts", release=True)
    discard(*written)
    joined = keyed.join(cuts, "_key", "left").select(*docs.columns, "_lines", "_pieces", "_ends")
    at = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            todo = [batch.column(k).to_pylist() for k in range(batch.num_columns - 3, batch.num_columns)]
            texts = [_cut(t.as_py(), *x)[0] for t, *x in zip(batch.column(at), *todo)]
            touched = [bool(a or b) for a, b in zip(*todo[:2])]
            columns = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 : -3], pa.array(touched, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*docs_names, "_touched"])

    docs_names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "_touched boolean"])
    out = joined.mapInArrow(cut, schema)
    if "n_chars" in docs_names:
        out = out.withColumn("n_chars", F.when(F.col("_touched"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs_names)
