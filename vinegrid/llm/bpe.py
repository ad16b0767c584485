"""Byte-level BPE as a transducer with bounded lookahead, and the decoder back to text.

A merge list applies its rules in order of rank, each from left to right. Text that is added on the right changes what lies
left of it only through a chain of rules of rising rank: each one joins a token that ends where the change begins with one that
starts there, and so moves the change to the left by the first one's length. The longest chain that the list allows is its
lookahead: with that many bytes read beyond a boundary, the boundary and all tokens before it are final and can leave.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinegrid.llm.common import sliced, table
from vinegrid.llm.packing import _byte_letters, tokenizer_file

MODEL = "byte_bpe_50k.json"
#: Characters that are cut into pre-tokens at a time, and entries of one generation of a worker's table of encoded pre-tokens.
WINDOW = 1 << 16
CACHE = 250_000
#: A pre-token's end can depend on this many characters after it (contractions, the last space of several).
AFTER = 3
#: The pre-tokenizer's pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class MergeList:
    """Rules (left id, right id, new id) in order of rank over symbols of known byte lengths.

    The list must be proper, as trained ones are: a rule's parts are made by earlier rules or are symbols themselves.
    """

    def __init__(self, rules: list[tuple[int, int, int]], lengths: dict[int, int]):
        self.lengths = dict(lengths)
        made: dict[int, list[int]] = {}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (x, y, new) in enumerate(rules):
            if x not in self.lengths or y not in self.lengths:
                raise ValueError(f"rule {r} joins a token that no earlier rule makes")
            self.lengths.setdefault(new, self.lengths[x] + self.lengths[y])
            self.rank.setdefault((x, y), (r, new))
            made.setdefault(new, []).append(x)
        self.longest = max(self.lengths.values())
        self.lookahead = self._lookahead(rules, made)

    def _lookahead(self, rules: list[tuple[int, int, int]], made: dict[int, list[int]]) -> int:
        """Bytes that the longest chain of rules moves a change to the left.

        ``reach[t]`` is the longest chain, of the rules seen so far, that can go on once the change begins with token ``t``: its
        first rule has a right part that begins with ``t``. Rules are seen from the last to the first, as ranks rise in a chain.
        """
        reach: dict[int, int] = {}
        longest = 0
        for x, y, _ in reversed(rules):
            far = self.lengths[x] + reach.get(x, 0)
            longest = max(longest, far)
            todo, seen = [y], set()
            while todo:
                t = todo.pop()
                if t not in seen:
                    seen.add(t)
                    reach[t] = max(reach.get(t, 0), far)
                    todo.extend(made.get(t, ()))
        return longest

    def merged(self, symbols: list[int]) -> list[int]:
        """Tokens of a run of symbols: the lowest rank first, from left to right."""
        sym, n, rank = list(symbols), len(symbols), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*found, k, pair) for k, pair in enumerate(zip(sym, sym[1:])) if (found := rank.get(pair))]
        heap = [(r, k, new, pair) for r, new, k, pair in heap]
        heapify(heap)
        while heap:
            _, k, new, pair = heappop(heap)
            m = after[k]
            if m >= n or sym[k] != pair[0] or sym[m] != pair[1]:
                continue
            sym[k], sym[m] = new, -1
            after[k] = o = after[m]
            if o < n:
                before[o] = k
                if found := rank.get((new, sym[o])):
                    heappush(heap, (found[0], k, found[1], (new, sym[o])))
            p = before[k]
            if p >= 0 and (found := rank.get((sym[p], new))):
                heappush(heap, (found[0], p, found[1], (sym[p], new)))
        return [s for s in sym if s >= 0]


class Transducer:
    """Symbols in, final tokens out: holds the symbols since the last token that left, at most lookahead and longest token twice."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.held: list[int] = []
        self.step = merges.lookahead + merges.longest

    def feed(self, symbols) -> Iterator[list[int]]:
        """Add one-byte symbols; yields lists of tokens that no later symbol can change."""
        at = 0
        while at < len(symbols):
            more = symbols[at : at + 2 * self.step - len(self.held)]
            at += len(more)
            self.held.extend(more)
            if len(self.held) >= 2 * self.step:
                yield self._stable()

    def _stable(self) -> list[int]:
        """Tokens that end a lookahead or more before what is held; there is one, as no token is longer than the longest."""
        lengths, final = self.merges.lengths, len(self.held) - self.merges.lookahead
        out, end = [], 0
        for token in self.merges.merged(self.held):
            if end + lengths[token] > final:
                break
            end += lengths[token]
            out.append(token)
        del self.held[:end]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.merges.merged(self.held), []
        return out


class ByteBpe(dict):
    """A byte-level BPE tokenizer file as a stream transducer; as a dict, pre-token -> its ids as little-endian unsigned 32-bit bytes.

    Equal pre-tokens are encoded once per generation of the table; those that are longer than the transducer's buffer are fed
    to it in parts and never kept.
    """

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        whole = Tokenizer.from_file(file)
        own = json.loads(whole.to_str())
        pre, model = own["pre_tokenizer"] or {}, own["model"]
        plain = own["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        bare = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or not bare or model["type"] != "BPE" or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in own["added_tokens"]):
            raise ValueError(f"{file} is not a plain byte-level BPE tokenizer")
        letters, vocab = _byte_letters(), model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.symbol = [vocab[letters[b]] for b in range(256)]
        self.merges = MergeList([(vocab[x], vocab[y], vocab[x + y]) for x, y in pairs], {s: 1 for s in self.symbol})
        self.probe, self.classes = whole.pre_tokenizer, {}
        byte_of = {c: b for b, c in letters.items()}
        spelled = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in own["added_tokens"]}
        spelled |= {i: t.encode() for t, i in self.added.items()}
        self.spelled = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.pattern = regex.compile(PATTERN)
        self.old: dict[str, bytes] = {}

    def __missing__(self, pre_token: str) -> bytes:
        found = self.old.pop(pre_token, None)
        if found is None:
            found = np.array(self.merges.merged([self.symbol[b] for b in pre_token.encode()]), "<u4").tobytes()
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[pre_token] = found
        return found

    def _classed(self, window: str) -> str:
        """The window with a mark in place of each character that this Unicode version calls a letter, digit or space and the library's doesn't."""
        if window.isascii():
            return window
        for ch in set(window) - self.classes.keys():
            text = f"a{ch}1{ch}!{ch}{ch}b"
            same = [span for _, span in self.probe.pre_tokenize_str(text)] == [m.span() for m in self.pattern.finditer(text)]
            self.classes[ch] = ch if same else "!"
        odd = {ord(ch): to for ch in set(window) if (to := self.classes[ch]) != ch}
        return window.translate(odd) if odd else window

    def _plain(self, text: str) -> Iterator[bytes]:
        """Ids of text without special tokens, a window's at a time."""
        at, width, n = 0, WINDOW, len(text)
        while at < n:
            window = text[at : at + width]
            last = at + width >= n
            marked = self._classed(window)
            found = self.pattern.findall(marked)
            final = len(window) if last else len(window) - AFTER
            end = len(window)
            while not last and found and end > final:
                end -= len(found.pop())
            if not found:  # one pre-token fills the window: look at a longer one
                width *= 2
                continue
            if marked is not window:
                ends = np.cumsum([0, *map(len, found)]).tolist()
                found = [window[a:b] for a, b in zip(ends, ends[1:])]
            width = WINDOW
            long = 2 * self.merges.longest + 2 * self.merges.lookahead
            if max(map(len, found)) <= long:
                yield b"".join([self[x] for x in found])
            else:
                for x in found:
                    yield from self._long(x) if len(x) > long else [self[x]]
            at += end

    def _long(self, pre_token: str) -> Iterator[bytes]:
        stream = Transducer(self.merges)
        for low in range(0, len(pre_token), WINDOW):
            for tokens in stream.feed([self.symbol[b] for b in pre_token[low : low + WINDOW].encode()]):
                yield np.array(tokens, "<u4").tobytes()
        yield np.array(stream.finish(), "<u4").tobytes()

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a text in parts, as they become final; the strings of special tokens become their ids."""
        at = 0
        for m in self.specials.finditer(text) if self.specials else ():
            yield from self._plain(text[at : m.start()])
            yield np.array([self.added[m[0]]], "<u4").tobytes()
            at = m.end()
        yield from self._plain(text[at:] if at else text)

    def decoder(self) -> "ByteDecoder":
        return ByteDecoder(self.spelled)


class ByteDecoder:
    """Ids in, text out: a character leaves when its last byte is there; bytes that are no UTF-8 become U+FFFD, as ids that don't exist give nothing."""

    def __init__(self, spelled: list[bytes]):
        self.spelled = spelled
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        spelled = self.spelled
        return self.state.decode(b"".join([spelled[i] if i < len(spelled) else b"" for i in np.frombuffer(ids, "<u4").tolist()]))

    def finish(self) -> str:
        return self.state.decode(b"", True)


_LOADED: dict[str, ByteBpe] = {}


def tokenizer(file: str) -> ByteBpe:
    """One for each Python worker."""
    if file not in _LOADED:
        _LOADED[file] = ByteBpe(file)
    return _LOADED[file]


def encode_texts(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row's whole text, one map over the rows without a shuffle.

    A null text is empty, an empty one has no ids. Null and repeated doc_ids and repeated rows each give their own row. Other
    columns are not looked at, so their names can't clash. An empty table gives no rows.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_file(model))
        for batch in sliced(batches, 200):
            ids = [np.frombuffer(b"".join(bpe.encode(text.as_py() or "")), "<u4").astype(np.int32) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encoded, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of each row's ids; null ids, and nulls among them, count as none."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_file(model))
        for batch in sliced(batches, 200):
            texts = []
            for ids in batch.column(1):
                state = bpe.decoder()
                texts.append(state.feed(np.array([i for i in ids.as_py() or () if i is not None], "<u4").tobytes()) + state.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(decoded, "doc_id long, text string")


def round_trips(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text is encoded and its ids decoded part by part, none is held as a whole.

    Rows as for ``encode_texts``; an empty text has no tokens and the digests of nothing.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_file(model))
        for batch in sliced(batches, 1000):
            counts, ids_hex, text_hex = [], [], []
            for text in batch.column(1):
                n, ids, back, state = 0, hashlib.sha256(), hashlib.sha256(), bpe.decoder()
                for part in bpe.encode(text.as_py() or ""):
                    n += len(part) // 4
                    ids.update(part)
                    back.update(state.feed(part).encode())
                back.update(state.finish().encode())
                counts.append(n), ids_hex.append(ids.hexdigest()), text_hex.append(back.hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return thin.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"))
