"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k over the lattice."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from math import exp, expm1, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinegrid.llm.common import table
from vinegrid.llm.packing import tokenizer_file

MODEL = "piece_bpe_32k.model"
SAMPLES = 3
#: Inverse temperature of the segmentation's weights.
SHARPNESS = 1.0
SEED = 23
#: Characters whose lattices are built at once (a longer text is a batch of its own).
CHARS = 1 << 20
#: Places of a path that are looked at first for the next samples, and places of all texts that are looked at together.
HEAD = 512
BLOCK = 1 << 18

SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1
_EMPTY = np.zeros(0)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(seed: np.ndarray, a, b, c) -> np.ndarray:
    """Numbers between 0 and 1 that depend on the row's seed and three counters alone, not on the batch."""
    with np.errstate(over="ignore"):
        apart = np.asarray(a, np.uint64) * _BASE + np.asarray(c, np.uint64) * np.uint64(0x165667B19E3779F9)
        x = _mixed(seed + apart + np.asarray(b, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


class _Places:
    """Strings by hash: a piece's id (-1: no piece), and whether longer pieces start like it.

    Each string stands in one of two places of a table; those that find both taken, few, are looked for in order.
    """

    def __init__(self, found: dict[int, int], more: set[int]):
        hashes = sorted(found.keys() | more)
        self.bits = max(8, (4 * len(hashes)).bit_length())
        slots: dict[int, int] = {}
        late = []
        for h in hashes:
            one, two = h >> (64 - self.bits), (h & 0xFFFFFFFF) >> (32 - self.bits)
            slot = one if one not in slots else two
            if slot in slots:
                late.append(h)
            else:
                slots[slot] = h
        # a zero in an empty place is no string's hash
        size = 1 << self.bits
        self.hash = np.zeros(size, np.uint64)
        self.ids = np.full(size + len(late) + 1, -1, np.int32)
        self.longer = np.zeros(size + len(late) + 1, bool)
        self.late = np.array(late, np.uint64)
        for slot, h in [*slots.items(), *((size + n, h) for n, h in enumerate(late))]:
            if slot < size:
                self.hash[slot] = h
            self.ids[slot], self.longer[slot] = found.get(h, -1), h in more

    def find(self, sums: np.ndarray) -> np.ndarray:
        """Places in ids and longer; the last one, of no string, for what is not there."""
        place = (sums >> np.uint64(64 - self.bits)).astype(np.int32)
        lost = np.flatnonzero(self.hash[place] != sums)
        rest = sums[lost]
        two = ((rest & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - self.bits)).astype(np.int32)
        there = self.hash[two] == rest
        place[lost] = np.where(there, two, len(self.ids) - 1)
        if len(self.late):
            lost, rest = lost[~there], rest[~there]
            at = np.minimum(np.searchsorted(self.late, rest), len(self.late) - 1)
            there = self.late[at] == rest
            place[lost[there]] = len(self.hash) + at[there]
        return place


class Vocabulary:
    """Pieces of a model by length, as hashes; weights fall with the piece's rank: log weight = -log(1 - score)."""

    def __init__(self, file: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=file)
        p, n = self.processor, self.processor.get_piece_size()
        plain = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        pieces = {i: p.id_to_piece(i) for i in plain}
        if any(SPACE in x.lstrip(SPACE) for x in pieces.values()):
            raise ValueError("the lattice falls apart at white space only if no piece has it behind other letters")
        self.weight = np.array([-np.log1p(max(-p.get_score(i), 0.0)) for i in range(n)])
        self.byte_weight = -np.log1p(float(n))
        self.byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = [bytes([self.byte_ids.index(i)]) if p.is_byte(i) else pieces[i].encode() if i in pieces else b"" for i in range(n)]
        self.weight[self.byte_ids] = self.byte_weight
        self.size = np.array([len(x) for x in self.bytes], np.int32)
        self.place = np.cumsum(self.size, dtype=np.int32) - self.size
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.range = np.arange(1 << 14, dtype=np.int32)
        self.longest = max(map(len, pieces.values()))
        # a line feed that no piece holds is an edge of its own, so the lattice falls apart there, too
        self.feeds_apart = not any("\n" in x for x in pieces.values())
        self.cut = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if self.feeds_apart else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.power = np.cumprod(np.full(1 << 10, _BASE, np.uint64))
        by_length: dict[int, dict[int, int]] = {}
        prefixes: dict[int, set[int]] = {}
        for i, piece in pieces.items():
            codes = np.frombuffer(piece.encode("utf-32-le"), np.uint32).astype(np.uint64)
            sums = np.cumsum(_mixed(codes) * self.power[: len(codes)])
            by_length.setdefault(len(codes), {})[int(sums[-1])] = i
            for k in range(1, len(codes)):
                prefixes.setdefault(k, set()).add(int(sums[k - 1]))
        #: by length: pieces and longer pieces' starts
        self.starts = {k: _Places(by_length.get(k, {}), prefixes.get(k, set())) for k in range(1, self.longest + 1)}

    def normalized(self, text: str) -> str:
        return self.processor.normalize(text) if text else ""

    def chunks(self, text: str) -> list[str]:
        """The normalised text cut where its lattice falls apart."""
        normal = self.normalized(text)
        if SPACE * 2 in normal or " " in normal or not self.feeds_apart:
            return self.cut(normal)
        # the same, faster: no white space in a row
        return [x for x in normal.replace(SPACE, f" {SPACE}").replace("\n", " \n ").split(" ") if x]

    def spell(self, ids: np.ndarray, text: str, wanted: bytes) -> bool:
        """Whether the pieces decode to the text; wanted: the text's bytes as the pieces write them."""
        return (self.written(ids) == wanted and SPACE not in text) or self.decode(ids) == text

    def written(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        stop = np.cumsum(size, dtype=np.int32)
        at = np.repeat(self.place[ids] - (stop - size), size)
        if len(at) > len(self.range):
            self.range = np.arange(2 * len(at), dtype=np.int32)
        at += self.range[: len(at)]
        return self.flat[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        raw = self.written(ids).decode("utf-8", "replace")
        return raw.replace(SPACE, " ")[1:] if raw.startswith(SPACE) else raw.replace(SPACE, " ")


@cache
def vocabulary(file: str) -> Vocabulary:
    """One for each Python worker."""
    return Vocabulary(file)


class _Numbers(dict):
    """Numbers of strings, in the order in which they come."""

    def __missing__(self, name: str) -> int:
        self[name] = n = len(self)
        return n


class Lattice:
    """Edges of the lattices of distinct chunks, laid end to end, and the exact log sums from each place to its chunk's end."""

    def __init__(self, chunks: list[str], vocab: Vocabulary, sharpness: float):
        joined = "".join(chunks)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        self.root = np.cumsum(sizes) - sizes
        n = len(codes)
        left = np.repeat(self.root + sizes, sizes) - np.arange(n)
        mixed = _mixed(codes.astype(np.uint64))
        source, length, piece = [], [], []
        at = np.arange(n)
        sums = np.zeros(n, np.uint64)
        for k in range(1, vocab.longest + 1):
            sums = sums + mixed[at + k - 1] * vocab.power[k - 1]
            known = vocab.starts[k]
            where = known.find(sums)
            own = known.ids[where]
            hit = own >= 0
            if hit.any():
                source.append(at[hit]), length.append(np.full(int(hit.sum()), k)), piece.append(own[hit])
            if k == 1 and not hit.all():  # characters that are no piece: their bytes, as one edge
                lone = at[~hit]
                code = codes[lone].astype(np.int64)
                source.append(lone), length.append(np.ones(len(lone), np.int64))
                piece.append(np.where(code < 128, np.array(vocab.byte_ids)[np.minimum(code, 127)], -1 - code))
            more = known.longer[where] & (left[at] > k)
            at, sums = at[more], sums[more]
            if not len(at):
                break
        source, length, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (source, length, piece))
        # by what is left of the chunk, then by place: a merge of sorted runs, then a radix sort where 16 bits do
        order = np.argsort(source, kind="stable")
        rest = left[source[order]]
        order = order[np.argsort(rest.astype(np.uint16) if int(left.max(initial=0)) < 1 << 16 else rest, kind="stable")]
        source, length, self.piece = source[order], length[order], piece[order]
        weight = np.empty(len(source))
        known = self.piece >= 0
        weight[known] = vocab.weight[self.piece[known]]
        alien = -1 - self.piece[~known]
        weight[~known] = vocab.byte_weight * (2 + (alien > 0x7FF) + (alien > 0xFFFF))
        weight *= sharpness
        # from the ends of the chunks to their starts, all chunks at once
        total = np.zeros(n + 1)
        ends = length == left[source]
        steps = np.searchsorted(left[source], np.arange(1, int(left.max(initial=0)) + 2))
        first = np.ones(len(source), bool)
        first[1:] = source[1:] != source[:-1]
        value = weight
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
            if a == b:
                continue
            own = weight[a:b] + np.where(ends[a:b], 0.0, total[np.minimum(source[a:b] + length[a:b], n)])
            cut = np.flatnonzero(first[a:b])
            top = np.maximum.reduceat(own, cut)
            sums_ = np.add.reduceat(np.exp(own - np.repeat(top, np.diff(np.append(cut, b - a)))), cut)
            total[source[a:b][cut]] = top + np.log(sums_)
            value[a:b] = own
        #: log probability of each edge at its place, the place that it leads to (-1: the chunk's end)
        self.log_p = value - total[source]
        self.target = np.where(ends, -1, source + length).astype(np.int32)
        start = np.flatnonzero(first)
        self.first = np.zeros(n, np.int32)
        self.count = np.zeros(n, np.int32)
        self.first[source[start]] = start
        self.count[source[start]] = np.diff(np.append(start, len(source)))
        self.source = source.astype(np.int32)
        self.piece = self.piece.astype(np.int32)
        self.aliens = not bool(known.all())
        #: probability of the edges of a place up to this one, 1 for the last
        running = np.cumsum(np.exp(self.log_p))
        rank = np.cumsum(first) - 1
        self.up_to = running - np.concatenate([[0.0], running])[start][rank]
        self.up_to[np.append(start[1:], len(source)) - 1 if len(start) else start] = 1.0

    def log_rest(self, edges: np.ndarray) -> np.ndarray:
        """Log of 1 - p, exactly nothing where there is one edge only."""
        rest = np.log(np.maximum(-np.expm1(self.log_p[edges]), 1e-300))
        return np.where(self.count[self.source[edges]] > 1, rest, -np.inf)

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each place, by its probability."""
        edge = self.first[node]
        on = np.flatnonzero(self.up_to[edge] < u)
        while len(on):
            edge[on] += 1
            on = on[self.up_to[edge[on]] < u[on]]
        return edge

    def walk(self, node: np.ndarray, seed: np.ndarray, step: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled edges from each place to its chunk's end, in the order of the places, and how many for each."""
        live, at = None, node
        found, owners = [], []
        with np.errstate(over="ignore"):
            own = seed + number.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(step << 24) * _BASE
        counts = np.zeros(len(node), np.int64)
        turn = 0
        while len(at):
            edge = self.pick(at, _uniform(own if live is None else own[live], turn, 0, 0))
            found.append(edge), owners.append(live)
            at = self.target[edge]
            go = np.flatnonzero(at >= 0)
            counts[slice(None) if live is None else live] += 1
            live, at = go if live is None else live[go], at[go]
            turn += 1
        out = np.empty(int(counts.sum()), np.int32)
        place = np.cumsum(counts) - counts
        for turn, (edge, owner) in enumerate(zip(found, owners)):
            out[(place if owner is None else place[owner]) + turn] = edge
        return out, counts


#: No Gumbel value made from a number of _uniform is larger.
_HIGHEST = 36.8


def _truncated_gumbel(location: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The largest Gumbel value of a set with that log mass, given that it is below ``top``."""
    return -np.logaddexp(-top, np.log(-np.log(u)) - location)


def _one_uniform(seed: int, a: int, b: int, c: int) -> float:
    """``_uniform`` for a single number."""
    x = (seed + a * int(_BASE) + c * 0x165667B19E3779F9 + b * 0xC2B2AE3D27D4EB4F) & _ALL
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
    return (((x ^ (x >> 31)) >> 12) + 0.5) / float(1 << 52)


class _Text:
    """Search state of one text: sampled paths, and for each new place of a path the best Gumbel value among its siblings."""

    def __init__(self, key, text: str, chunks: np.ndarray, seed: int):
        self.key, self.text, self.chunks, self.seed = key, text, chunks, seed
        self.edges: list[np.ndarray] = []
        self.keep: list[int] = []  # places that a path shares with the one it left; the following lists start behind them
        self.of_chunk: list[np.ndarray] = []
        self.before: list[np.ndarray] = []  # log probability of what stands before
        self.best: list[np.ndarray] = []
        self.value: list[float] = []
        self.log_p: list[float] = []
        self.split: list[tuple[int, int, int]] = []  # path, place and edge where a path left another

    def leave(self, lattice: Lattice, step: int) -> tuple[int, int, int, int, float] | None:
        """The best open node, as (path, place, edge, chunk, log probability up to the edge); its remaining siblings wait on."""
        top, path = max((float(b.max(initial=-np.inf)), p) for p, b in enumerate(self.best))
        if top == -np.inf:
            return None
        at = int(self.best[path].argmax())
        place, before = self.keep[path] + at, float(self.before[path][at])
        edge = int(self.edges[path][place])
        own = lattice.source[edge]
        taken = {edge} | {e for p, i, e in self.split if (p, i) == (path, place)}
        first = int(lattice.first[own])
        free = [(first + n, lp) for n, lp in enumerate(lattice.log_p[first : first + int(lattice.count[own])].tolist()) if first + n not in taken]
        mass = [exp(lp) for _, lp in free]
        goal = _one_uniform(self.seed, step, place, 1 << 21) * sum(mass)
        j, reached = 0, mass[0]
        while reached < goal and j < len(free) - 1:
            j += 1
            reached += mass[j]
        rest = sum(m for n, m in enumerate(mass) if n != j)
        if rest > 0:
            u = _one_uniform(self.seed, step, place, 1 << 22)
            self.best[path][at] = _truncated_gumbel(before + log(rest), top, u)
        else:
            self.best[path][at] = -np.inf
        self.split.append((path, place, free[j][0]))
        self.value.append(top)
        return path, place, free[j][0], int(self.of_chunk[path][at]), before + free[j][1]


def _waiting(lattice: Lattice, edges: np.ndarray, low: np.ndarray, n: np.ndarray, base: np.ndarray, place: np.ndarray, seeds: np.ndarray, top: np.ndarray, step: int, k: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Best Gumbel values of the siblings of sampled edges, text by text.

    Text t's new edges are edges[low[t] : low[t] + n[t]], its first is at place[t] of the path, base[t] the log probability of
    what stands before. Returns for each text the values and what stands before its places, and the whole path's log probability.

    A Gumbel value lies at most _HIGHEST over its place's log mass, so places far down can't be among the next k: the first
    HEAD places are looked at, and twice as many as long as that is not proved. Texts of like length go together as rows of
    one table, each summed on its own, so that the values don't depend on the batch.
    """
    values: list[np.ndarray] = [_EMPTY] * len(n)
    sums: list[np.ndarray] = [_EMPTY] * len(n)
    log_p = lattice.log_p[edges]
    total = base + np.add.reduceat(np.append(log_p, 0.0), np.minimum(low, len(log_p))) * (n > 0)
    todo, head = np.argsort(n, kind="stable"), HEAD
    while len(todo):
        again = []
        while len(todo):
            width = max(1, min(head, int(n[todo[-1]])))
            rows, todo = np.sort(todo[-max(1, BLOCK // width) :]), todo[: -max(1, BLOCK // width)]
            at = np.arange(width)
            there = at < n[rows][:, None]
            where = np.minimum(low[rows][:, None] + at, max(len(edges) - 1, 0))
            chain = np.zeros((len(rows), width + 1))
            chain[:, 0] = base[rows]
            if len(edges):
                chain[:, 1:] = np.where(there, log_p[where], 0.0)
            chain = np.cumsum(chain, axis=1)
            best = np.full((len(rows), width), -np.inf)
            i, j = np.nonzero(there & (chain[:, 1:] < chain[:, :-1]))
            location = chain[i, j] + lattice.log_rest(edges[where[i, j]])
            best[i, j] = _truncated_gumbel(location, top[rows][i], _uniform(seeds[rows][i], step, place[rows][i] + j, 1 << 23))
            lead = np.partition(best, width - k - 1, axis=1)[:, width - k - 1] if width > k else np.full(len(rows), -np.inf)
            done = (n[rows] <= width) | (chain[:, -1] + _HIGHEST < lead)
            for r, row in enumerate(rows.tolist()):
                values[row], sums[row] = best[r], chain[r]
            again.append(rows[~done])
        todo, head = np.concatenate(again), 2 * head
        todo = todo[np.argsort(n[todo], kind="stable")]
    return values, sums, total


def sample_batch(items: list[tuple[object, str, int]], vocab: Vocabulary, k: int, sharpness: float):
    """Samples of texts ``(key, text, seed)``: yields (key, text, [(ids, log_p, value, log_inclusion)]).

    The lattice's exact sums are the search's bound, so the best open node always leads straight to the next sample: the whole
    text has Gumbel value G; a node's children share it as their maximum. Going down by the children's probabilities keeps the
    value; the best of the other children gets a Gumbel value of their mass, truncated at G, and waits. The next sample starts
    at the best that waits. Samples come in falling order, without repeats. The value next in line after k samples is the
    threshold t; a sample's inclusion score is the log of 1 - exp(-exp(log_p - t)), 0 if nothing is left.
    """
    names: dict[str, int] = _Numbers()
    texts = []
    for key, text, seed in items:
        found = vocab.chunks(text)
        texts.append(_Text(key, text, np.fromiter(map(names.__getitem__, found), np.int32, len(found)), seed & _ALL))
    lattice = Lattice(list(names), vocab, sharpness)
    none = np.zeros(0, np.int32)
    going = texts
    for step in range(k):
        nodes, sizes, begins, leads = [], [], [], []
        open_, going = going, []
        for x in open_:
            if step == 0:
                x.value.append(-log(-log(_one_uniform(x.seed, 1 << 20, 0, 0))))
                lead, first, begin = None, none, 0
            else:
                lead = x.leave(lattice, step)
                if lead is None:
                    continue
                target, begin = lattice.target[lead[2]], lead[3] + 1
                first = np.array([target]) if target >= 0 else none
            rest = lattice.root[x.chunks[begin:]]
            nodes += [first, rest]
            sizes.append(len(first) + len(rest))
            begins.append(begin - len(first))
            leads.append(lead)
            going.append(x)
        if not going:
            break
        size = np.array(sizes)
        seeds = np.array([x.seed for x in going], np.uint64)
        number = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - np.array(begins), size)
        edges, counts = lattice.walk(np.concatenate(nodes), np.repeat(seeds, size), step, number)
        chunk_of = np.repeat(number.astype(np.int32), counts)
        n = np.diff(np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(size)])])
        low = np.cumsum(n) - n
        base = np.array([0.0 if x is None else x[4] for x in leads])
        place = np.array([0 if x is None else x[1] + 1 for x in leads])
        values, sums, total = _waiting(lattice, edges, low, n, base, place, seeds, np.array([x.value[-1] for x in going]), step, k)
        for x, lead, a, b, value, before, log_p in zip(going, leads, low.tolist(), (low + n).tolist(), values, sums, total.tolist()):
            own = edges[a:b]
            if lead is not None:
                own = np.concatenate([x.edges[lead[0]][: lead[1]], np.array([lead[2]], np.int32), own])
            x.edges.append(own), x.keep.append(0 if lead is None else lead[1] + 1), x.of_chunk.append(chunk_of[a : a + len(value)])
            x.before.append(before), x.best.append(value), x.log_p.append(log_p)
    for x in texts:
        threshold = max((float(b.max(initial=-np.inf)) for b in x.best), default=-np.inf)
        out = []
        for edges, log_p, value in zip(x.edges, x.log_p, x.value):
            ids = lattice.piece[edges]
            if lattice.aliens and len(ids) and ids.min() < 0:
                parts = [[i] if i >= 0 else [vocab.byte_ids[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")] for i in ids.tolist()]
                ids = np.array([i for part in parts for i in part], np.int32)
            gap = log_p - threshold
            inclusion = 0.0 if threshold == -np.inf else gap if gap < -30 else log(-expm1(-exp(min(gap, 700.0))))
            out.append((ids, log_p, value, inclusion))
        yield x.key, x.text, out


def sample_segmentations(docs: DataFrame, k: int = SAMPLES, sharpness: float = SHARPNESS, seed: int = SEED, model: str = MODEL, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to ``k`` distinct sampled segmentations of each whole text; one scan, no shuffle.

    A segmentation's weight is the product of its pieces' weights, its probability that over the sum of all segmentations.
    Samples are drawn without replacement, seeded by the row's id and ``seed`` alone, so they don't depend on partitions. A
    null text counts as empty: one sample without pieces. Texts with fewer segmentations give fewer samples. Rows that repeat
    an id draw from the same numbers; null ids have a seed of their own.

    Returns ``(doc_id, sample, ids, n_pieces, ids_crc32, log_prob, perturbed, log_inclusion, round_trip)``; ids only if asked
    for, ids_crc32 over little-endian 32-bit ids, round_trip: the pieces decode to the text.
    """

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer_file(model))
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
        names = ["doc_id", "sample", "ids", "n_pieces", "ids_crc32", "log_prob", "perturbed", "log_inclusion", "round_trip"]

        def rows(items: list) -> pa.RecordBatch:
            out: list[list] = [[] for _ in names]
            for key, text, samples in sample_batch(items, vocab, k, sharpness):
                wanted = (SPACE + text.replace(" ", SPACE)).encode("utf-8", "surrogatepass")
                for n, (ids, log_p, value, inclusion) in enumerate(samples):
                    ids = ids.astype("<i4", copy=False)
                    for column, x in zip(out, (key, n, ids if keep_ids else None, len(ids), zlib.crc32(ids), log_p, value, inclusion, vocab.spell(ids, text, wanted))):
                        column.append(x)
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds)], names=names)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            seeds = _mixed(np.array([0x5EED if x is None else x & _ALL for x in keys], np.uint64) + np.uint64(seed * int(_BASE) & _ALL)) if keys else []
            items, size = [], 0
            for key, text, own in zip(keys, batch.column(1), seeds):
                text = text.as_py() or ""
                items.append((key, text, int(own)))
                size += len(text)
                if size >= CHARS:
                    yield rows(items)
                    items, size = [], 0
            if items:
                yield rows(items)

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return thin.mapInArrow(sampled, "doc_id long, sample int, ids array<int>, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, round_trip boolean")


def decode_pieces(encoded: DataFrame, model: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``, the text that the piece ids stand for; null ids give null."""
    out = encoded.drop("decoded")
    at = out.columns.index(ids_col)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer_file(model))
        for batch in batches:
            texts = [None if x is None else vocab.decode(np.array(x, np.int64)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields), "decoded string"])
    return out.mapInArrow(decoded, schema)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sample_segmentations(table(spark, sf_dir, "documents"), keep_ids=False)
    return found.select("doc_id", "sample", "n_pieces", "ids_crc32", F.round("log_prob", 6).alias("log_prob"), F.round("perturbed", 6).alias("perturbed"), F.round("log_inclusion", 6).alias("log_inclusion"), "round_trip")
