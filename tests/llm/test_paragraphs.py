"""Paragraph dedup against brute force."""

import os
import random
import re
import time

import numpy as np
import pytest

from vinegrid.llm import common
from vinegrid.llm import paragraphs as par


def shingles(line):
    w = line.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def picked(words, text):
    """Words that start a piece: those with the smallest hash, the first of equals, of some PIECE words in a row."""
    w = par.PIECE
    rank = [(int(h) * 0x9E3779B97F4A7C15 % (1 << 64)) >> 28 for h in par.word_hashes(text or "")]
    starts = {min(range(i, i + w), key=lambda p: (rank[p], p)) for i in range(len(words) - w + 1)}
    return sorted(p for p in starts if p + w <= len(words))


def brute(texts, min_words=par.MIN_WORDS):
    """Kept texts, and the lines and words that go, by all pairs of lines and of pieces."""
    w = par.PIECE
    items = []  # kind, text, place, words
    every = [(t or "").lower().split() for t in texts]
    for d, t in enumerate(texts):
        items += [("line", d, n, x.lower().split()) for n, x in enumerate((t or "").split("\n")) if len(x.split()) >= min_words]
        items += [("piece", d, p, every[d][p : p + w]) for p in picked(every[d], t)]
    sets = [shingles(" ".join(x[3])) for x in items]
    root = list(range(len(items)))
    find = lambda x: x if root[x] == x else find(root[x])
    meets, leads = {}, {}
    for k, x in enumerate(sets):  # equal ones are one class, named by its first place
        root[k] = leads.setdefault((items[k][0], tuple(items[k][3])), k)
        for s in x if root[k] == k else ():
            meets.setdefault((items[k][0], s), []).append(k)
    pairs = {(i, j) for g in meets.values() for n, j in enumerate(g) for i in g[:n]}
    for i, j in pairs:
        (kind, d, p, x), (_, e, q, y) = items[i], items[j]
        if kind == "piece" and d == e and abs(p - q) < w:
            continue
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            u, v = sorted((find(i), find(j)), key=lambda k: items[k][1:3])
            root[v] = u
    gone = {items[k][1:3] for k in range(len(items)) if items[k][0] == "line" and find(k) != k}
    cut = [set() for _ in texts]
    copy, seen = [{} for _ in texts], {}
    for k, (kind, d, p, x) in enumerate(items):
        if kind == "piece":
            if find(k) != k:
                cut[d].update(range(p, p + w))
            first = seen.setdefault(tuple(x), (d, p))
            if first != (d, p):
                copy[d][p] = first
    for d, own in enumerate(copy):  # pieces without another one right before or behind go on as far as they are like their first copy
        places = sorted(own)
        for n, p in enumerate(places):
            e, q = own[p]
            if n == 0 or places[n - 1] + w < p or n + 1 == len(places) or p + w < places[n + 1]:
                for step, at, goal in ((-1, p - 1, q - 1), (1, p + w, q + w)):
                    for _ in range(w - 1):
                        if not (0 <= at < len(every[d]) and 0 <= goal < len(every[e]) and every[d][at] == every[e][goal]):
                            break
                        cut[d].add(at)
                        at, goal = at + step, goal + step
    out = []
    for d, t in enumerate(texts):
        if t is None:
            out.append(None)
            continue
        kept, at = [], 0
        for n, line in enumerate(t.split("\n")):
            tokens = re.findall(r"\s*\S+", line)
            left = [k for k in range(len(tokens)) if at + k not in cut[d]]
            if (d, n) not in gone and (left or not tokens):
                kept.append(line if len(left) == len(tokens) else " ".join(tokens[k].strip() for k in left))
            at += len(tokens)
        out.append("\n".join(kept))
    return out, gone, cut


def corpus():
    rng = random.Random(5)
    words = lambda n: [rng.choice("alpha beta gamma delta omega kappa sigma theta iota mu nu xi pi rho tau".split()) + str(rng.randrange(30)) for _ in range(n)]
    shared = [words(60) for _ in range(4)]
    inner = words(91)
    texts = []
    for k in range(120):
        lines = [words(rng.randrange(3, 50)) for _ in range(3)]
        if k % 3 == 0:
            p = list(rng.choice(shared))
            for _ in range(rng.randrange(3)):
                p[rng.randrange(len(p))] = "changed" + str(rng.randrange(99))
            lines.insert(rng.randrange(3), p)
        if k % 7 == 1:  # a passage within a longer paragraph, over two lines at times
            at = rng.randrange(len(lines[0]))
            lines[0] = words(60) + lines[0][:at] + inner[: 51 + rng.randrange(40)] + lines[0][at:] + words(70)
        texts.append("\n".join(" ".join(x) for x in lines))
    return [*texts, None, "", "\n\n", texts[5], "  " + texts[7].upper().replace(" ", "  "), " ".join(words(20_000))]


@pytest.mark.parametrize(("paired", "tile"), [(16, 512), (2, 5)])
def test_remove_paragraphs(spark, monkeypatch, paired, tile):
    monkeypatch.setattr(par, "PAIRED", paired)
    monkeypatch.setattr(par, "TILE", tile)
    texts = corpus()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in par.remove_paragraphs(frame).collect()}
    want, gone, _ = brute(texts)
    assert [got[k].kept_text for k in range(len(texts))] == want
    assert sum(r.n_removed for r in got.values()) == len(gone)
    # every later document with the passage loses some of it
    assert all(got[k].n_passages >= 1 for k in range(8, 120, 7)) and got[1].n_passages == 0
    stage = par.without_repeated_paragraphs(spark, frame, "")
    assert stage.columns == frame.columns and {r.doc_id: r.text for r in stage.collect()} == dict(enumerate(want))


def test_odd_rows(spark):
    line = " ".join(f"w{k}" for k in range(60))
    rows = [(None, line, "x"), (1, line, "x"), (1, line, "x"), (1, line + " more", "x"), (2, None, None), (None, None, None)]
    got = sorted((r.doc_id or 0, r.n_removed, r.kept_text or "") for r in par.remove_paragraphs(spark.createDataFrame(rows, "doc_id long, text string, _gone string")).collect())
    assert got == [(0, 0, ""), (0, 0, line), (1, 1, ""), (1, 1, ""), (1, 1, ""), (2, 0, "")]
    assert par.remove_paragraphs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_reach_recall():
    r, b = par.tune_bands()
    assert 1 - (1 - par.THRESHOLD**r) ** b >= par.RECALL and r * b <= 36


def test_real_documents(spark, tiny):
    """All lines and pieces go as by brute force."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").toPandas().sort_values("doc_id")
    got = par.op5_substring_dedup(spark, tiny).toPandas().sort_values("doc_id")
    want, gone, _ = brute(docs.text.tolist())
    assert got.n_removed.sum() == len(gone)
    assert got.kept_text.tolist() == want


def repeated_words(texts, length=51):
    """Numbers of the words, text by text, that lie in a string of ``length`` words which starts earlier, too."""
    seen, out = set(), []
    for t in texts:
        words, cut = (t or "").lower().split(), set()
        for p in range(len(words) - length + 1):
            run = tuple(words[p : p + length])
            if run in seen:
                cut.update(range(p, p + length))
            seen.add(run)
        out.append(cut)
    return out


def test_whole_passages(spark):
    """All words of repeated strings of over 50 words go, wherever they start, and no word outside repeated runs."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    shared = [words(n) for n in (51, 60, 77, 120, 200)]
    texts = []
    for k in range(150):
        p = shared[k % 5]
        part = p if k > 9 else p[len(p) - 51 :] if k < 5 else p[:51]  # the first places hold only part of it
        line = words(rng.randrange(90, 150)) + part + words(rng.randrange(90, 150))
        at = rng.randrange(len(line))
        texts.append(" ".join(line) if k % 2 else " ".join(line[:at]) + "\n" + " ".join(line[at:]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in par.remove_paragraphs(frame).collect()}
    least, repeated, cut = repeated_words(texts), repeated_words(texts, par.PIECE), brute(texts)[2]
    assert sum(map(len, least)) > 12_000
    for k, t in enumerate(texts):
        # a passage goes on as far as it is like its first copy; a word that only a later copy shares, by chance, stays
        assert got[k].n_removed == 0 and len(least[k] - cut[k]) <= 1
        # what goes beyond is part of a shorter repeated run, of a piece at least, but for a word or two at the ends of near pieces
        assert len(cut[k] - repeated[k]) <= 4
        assert got[k].kept_text.split() == [w for n, w in enumerate(t.split()) if n not in cut[k]]


def test_shingles_laid_out():
    """All paragraphs' shingles hashed at once are those of each on its own."""
    rng = np.random.default_rng(1)
    for _ in range(50):
        words = [rng.integers(0, 50, n).astype(np.uint64) for n in rng.integers(1, 12, 7)]
        codes, low = par.laid_out(words)
        parts = [par.shingle_hashes(w) for w in words]
        assert np.array_equal(codes, np.concatenate(parts)) and low.tolist() == np.cumsum([0, *map(len, parts[:-1])]).tolist()


def test_shuffles_go(spark):
    """What was shuffled for a written table is deleted when it is written, and the session's settings are as before."""
    folders = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    setting, before = spark.conf.get(common.CLEANUP, None), shuffled()
    rows = common.materialize(spark.range(20_000).repartition(3, "id").sortWithinPartitions("id"), "test-shuffles")
    until = time.monotonic() + 20
    while shuffled() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not shuffled() - before and rows.count() == 20_000 and spark.conf.get(common.CLEANUP, None) == setting
