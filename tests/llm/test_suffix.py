"""Suffix-array deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest

from vinegrid.llm import suffix


def brute(rows):
    """rows: unique (order key, text bytes) -> (bytes, removed, spans, sha256 of the rest)."""
    seen, out = set(), []
    for data in rows:
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(3)
    text = lambda n, letters="abcdefgh é": "".join(rng.choice(letters) for _ in range(n))
    shared = [text(130), text(400), text(100), text(99)]
    docs = [text(rng.randrange(0, 600)) for _ in range(40)]
    docs += [text(50) + rng.choice(shared) + text(rng.randrange(90)) + rng.choice(shared) for _ in range(60)]
    docs += [docs[50], docs[51][:200] + "x" + docs[51][200:], "a" * 1000, "ab" * 400, "a" * 99, "a" * 100, "a" * 101, "abc" * 40, (text(60) * 9)[:500], text(37) * 12]
    docs += [None, "", text(500_000, "ab cdefghij"), "\0" * 300, text(200) + "\0" * 150]
    docs += [docs[-3][250_000:250_500], docs[-3][262_000:262_300]]
    return docs


@pytest.mark.parametrize(("chunk", "bucket"), [(1 << 18, 20_000), (1 << 12, 3)])
def test_remove_repeats(spark, monkeypatch, chunk, bucket):
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    monkeypatch.setattr(suffix, "BUCKET", bucket)
    docs = corpus()
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(frame).collect()}
    want = dict(enumerate(brute([(t or "").encode() for t in docs])))
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_real_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").toPandas().sort_values("doc_id")
    got = suffix.op7_suffix_dedup(spark, tiny).toPandas().sort_values("doc_id")
    assert [tuple(x) for x in got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].values] == brute([(t or "").encode() for t in docs.text])


def test_odd_rows(spark):
    long = "some text that is long enough to be repeated in another document, over a hundred bytes of it, that is, as asked"
    rows = [(None, long), (1, long), (1, long), (1, long + "!"), (None, None), (2, "short")]
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(long)
    assert got == {(None, n, 0), (1, n, n), (1, n + 1, n), (None, 0, 0), (2, 5, 0)}
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_two_stage_sort():
    rng = np.random.default_rng(1)
    for n, letters in ((300, 2), (2000, 4), (500, 1), (3000, 250)):
        text = np.append(rng.integers(1, letters + 1, n), 0).astype(np.uint8)
        order = suffix.two_stage_sort(text)
        raw = text.tobytes()
        assert sorted(order.tolist()) == list(range(n + 1))
        cut = [raw[i : i + 100] for i in order]
        assert cut == sorted(cut)
