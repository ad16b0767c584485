"""Sampled segmentations against enumeration, exact round trips and sampling frequencies."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from vinegrid.llm import segmentation as seg
from vinegrid.llm.packing import tokenizer_file


@pytest.fixture(scope="module")
def vocab():
    return seg.vocabulary(tokenizer_file(seg.MODEL))


def enumerate_all(vocab, text):
    """All segmentations of a short text with their log probabilities."""
    s = vocab.normalized(text)
    p = vocab.processor
    plain = {p.id_to_piece(i): i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))}
    out = {}

    def go(at, ids, weight):
        if at == len(s):
            out[tuple(ids)] = weight
            return
        for end in range(at + 1, len(s) + 1):
            i = plain.get(s[at:end])
            if i is not None:
                go(end, ids + [i], weight + vocab.weight[i])
        if s[at] not in plain:
            raw = s[at].encode()
            go(at + 1, ids + [vocab.byte_ids[b] for b in raw], weight + vocab.byte_weight * len(raw))

    go(0, [], 0.0)
    total = np.logaddexp.reduce(list(out.values()))
    return {ids: w - total for ids, w in out.items()}


@pytest.mark.parametrize("text", ["the", "Hello", "a b", " x", "né\U0001f600!", "it\nis", "  ab ", "x"])
def test_all_segmentations(vocab, text):
    want = enumerate_all(vocab, text)
    [(_, _, found)] = seg.sample_batch([(1, text, 99)], vocab, 10**6, 1.0)
    got = {tuple(ids.tolist()): log_p for ids, log_p, _, _ in found}
    assert len(found) == len(want) and got.keys() == want.keys()
    assert max(abs(got[x] - want[x]) for x in want) < 1e-9
    values = [v for _, _, v, _ in found]
    assert values == sorted(values, reverse=True) and all(i == 0 for *_, i in found)
    assert all(vocab.decode(ids) == text for ids, *_ in found)


def test_frequencies(vocab):
    want = enumerate_all(vocab, "the is")
    n, first, both = 20_000, Counter(), Counter()
    weights = defaultdict(float)
    for _, _, found in seg.sample_batch([(s, "the is", int(seg._mixed(np.array([s], np.uint64))[0])) for s in range(n)], vocab, 2, 1.0):
        assert len({tuple(x[0].tolist()) for x in found}) == 2
        first[tuple(found[0][0].tolist())] += 1
        both.update(tuple(x[0].tolist()) for x in found)
        for ids, log_p, _, inclusion in found:
            weights[tuple(ids.tolist())] += np.exp(log_p - inclusion) / n
    for ids, log_p in want.items():
        p = np.exp(log_p)
        assert abs(first[ids] / n - p) < 5 * np.sqrt(p / n) + 1e-3
    # the two samples follow sequential sampling without replacement, and weights of p over inclusion are unbiased
    top = max(want, key=want.get)
    p = {x: np.exp(w) for x, w in want.items()}
    second = sum(p[x] * p[top] / (1 - p[x]) for x in p if x != top)
    assert abs(both[top] / n - (p[top] + second)) < 0.02
    assert abs(weights[top] - p[top]) < 0.03


def test_rows(spark):
    rows = [(1, "Some words, and more."), (2, None), (3, ""), (None, "no id"), (5, "long words over and over " * 5000), (5, "x" * 3000), (6, "\n\n \t é　\u0000 end")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = seg.decode_pieces(seg.sample_segmentations(frame)).toPandas()
    assert got.round_trip.all() and (got.log_inclusion <= 1e-12).all()
    texts = dict(rows)
    assert all(r.decoded == (texts.get(r.doc_id) or "") for r in got.itertuples() if r.doc_id in (1, 2, 3, 6))
    assert got[got.doc_id.isin([2, 3])]["sample"].tolist() == [0, 0]
    assert all(got[got.doc_id == k].ids.map(tuple).nunique() == len(got[got.doc_id == k]) for k in (1, 6))
    again = seg.sample_segmentations(frame.repartition(5)).toPandas()
    assert sorted(zip(got.ids_crc32, got.n_pieces)) == sorted(zip(again.ids_crc32, again.n_pieces))
    assert seg.sample_segmentations(frame.limit(0)).count() == 0


def test_real_documents(spark, tiny):
    got = seg.op9_sentencepiece(spark, tiny).toPandas()
    assert got.round_trip.all() and got.groupby("doc_id").ids_crc32.nunique().min() >= 2
