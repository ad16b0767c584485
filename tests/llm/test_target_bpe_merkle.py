"""Importance resampling, the BPE transducer and the Merkle manifest against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vinegrid.llm import bpe, merkle, packing, resampling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, rank long, grp string, leaf string, idx long, ids string"
REST = ("w", 1, "g", "l", 2, "i")
ODD = [
    (1, "Some words\nthat are here\n\ntwice OVER and over again\n", "en", "a", 5),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "Some words\nthat are here\n\ntwice OVER and over again\n", "en", "a", 5),
    (4, "Some words\nthat are here\n\ntwice OVER and over again\n", "en", "a", 5),
    (None, "No id\nSome words", "de", "b", 5),
    (None, None, None, None, None),
    (7, "long text, with MANY words\n" * 1500 + "x" * 3000, "en", "a", 9223372036854775807),
    (8, "123 456 ... !! \U0001f600 ՘x", "en", None, -5),
    (9, "a <|endoftext|> b<|startoftext|>c é ñ ΑΣ Σ ﬁ  x ý é it's we'll   don't\t\n\n ", "fr", "c", 5),
    (10, "one two three four five six seven eight nine ten " * 3, "", "c", 5),
]


def order(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *REST) for r in ODD], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# operator 11


def drawn(rows, target, ngrams=1, percent=10, buckets=10_000, min_words=20):
    word = re.compile(resampling.WORD)

    def features(text):
        words = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)]

    own = [features(text) for _, text in rows]
    s, t = Counter(b for _, f in own for b in f), Counter(b for text in target for b in features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in s}
    out = []
    for (key, _), (words, f) in zip(rows, own):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], order((r[0],))))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=order)


@pytest.mark.parametrize("ngrams,percent,buckets", [(1, 10, 10_000), (3, 60, 500)])
def test_resampling(spark, tiny, ngrams, percent, buckets):
    docs, target = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "benchmark"))
    got = resampling.resample(docs, target, percent=percent, buckets=buckets, ngrams=ngrams).collect()
    want = drawn([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], ngrams, percent, buckets)
    assert sorted(map(tuple, got), key=order) == want
    assert any(r[4] for r in want)


@pytest.mark.parametrize("ngrams", [1, 2])
def test_resampling_odd(odd, none, ngrams):
    rows, target = [r[:2] for r in ODD], ["Some words", None, "", "over ten\nten"]
    wanted = odd.sparkSession.createDataFrame([(x, "y") for x in target], "text string, doc_id string")
    got = resampling.resample(odd, wanted, percent=50, min_words=3, buckets=64, ngrams=ngrams).collect()
    assert sorted(map(tuple, got), key=order) == drawn(rows, target, ngrams, 50, 64, 3)
    assert resampling.resample(none, wanted, ngrams=ngrams).count() == 0
    empty = resampling.resample(odd, none, percent=50, min_words=3, ngrams=ngrams).collect()
    assert sorted(map(tuple, empty), key=order) == drawn(rows, [], ngrams, 50, 10_000, 3)


def test_lines_are_counted_once(odd):
    lines = resampling.distinct_lines(odd.select("text")).collect()
    assert len({bytes(r["line_key"]) for r in lines}) == len(lines)
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for r in ODD if r[1] for x in r[1].split("\n")]
    assert Counter(r["occurrences"] for r in lines) == Counter(n for x, n in Counter(low).items() if re.search(resampling.WORD, x))


# operator 12


@pytest.fixture(scope="module")
def files():
    from tokenizers import Tokenizer

    file = packing.tokenizer_file(bpe.MODEL)
    return bpe.tokenizer(file), Tokenizer.from_file(file)


def ids_of(own, text):
    return np.frombuffer(b"".join(own.encode(text)), "<u4").tolist()


def test_bpe_like_the_library(files):
    own, library = files
    rng = random.Random(3)
    alphabet = ["a", "b", " ", "  ", "'", "ll", "re", "\n", "\t", "1", "é", "ß", "中", "՘", "　", "!!", "<|endoftext|>", "<|", "\U0001f600", "the", " in"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(1000)]
    wide = bpe.WINDOW
    texts += ["a" * (wide + 9), " " * wide + "x", "'" * (wide - 1) + "ll", "x" * (wide - 3) + "'ll don't", "\n" * (wide + 5) + " ", "é" * wide, "ab \n" * wide]
    texts += ["".join(rng.choices("etaoinsrhl", k=30_000)), "".join(rng.choices("ab ", k=100_000))]
    for text in texts:
        assert ids_of(own, text) == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_bpe_decodes_like_the_library(files):
    own, library = files
    rng = random.Random(4)
    for _ in range(300):
        ids = rng.choices(range(50_257), k=rng.randrange(30)) + rng.choices(range(256), k=8)
        state = own.decoder()
        text = "".join(state.feed(np.array([i], "<u4").tobytes()) for i in ids) + state.finish()
        assert text == library.decode(ids, skip_special_tokens=False)


def random_list(rng):
    """A proper list over three symbols: each rule joins tokens that are there."""
    tokens, rules, spelled = [0, 1, 2], [], {0: (0,), 1: (1,), 2: (2,)}
    made = {v: k for k, v in spelled.items()}
    for _ in range(rng.randrange(1, 14)):
        x, y = rng.choice(tokens), rng.choice(tokens)
        if spelled[x] + spelled[y] in made:
            continue
        new = len(spelled)
        spelled[new] = spelled[x] + spelled[y]
        made[spelled[new]] = new
        rules.append((x, y, new))
        tokens.append(new)
    return rules, spelled


def plain_merges(rules, symbols):
    out = list(symbols)
    for x, y, new in rules:
        k = 0
        while k + 1 < len(out):
            if out[k] == x and out[k + 1] == y:
                out[k : k + 2] = [new]
            k += 1
    return out


def test_lookahead_is_sufficient():
    rng = random.Random(5)
    for _ in range(300):
        rules, spelled = random_list(rng)
        merges = bpe.MergeList(rules, {0: 1, 1: 1, 2: 1})
        symbols = rng.choices(range(3), k=40)
        whole = plain_merges(rules, symbols)
        assert merges.merged(symbols) == whole
        ends = lambda tokens: {sum(len(spelled[t]) for t in tokens[:k]) for k in range(len(tokens) + 1)}
        for n in range(1, len(symbols)):
            final = n - merges.lookahead
            part = plain_merges(rules, symbols[:n])
            assert {e for e in ends(part) if e <= final} == {e for e in ends(whole) if e <= final}


def test_transducer_holds_little():
    rng = random.Random(6)
    for _ in range(100):
        rules, _ = random_list(rng)
        merges = bpe.MergeList(rules, {0: 1, 1: 1, 2: 1})
        symbols, stream, out, at = rng.choices(range(3), k=rng.randrange(400)), bpe.Transducer(merges), [], 0
        while at < len(symbols):
            n = rng.randrange(1, 50)
            for tokens in stream.feed(symbols[at : at + n]):
                out += tokens
            assert len(stream.held) <= 2 * (merges.lookahead + merges.longest)
            at += n
        assert out + stream.finish() == plain_merges(rules, symbols)
    with pytest.raises(ValueError):
        bpe.MergeList([(3, 0, 4), (0, 1, 3)], {0: 1, 1: 1, 2: 1})


def expected_round_trip(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op12(spark, small, files):
    got = bpe.op12_bpe(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted((r["doc_id"], *expected_round_trip(files[1], r["text"])) for r in docs)


def test_bpe_odd(odd, none, files):
    got = bpe.round_trips(odd).collect()
    assert sorted(map(tuple, got), key=order) == sorted(((r[0], *expected_round_trip(files[1], r[1])) for r in ODD), key=order)
    back = bpe.decode_ids(bpe.encode_texts(odd)).collect()
    assert sorted(map(tuple, back), key=order) == sorted(((r[0], r[1] or "") for r in ODD), key=order)
    assert bpe.round_trips(none).count() == bpe.encode_texts(none).count() == 0
    nulls = none.sparkSession.createDataFrame([(1, None), (2, [None, 262, 99_999])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, bpe.decode_ids(nulls).collect())) == [(1, ""), (2, " the")]


# operator 13


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest_of(row, more=0):
    doc_id, text, lang, source, n_chars = row
    values = doc_id, source, lang, None if n_chars is None else n_chars + more, text
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][k : k + fanout])) for k in range(0, len(levels[-1]), fanout)])
    return levels


def proved(rows, fanout=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda r: (order(r[:1]), digest_of(r)))
        trees.append(levels_of([digest_of(r) for r in groups[g]], fanout))
    top = levels_of([t[-1][0] for t in trees], fanout)
    out = []
    for number, g in enumerate(names):
        for place, r in enumerate(groups[g]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            x, siblings = digest_of(r, int(tampered)), []
            for levels, k in ((trees[number], place), (top, number)):
                for level in levels[:-1]:
                    first = k // fanout * fanout
                    run = level[first : first + fanout]
                    siblings += run[: k - first] + run[k - first + 1 :]
                    x, k = h("".join(run[: k - first] + [x] + run[k - first + 1 :])), k // fanout
            out.append((r[0], digest_of(r), trees[number][-1][0], top[-1][0], siblings, x, x == top[-1][0]))
    return sorted(out, key=lambda r: order(r[:2]))


def spelled_out(rows):
    return sorted(((r["doc_id"], r["leaf"].hex(), r["subroot"].hex(), r["root"].hex(), [bytes(x).hex() for x in r["proof"]], r["folded_root"].hex(), r["folded_root"] == r["root"]) for r in rows), key=lambda r: order(r[:2]))


def manifest_of(docs, fanout=2):
    own = lambda n: merkle.row_digest([F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claim = F.when(tampered, own((F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")))
    built = merkle.build(docs, own(F.col("n_chars")), "doc_id", "lang", fanout, {"claim": claim})
    return built, built.leaves.select(F.col("key").alias("doc_id"), "leaf", "tree", "idx", "n", F.coalesce("claim", "leaf").alias("claimed"))


@pytest.mark.parametrize("fanout,block", [(2, 4096), (2, 4), (3, 9)])
def test_manifest(spark, tiny, odd, monkeypatch, fanout, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for table, rows in ((docs, [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()]), (odd, list(ODD))):
        built, wanted = manifest_of(table, fanout)
        assert spelled_out(merkle.prove(built, wanted).collect()) == proved(rows, fanout)


def test_manifest_of_part(spark, tiny, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 16)
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    built, wanted = manifest_of(docs)
    some = wanted.where("doc_id % 9 IN (0, 4)")
    rows = proved([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()])
    assert spelled_out(merkle.prove(built, some).collect()) == [r for r in rows if r[0] % 9 in (0, 4)]


def test_missing_is_minimal():
    rng = random.Random(7)
    for _ in range(200):
        n, fanout = rng.randrange(1, 40), rng.randrange(2, 4)
        known = rng.sample(range(n), rng.randrange(1, n + 1))
        found = merkle._missing(known, n, fanout)
        have = {(0, k) for k in known}
        # what lies beside the paths of the known leaves, and above none of them
        paths = {(level, k // fanout**level) for k in known for level in range(merkle._height(n, fanout) + 1)}
        beside = {(level, k) for level in range(merkle._height(n, fanout)) for k in range(merkle._size(n, level, fanout)) if (level + 1, k // fanout) in paths}
        assert sorted(found) == sorted(beside - paths - have)


def test_manifest_odd(spark, none):
    built, wanted = manifest_of(none)
    assert built.trees.count() == built.nodes.count() == merkle.prove(built, wanted).count() == 0
    one = spark.createDataFrame([(5, "a", None, None, None, *REST)], DOCS)
    built, wanted = manifest_of(one)
    assert spelled_out(merkle.prove(built, wanted).collect()) == proved([(5, "a", None, None, None)])
