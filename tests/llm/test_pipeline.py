"""The corpus pipeline, stage by stage, on small tables."""

import zlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from vinegrid.llm import common, packing, paragraphs, simhash
from tests.llm.test_paragraphs import brute


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    named = stages["language_id"](spark, docs, tiny).cache()
    assert named.columns == columns and named.count() >= 0.98 * docs.count()
    single = stages["simhash_dedup"](spark, named, tiny).cache()
    rows = named.toPandas()
    rows = rows.sort_values("doc_id")
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {rows.doc_id.iloc[k] for k in slow_near(rows.text)}
    clean = stages["substring_dedup"](spark, single, tiny).cache()
    before = single.toPandas().sort_values("doc_id")
    after = clean.toPandas().sort_values("doc_id")
    assert clean.columns == columns and after.text.tolist() == brute(before.text.tolist())[0]
    packed = stages["packing"](spark, clean, tiny).toPandas()
    assert set(packed.doc_id) == set(after.doc_id)
    encoder = packing.encoder(packing.tokenizer_file("word_bpe_49k.json"))
    texts = after.set_index("doc_id").text
    for key, group in packed.sort_values("piece").groupby("doc_id"):
        data = encoder.encode(texts[key]) + bytes(4)
        assert group.length.sum() * 4 == len(data)
        assert group.ids_crc32.tolist() == [zlib.crc32(data[k : k + 8192]) for k in range(0, len(data), 8192)]
    whole = corpus_pipeline.run(spark, tiny).toPandas()
    order = ["doc_id", "piece"]
    assert np.array_equal(whole.sort_values(order)[["doc_id", "piece", "length", "ids_crc32"]].values, packed.sort_values(order)[["doc_id", "piece", "length", "ids_crc32"]].values)


def test_empty_and_odd(spark, tiny):
    schema = spark.read.parquet(f"{tiny}/documents.parquet").schema
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tiny) if docs.columns == schema.names else docs
    assert docs.count() == 0
    docs = spark.createDataFrame([(None, "some words of a text", "en", None, 4), (1, None, None, None, None), (1, "other words of a text", "en", "a", 4), (1, "other words of a text", "en", "a", 4)], schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tiny)
    assert docs.count() >= 2


def slow_near(texts, threshold=0.8):
    """Numbers of the texts that stay, by all pairs of sets of five-word shingles."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in words]
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= threshold * max(len(a), len(b)) and len(a & b) >= threshold * len(a | b):
                u, v = sorted((find(i), find(j)))
                root[v] = u
    return {i for i in root if find(i) == i}


def test_near_copies(spark, small):
    """Edited copies go: the stage's result on documents and on planted edits is that of all pairs."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(400).toPandas().sort_values("doc_id")
    texts = [*docs.text.tolist(), None, "", "  "]
    long = [t.split() for t in docs.text if len(t.split()) > 100][:40]
    for k, words in enumerate(long):  # copies with one to four words in a hundred changed
        edited = list(words)
        for at in range(k % 7, len(edited), 100 // (k % 4 + 1)):
            edited[at] = f"edited{k}"
        texts.append(" ".join(edited))
    want = slow_near(texts)
    assert len(texts) - len(want) >= 25
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = simhash.keep_one_of_group(spark, frame, "")
    assert got.columns == frame.columns and {r.doc_id for r in got.collect()} == want


def test_trie_of_all_texts(spark, monkeypatch):
    """Pairs that no block holds but whose fingerprints are within operator 6's bits are found by the trie of the whole table."""
    monkeypatch.setattr(paragraphs, "tune_bands", lambda *_: (8, 1))
    rng, rows = np.random.default_rng(5), []
    while len(rows) < 24:
        words = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        other = [*words[:200], "changed", *words[201:]] if rng.random() < 0.5 else [*words, "more", "words"]
        pair = [paragraphs.word_hashes(" ".join(x)) for x in (words, other)]
        one, two = paragraphs.band_keys(pair, 8, 1)
        near = (np.bitwise_count(np.bitwise_xor(*(np.int64(paragraphs.fingerprint(paragraphs.shingle_hashes(w))) for w in pair)).view(np.uint64))) <= simhash.BUDGET
        if one[0] != two[0] and near:
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    got = simhash.keep_one_of_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == set(range(0, 24, 2))


def test_trie_candidates(spark):
    """Pairs within the budget, each once, and the other texts of a fingerprint beside its first."""
    texts = spark.createDataFrame([(1, 0), (2, 3), (3, 7), (4, 0)], "key long, par long")
    got = {(r.key_a, r.key_b) for r in simhash.trie_candidates(texts).collect()}
    assert got == {(1, 2), (2, 3), (1, 4)}


def test_repeated_ids(spark):
    """Near-duplicates go row by row: by id and text, not by id alone."""
    words = [f"w{k}" for k in range(60)]
    a, edited, b, c = " ".join(words), " ".join([*words[:-1], "other"]), " ".join(words[::-1]), "a text without an id and of its own"
    rows = [(3, edited, "x"), (7, a, "x"), (7, b, "x"), (8, "one two three four five six", "z"), (8, "one two three four five six", "y"), (None, c, "x"), (None, c, "x"), (9, c, "x"), (None, "another one", None)]
    got = simhash.keep_one_of_group(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(3, edited, "x"), (7, b, "x"), (8, "one two three four five six", "y"), (None, c, "x"), (None, "another one", None)], key=str)


def test_batches_are_bounded(spark, tiny):
    """Each stage limits the Arrow batches that pass between executors and Python workers by bytes; a smaller limit stays."""
    schema = spark.read.parquet(f"{tiny}/documents.parquet").schema
    docs, before = spark.createDataFrame([], schema), spark.conf.get(common.BATCH)
    texts = spark.range(400, numPartitions=1).selectExpr(f"repeat(cast(id % 10 as string), {1 << 17}) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(common.BATCH)
            stage(spark, docs, tiny)
            got = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
            assert sum(got) >= 400 << 17 and max(got) <= 2 * common.BATCH_BYTES
        spark.conf.set(common.BATCH, "1m")
        common.bound_batches(spark)
        assert spark.conf.get(common.BATCH) == "1m"
    finally:
        spark.conf.set(common.BATCH, before)


def test_caches_go_with_their_stage():
    """A worker's cache of one stage is emptied by the first task of another, and kept by tasks of its own."""
    file = packing.tokenizer_file("word_bpe_49k.json")
    packing.encoder(file).encode("some words")
    texts = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words of a text"])], names=["key", "text"])
    banded = paragraphs._banded(1, 5, (3, 2), (2, 2), True)
    for _ in range(2):
        assert list(banded(iter([texts]))) and not packing._ENCODERS and "some" in paragraphs._HASHES
    held, last = packing.encoder(file), paragraphs._HASHES
    common.keep_only(packing._ENCODERS)
    assert packing.encoder(file) is held and not last
