"""URL filter, packing, sharding, embeddings, SimHash, language ID and top-k against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from vinegrid.llm import common, embeddings, hamming, language, packing, sharding, simhash, trie, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score double"
ODD = [
    (1, "Some words that are here twice over and over again", "en", "a", 5, "x", 1.0),
    (2, None, None, None, None, None, None),
    (3, "", "en", "a", 0, "x", 1.0),
    (4, "Some words that are here twice over and over again", "en", "a", 5, "x", 1.0),
    (4, "Some words that are here twice over and over again", "en", "a", 5, "x", 1.0),
    (None, "No id", "de", "b", 5, "x", 1.0),
    (7, "long text with many words " * 4000, "en", "a", 5, "x", 1.0),
    (8, "123 456 ... !!", "en", None, 5, "x", 1.0),
    (9, "a <|endoftext|> b<|startoftext|>c é ñ ΑΣ Σ ﬁ \u2003x\u00a0y\u0301 e\u0301", "fr", "c", 5, "x", 1.0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def test_urls(spark, small):
    got = urls.op1_url_filter(spark, small).toPandas()
    pages = spark.read.parquet(f"{small}/pages.parquet").toPandas().set_index("page_id")
    intercept, weights = urls.fit_url_model(spark.createDataFrame(list(urls.LABELLED), "url string, label int"))
    assert len(got) == len(pages)
    for r in got.itertuples():
        host, path = url_parts(pages.url[r.page_id])
        assert (r.host, r.path) == (host, path)
        fit = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit, key=lambda x: len(x[0])) if fit else (None, None)
        grams = set()
        for mark, s in (("host", host), ("path", path)):
            s = f"^^{s}$$"
            for n in urls.GRAMS:
                for i in range(len(s) - n + 1):
                    h = xxhash.xxh64_intdigest(mark.encode(), 42)
                    h = xxhash.xxh64_intdigest(s[i : i + n].encode(), h)
                    grams.add((h - (1 << 64) * (h >> 63)) % urls.BUCKETS)
        score = 1 / (1 + np.exp(-(intercept + sum(weights[g] for g in grams))))
        assert abs(score - r.score) < 1e-9
        assert (r.rule if isinstance(r.rule, str) else None) == rule and r.verdict == (verdict or ("block" if score >= 0.5 else "allow"))
    free = got[got.rule.isna()]
    spam = free.host.str.contains("-")
    # the labels know none of these hosts
    assert spam.any() and (free[spam].verdict == "block").mean() > 0.95 and (free[~spam].verdict == "allow").mean() > 0.95


def test_urls_odd(spark):
    rows = [(1, None, "h"), (2, "", "h"), (3, "no scheme", "h"), (4, "HTTP://A.Example.ORG/es/x?y#z", "h"), (5, "http://org", "h"), (6, "http://org/", "h"), (7, "x://y.com?/fr/", "h"), (8, "http://a.com/" + "é" * 30000, "h"), (8, "http://É.com/de/", "h")]
    model = urls.fit_url_model(spark.createDataFrame(list(urls.LABELLED), "url string, label int"))
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), urls.RULES, model).toPandas()
    assert [tuple(x) for x in got[["host", "path"]].values[:7]] == [url_parts(r[1]) for r in rows[:7]]
    assert [x if isinstance(x, str) else None for x in got.rule] == [None, None, None, "example.org/es/", None, "org/", None, None, "com/de/"]
    assert got.host.iloc[8] == "É.com" and got.verdict.isin(["allow", "block"]).all()


def test_labelled_urls():
    """The labels share no host with the tables, and hosts left out of the fit are mostly judged right (see the README)."""
    bare = lambda h: re.sub(r"^(www|m|blog)\\.", "", h)
    hosts = {bare(url_parts(u)[0]) for u, _ in urls.LABELLED if u}
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        pages = pd.read_parquet(f"/root/testdata/{sf}/pages.parquet").url
        assert not hosts & {bare(url_parts(u)[0]) for u in pages}


def test_held_out_urls(spark):
    right = []
    for fold in range(4):
        model = urls.fit_url_model(spark.createDataFrame([x for k, x in enumerate(urls.LABELLED) if k % 4 != fold], "url string, label int"))
        held = [x for k, x in enumerate(urls.LABELLED) if k % 4 == fold]
        got = urls.filter_urls(spark.createDataFrame(held, "url string, label int"), (), model).collect()
        right += [(r.verdict == "block") == bool(r.label) for r in got]
    assert sum(right) / len(right) > 0.75


def test_many_rules_and_empty_tables(spark):
    """5,000 rules are joined, with the result of one expression; empty tables and labels of one kind do no harm."""
    rng = np.random.default_rng(9)
    names = ["com", "org", "a.com", "b.a.com", "x.org", "É.com"] + [f"h{k}.com" for k in range(700)]
    rules = sorted({(str(rng.choice(["allow", "block"])), str(rng.choice(names)), "/" + "/".join(rng.choice(["en", "fr", "1"], rng.integers(0, 3)))) for _ in range(9000)})[:5000]
    pages = [(k, f"http://{rng.choice(['', 'www.', 'c.'])}{rng.choice(names)}/{'/'.join(rng.choice(['en', 'fr', '1', '2'], rng.integers(0, 4)))}?q") for k in range(300)] + [(None, None), (7, "no scheme"), (8, "http://.com/en"), (8, "http://.com/en")]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    model = (0.0, [0.0] * urls.BUCKETS)
    got = Counter((r.page_id, r.url, r.rule, r.verdict) for r in urls.filter_urls(frame, rules, model).collect())
    few = Counter((r.page_id, r.url, r.rule, r.verdict) for r in urls.filter_urls(frame, spark.createDataFrame(rules[:900], "v string, h string, p string"), model).collect())
    assert few == Counter((r.page_id, r.url, r.rule, r.verdict) for r in urls.filter_urls(frame, rules[:900], model).collect())
    want = Counter()
    for key, url in pages:
        host, path = url_parts(url)
        fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = min(fit, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)) if fit else None
        want[(key, url, best and best[1] + best[2], best[0] if best else "block")] += 1
    assert got == want
    assert urls.filter_urls(frame.limit(0), urls.RULES, model).count() == 0
    empty = spark.createDataFrame([], "url string, label int")
    assert urls.fit_url_model(empty) == (0.0, [0.0] * urls.BUCKETS)
    intercept, weights = urls.fit_url_model(spark.createDataFrame([("http://a.com", 1), ("http://b.com", None)], "url string, label int"))
    assert intercept > 0 and not any(weights)


def test_other_tokenizers(spark):
    from tokenizers import Tokenizer

    texts = ["Hello wide  world", "a\nb\t C", "", "Straße 12!"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        whole = Tokenizer.from_file(packing.tokenizer_file(name))
        got = packing.token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer=name, keep_ids=True).collect()
        assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == {k: whole.encode(t, add_special_tokens=False).ids + [0] for k, t in enumerate(texts)}


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_file("word_bpe_49k.json"))
    for docs in (odd, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        got = packing.pack(docs, keep_ids=True).toPandas()
        texts = docs.select("doc_id", "text").toPandas()
        want = Counter()
        for key, text in texts.itertuples(index=False):
            ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
            for k in range(0, len(ids), 2048):
                part = np.array(ids[k : k + 2048], "<u4").tobytes()
                want[(None if pd.isna(key) else int(key), k // 2048, k, len(part) // 4, zlib.crc32(part))] += 1
        assert Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
        for _, group in got.sort_values("offset").groupby("sequence_id"):
            assert (group.offset.values == np.concatenate([[0], np.cumsum(group.length.values)[:-1]])).all() and group.length.sum() <= 2048
        assert got.sequence_id.nunique() <= 1.02 * -(-got.length.sum() // 2048) + 1
    assert packing.pack(none).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for capacity in (10, 37, 64):
        items = sorted(rng.integers(1, capacity + 1, 300).tolist(), reverse=True)
        room = []
        for x in items:
            fit = [(r, i) for i, r in enumerate(room) if r >= x]
            if fit:
                room[min(fit)[1]] -= x
            else:
                room.append(capacity - x)
        plan = packing.plan_best_fit(Counter(items), capacity)
        used, seen = defaultdict(int), Counter()
        for length, a, b, first, each, _ in plan:
            for r in range(a, b):
                used[first + (r - a) // each] += length
                seen[length] += 1
        assert seen == Counter(items) and max(used.values()) <= capacity and len(used) == len(room)


def test_sharding(spark, odd, none, small):
    for docs, n in ((odd, 4), (spark.read.parquet(f"{small}/documents.parquet"), 40)):
        got = sharding.interleave(docs, n).toPandas()
        texts = docs.toPandas()
        assert Counter(zip(got["size"], got.text_crc32)) == Counter((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts.text)
        sizes = got.groupby("shard").size()
        assert sizes.max() - sizes.min() <= 1 and set(sizes.index) == set(range(n))
        for _, group in got.groupby("shard"):
            assert sorted(group.slot) == list(range(len(group)))
        share = got.groupby(["source", "shard"]).size().unstack(fill_value=0)
        assert (share.max(axis=1) - share.min(axis=1) <= 2).all()
    assert sharding.interleave(none, 4).count() == 0


def test_sharding_order(spark, small):
    """Each source's rows in the order of their hash, all rows in that of the fractional rank, cut into equal runs."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = sharding.interleave(docs, 40).toPandas()
    rows = docs.select("doc_id", "text", "source").toPandas()
    crc = [zlib.crc32((t or "").encode()) for t in rows.text]
    start = {r.s: r.h for r in docs.select(F.coalesce("source", F.lit("")).alias("s"), (F.pmod(F.xxhash64(F.lit(8), F.concat(F.lit("1"), "source")), F.lit(1 << 20)) + 0.5).alias("h")).distinct().collect()}

    def seeded(i, c):  # Spark hashes an int in 4 bytes, a long in 8
        h = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), 42)
        for x in (i, c):
            h = xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True), h)
        return h

    order = []
    for source, group in rows.groupby("source"):
        members = sorted((seeded(i, crc[at]), i) for at, i in zip(group.index, group.doc_id))
        order += [((n + 1 - start[source] / (1 << 20)) / len(members), "1" + source, n, i) for n, (_, i) in enumerate(members)]
    n = len(order)
    want = {i: p * 40 // n for p, (*_, i) in enumerate(sorted(order))}
    assert dict(zip(got.doc_id, got.shard)) == want


def test_write_shards(spark, odd, tmp_path):
    dealt = common.materialize(sharding.interleave(odd, 4), "dealt")
    sharding.write_shards(odd, dealt, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter(map(tuple, back.select(*odd.columns).collect())) == Counter(map(tuple, odd.collect()))
    assert Counter((r.shard_number, r.slot, r.doc_id) for r in back.collect()) == Counter((r.shard, r.slot, r.doc_id) for r in dealt.collect())


def cosine_classes(rows, threshold):
    """n_links and component of each vec_id by brute force."""
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = Counter(), {r[0]: r[0] for r in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, (i, x, la) in enumerate(good):
        for j, y, lb in good[a + 1 :]:
            if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i] += 1
                links[j] += 1
                u, v = sorted((find(i), find(j)))
                root[v] = u
    return {r[0]: (links[r[0]], find(r[0])) for r in rows}


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    rows = [(k, [float(x) for x in base[k % 30] + rng.normal(size=16) * rng.choice([0.02, 0.2, 0.3])], int(k % 3)) for k in range(400)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, rows[0][1], None), (404, rows[0][1][:5], 0), (405, [1e300] * 16, 0), (406, [2e300] * 16, 0), (407, [], 1), (408, rows[0][1], 0), (409, [None] + rows[0][1][1:], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = cosine_classes(rows[:405] + rows[407:], embeddings.THRESHOLD) | {405: (1, 405), 406: (1, 405)}
    monkeypatch.setattr(embeddings, "TILE_ROWS", (20, 50))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(frame).collect()}
    assert got == want
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


def test_embeddings_repeated_and_null_ids(spark):
    """Rows that repeat an id are vectors of their own; null ids link and name nothing."""
    v, w, near = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.1, 0.0]
    rows = [(1, v, 0), (1, v, 0), (2, near, 0), (3, w, 0), (3, v, 1), (None, near, 0), (None, w, 1), (4, None, 0), (4, w, 0)]
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == Counter({(1, 3, 1, True): 2, (2, 3, 1, False): 1, (None, 3, 1, False): 1, (3, 1, 3, True): 1, (4, 1, 3, False): 1, (3, 0, 3, True): 1, (None, 0, None, True): 1, (4, 0, 4, True): 1})


def test_quantisation_bound():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    code, scale, err = embeddings.quantise(x)
    near = (code.astype(float) @ code.T.astype(float)) * np.outer(scale, scale)
    assert (np.abs(x @ x.T - near) <= err[:, None] * (1 + err) + err).all()


def slow_simhash(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps, budget):
    root = {i: i for i in ids}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, (i, f) in enumerate(zip(ids, fps)):
        for j, g in zip(ids[a + 1 :], fps[a + 1 :]):
            if (f ^ g).bit_count() <= budget:
                u, v = sorted((find(i), find(j)))
                root[v] = u
    return {i: find(i) for i in ids}


def test_simhash(spark, odd, none, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = simhash.op6_simhash(spark, tiny).toPandas()
    texts = docs.toPandas().set_index("doc_id").text
    assert all(int(r.fingerprint, 16) == slow_simhash(texts[r.doc_id]) for r in got.itertuples())
    assert dict(zip(got.doc_id, got.component_id)) == slow_components(got.doc_id.tolist(), [int(x, 16) for x in got.fingerprint], 2)
    found = simhash.near_duplicates(odd).toPandas()
    assert len(found) == len(ODD) and found.set_index("doc_id").component_id.loc[3] == 2
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one_of_group(spark, odd, tiny)
    assert kept.columns == odd.columns and {1, 2, 7, 9} <= {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize("cap", [4096, 20])
def test_trie_join(spark, monkeypatch, cap):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = set(rng.integers(0, 1 << 63, 150, dtype=np.uint64).tolist())
    for b in base.tolist():
        for _ in range(80):
            fps.add(b ^ sum(1 << int(x) for x in set(rng.integers(0, 64, rng.integers(0, 5)).tolist())))
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "NODE_ROWS", cap)
    signed = [f - (1 << 64) * (f >> 63) for f in fps]
    reps = common.materialize(spark.createDataFrame([(f,) for f in signed], "fp long"), "test")
    comps = {r.node: r.component for r in common.connected_components(simhash.fingerprint_links(reps)).collect()}
    order = sorted(range(len(fps)), key=lambda i: signed[i])
    want = slow_components(list(range(len(fps))), [fps[i] for i in order], 2)
    assert {signed[i]: comps.get(signed[i], signed[i]) for i in order} == {signed[order[a]]: signed[order[b]] for a, b in want.items()}


def test_trie_traversal(spark, small):
    """The tables' own fingerprints go down the trie: node pairs are split, and those beyond the budget dropped, at every level."""
    fps = np.unique(np.array([int(r.fingerprint, 16) for r in simhash.op6_simhash(spark, small).select("fingerprint").collect()], np.uint64))
    one, zero = np.array([[0, len(fps)]]), np.zeros(1, np.int64)
    for budget in (0, 2, 9, 24):
        count: list[int] = []
        i, j = trie.trie_pairs(fps, one, one, zero, zero, budget, count)
        pairs, dropped = count[::2], count[1::2]
        assert len(pairs) > 9 and pairs[0] == 1 and sum(pairs) > len(fps) and sum(dropped) > 0
        near = np.bitwise_count(fps[:, None] ^ fps) <= budget
        assert set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist())) == set(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))))
    same = np.array([3, 3, 9, 9, 9], np.uint64)
    i, j = trie.trie_pairs(same, np.array([[0, 5]]), np.array([[0, 5]]), zero, zero, 1)
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 1), (2, 3), (2, 4), (3, 4)]


def test_simhash_null_ids(spark, monkeypatch):
    """Rows without an id link and bridge."""
    fps = {"a": 0, "b": 3, "c": 15, "d": 63, "e": 31 << 40}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: docs.select("doc_id", F.element_at(F.create_map(*[F.lit(x) for kv in fps.items() for x in kv]), F.col("text")).cast("long").alias("fp")))
    rows = [(5, "a"), (None, "b"), (9, "c"), (None, "d"), (5, "e"), (None, "e"), (2, "a")]
    got = Counter((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(5, 0, 2), (None, 3, 2), (9, 15, 2), (None, 63, 2), (5, 31 << 40, 5), (None, 31 << 40, 5), (2, 0, 2)])


def test_language(spark, odd, none, small):
    got = language.op8_language_id(spark, small).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas().set_index("doc_id")
    assert len(got) == len(docs) and all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in got.held_out.items())
    held = got[got.held_out]
    assert (held.lang_pred == docs.lang[held.index]).mean() > 0.97 and got.score.between(0, 1).all()
    found = language.identify_languages(odd).toPandas()
    assert len(found) == len(ODD) and set(found[found.doc_id.isin([2, 3, 8])].lang_pred) == {"und"}
    assert language.identify_languages(none).count() == 0
    kept = language.keep_identified(spark, odd, small)
    assert kept.columns == odd.columns and not {2, 3, 8} & {r.doc_id for r in kept.collect()}
    strange = spark.createDataFrame([(1, "漢字仮名交じり文 " * 60, "zz"), (2, "short one", "en")], "doc_id long, text string, lang string")
    known = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").where("doc_id > 2")
    both = language.keep_identified(spark, known.union(strange.withColumn("lang", F.lit(None))), small)
    assert {r.doc_id for r in both.where("doc_id < 3").collect()} == {2} and both.count() >= 0.99 * known.count()


def slow_scores(model, text):
    """One-versus-rest outputs by definition: n-grams as sets, kernel values one by one."""
    chars = [c if c.isalpha() else " " for c in text.lower()]

    def slot(gram):
        code = 0
        for c, mix in zip(gram, language._MIX):
            code = (code + ord(c)) * int(mix) % (1 << 32)
        return (code ^ (code >> 15)) * int(language._MIX[0]) % (1 << 32) >> 19

    grams = {slot("".join(chars[i : i + n])) for n in language.LENGTHS for i in range(len(chars) - n + 1)}
    marks = [set(np.flatnonzero(x).tolist()) for x in model.landmarks.T]
    kernel = np.array([len(grams & m) / np.sqrt(len(grams) * len(m)) for m in marks])
    return kernel @ model.weights[:-1] + model.weights[-1]


def test_language_scores(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language.fit_language_model(docs.where(~language.held_out(F.col("doc_id"))))
    got = language.predict_language(docs.select("doc_id", "text"), model).collect()
    for r in got:
        if r.text is None or not any(map(str.isalpha, r.text)):
            assert (r.lang_pred, r.score) == (language.UNKNOWN, 0)
            continue
        outputs = slow_scores(model, r.text)
        assert abs(r.score - min(max((outputs.max() + 1) / 2, 0), 1)) < 1e-4
        assert outputs[model.languages.index(r.lang_pred)] > outputs.max() - 1e-4


def test_language_odd(spark, small):
    """Marks that look like letters are none; repeated and null ids keep their own labels; labels without bound stay bounded."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").where("text IS NOT NULL")
    marks = spark.createDataFrame([(10**9, "½ ² ① 123", None), (10**9 + 1, "ª", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify_languages(docs.union(marks)).where(f"doc_id >= {10**9}").collect()}
    assert (got[10**9].lang_pred, got[10**9].score) == ("und", 0) and got[10**9 + 1].lang_pred != "und"
    held = docs.where(language.held_out(F.col("doc_id")))
    truth = {r.doc_id: r.lang for r in held.collect()}
    for ids in (F.lit(4).cast("long"), F.lit(None).cast("long")):
        model = language.fit_language_model(docs.where(~language.held_out(F.col("doc_id"))).withColumn("doc_id", ids))
        found = language.predict_language(held.drop("lang"), model).collect()
        assert np.mean([r.lang_pred == truth[r.doc_id] for r in found]) > 0.97
    junk = docs.limit(400).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.lit("aa")).otherwise(F.col("doc_id").cast("string")))
    # every language is learned, with fewer rows and landmarks each where there are many, and none is left out in silence
    every = {r[0] for r in junk.select("lang").where("lang IS NOT NULL AND text IS NOT NULL").distinct().collect()}
    for most in (len(every), 3 * len(every), language.LANDMARKS):
        model = language.fit_language_model(junk, landmarks_most=most)
        assert set(model.languages) == every and model.landmarks.shape[1] <= most
    for low in ({"landmarks_most": len(every) - 1}, {"rows_most": len(every) - 1}):
        with pytest.raises(ValueError, match="values of lang"):
            language.fit_language_model(junk, **low)


def test_long_codes(spark):
    """Codes of any length, each among those of its own; every radius by multi-index steps."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(25, 768))
    vectors = {d: [(base[rng.integers(25), :d] + rng.normal(size=d) * rng.choice([0.1, 0.5, 2.0])).tolist() for _ in range(400)] for d in (768, 65, 3)}
    rows = [(10_000 * d + k, v) for d, own in vectors.items() for k, v in enumerate(own)]
    frame = spark.createDataFrame(rows, "id long, v array<double>").select("id", hamming.sign_code(F.col("v")).alias("code"))
    got = defaultdict(list)
    for r in hamming.top_k(frame, frame.where("id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.distance))
    for d, own in vectors.items():
        bits = np.array(own) > 0
        for q in range(0, len(own), 50):
            far = (bits != bits[q]).sum(axis=1)
            assert got[10_000 * d + q] == [(10_000 * d + int(i), int(far[i])) for i in np.lexsort((np.arange(len(own)), far))[:10]]
    assert len(got) == 24


def test_top_k_steps(spark, small):
    """The registered query's searches end by the bound of the radii, not by looking at all codes at once."""
    vectors = np.array([r.embedding for r in spark.read.parquet(f"{small}/embeddings.parquet").where("embedding IS NOT NULL").select("embedding").collect()])
    words = np.unique(np.packbits(vectors > 0, axis=1).view(">u8").astype(np.uint64), axis=0)
    work: list[int] = []
    hamming._covering(words, np.ones(len(words), np.int64), words[::50], 10, vectors.shape[1], work)
    radii = work[::2]
    assert radii == sorted(radii) and radii[-1] > 0 and max(work[1::2]) < len(words) * len(words[::50])


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    codes = [int(base[rng.integers(20)]) ^ sum(1 << int(x) for x in set(rng.integers(0, 64, rng.integers(0, 12)).tolist())) for _ in range(3000)] + [7] * 400
    rows = [(i, c - (1 << 64) * (c >> 63)) for i, c in enumerate(codes)] + [(None, 5), (9999, None)]
    frame = spark.createDataFrame(rows, "id long, code long")
    want = {}
    arr = np.array(codes, np.uint64)
    for q in range(0, len(codes), 50):
        d = np.bitwise_count(arr ^ arr[q])
        order = np.lexsort((np.arange(len(codes)), d))[:10]
        want[q] = [(int(i), int(d[i])) for i in order]
    for small_block, at_once in ((1 << 13, 1 << 21), (500, 1 << 12)):
        monkeypatch.setattr(hamming, "SMALL_BLOCK", small_block)
        monkeypatch.setattr(hamming, "AT_ONCE", at_once)
        got = defaultdict(list)
        for r in hamming.top_k(frame, frame.where("id % 50 = 0")).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.distance))
        assert got == want
    assert hamming.top_k(frame.limit(0), frame).count() == 0
    code = spark.createDataFrame([([1.0, -1.0, 0.5],), ([1.0, None],), ([],), (None,), ([float("inf")],)], "v array<double>").select(hamming.sign_code(F.col("v")).alias("c"))
    assert [r.c for r in code.collect()] == [[3, 5], None, None, None, None]


def test_keyed_documents(spark):
    """Keys follow the order of id, null first, and of the text's hash; equal rows share theirs."""
    rng = np.random.default_rng(3)
    rows = [(None if k % 9 == 0 else int(rng.integers(0, 60)), None if k % 7 == 0 else f"t{rng.integers(0, 4)}") for k in range(400)]
    got = common.keyed_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = sorted({(-1 if i is None else i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows})
    want = {x: k for k, x in enumerate(order)}
    assert len(got) == len(rows) and all(r._key == want[(-1 if r.doc_id is None else r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest())] for r in got)


def test_components(spark):
    rng = np.random.default_rng(6)
    for edges in ([(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)], [tuple(map(int, rng.integers(0, 400, 2))) for _ in range(260)], [(5, 5), (None, 3)]):
        root = {}
        for a, b in edges:
            if a is not None:
                root.setdefault(a, a), root.setdefault(b, b)
        find = lambda x: x if root[x] == x else find(root[x])
        for a, b in edges:
            if a is not None and a != b:
                u, v = sorted((find(a), find(b)))
                root[v] = u
        linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
        got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
        assert got == {x: find(x) for x in linked}
