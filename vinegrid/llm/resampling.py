"""Importance resampling towards a target: documents are drawn by how much likelier the target makes their words than the corpus does.

Features are hashed runs of words. Texts fall into lines, which no word crosses; equal lines are counted once and multiplied by how
often they occur, and the runs that cross a line's end are counted on their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vinegrid.llm.common import crc32_sql, materialize, table
from vinegrid.llm.ranking import ranked

BUCKETS = 10_000
NGRAMS = 1
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
#: Characters of a word, after A-Z are lower-cased: digits, letters a-z and all beyond ASCII (fixed value).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

c = F.col
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets)).cast("int")


def _longer(runs: Column, words: Column, n: int, join: Callable[[Column, Column], Column]) -> Column:
    """Runs of ``n`` words from those of one less, each joined with the word after it; empty if there are too few words."""
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    return F.zip_with(F.slice(runs, 1, count), F.slice(words, n, count), join)


def _inner(words: Column, buckets: int, ngrams: int) -> Column:
    """Buckets of all runs of up to ``ngrams`` words, with repeats."""
    runs, found = words, []
    for n in range(1, ngrams + 1):
        if n > 1:
            runs = _longer(runs, words, n, lambda run, w: F.concat(run, F.lit(" "), w))
        found.append(F.transform(runs, lambda g: _bucket(g, buckets)))
    return F.flatten(F.array(*found))


def _crossing(lines: Column, buckets: int, ngrams: int) -> Column:
    """Buckets of the runs of words that lie in more than one line of a text; none for a null text."""
    none = F.array().cast("array<int>")
    if ngrams == 1:
        return none
    words = F.flatten(F.transform(lines, lambda line, k: F.transform(_words(line), lambda w: F.struct(w.alias("g"), k.alias("a"), k.alias("b")))))
    runs, found = words, []
    for n in range(2, ngrams + 1):
        runs = _longer(runs, words, n, lambda run, w: F.struct(F.concat(run.g, F.lit(" "), w.g).alias("g"), run.a.alias("a"), w.b.alias("b")))
        found.append(F.transform(F.filter(runs, lambda x: x.a != x.b), lambda x: _bucket(x.g, buckets)))
    return F.coalesce(F.flatten(F.array(*found)), none)


def _key(text: Column) -> Column:
    """128 bits of a text's SHA-256: equal keys are equal texts but for a chance of about 1e-14 among 1e12 of them."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _lines(texts: DataFrame) -> DataFrame:
    """(text_key, lines) of each row of (text), lower-cased; null texts are left out."""
    low = texts.where(c("text").isNotNull()).select(F.translate("text", _UPPER, _LOWER).alias("low"))
    return low.select(_key(c("low")).alias("text_key"), F.split("low", "\n").alias("lines"))


def distinct_lines(texts: DataFrame, buckets: int = BUCKETS, ngrams: int = NGRAMS, tag: str = "lines") -> DataFrame:
    """(line_key, occurrences, n_words, buckets) of the different lines of all ``texts`` (text), each one's features computed once.

    Lines are combined before they are shuffled, so that a line of a third of all rows is one row a task. Lines without words are
    left out. The result is a written table.
    """
    lines = _lines(texts).select(F.explode("lines").alias("line")).where("line <> ''")
    once = lines.groupBy("line").agg(F.count("*").alias("occurrences"))
    counted = once.select(_key(c("line")).alias("line_key"), "occurrences", _words(c("line")).alias("words"))
    return materialize(counted.where("size(words) > 0").select("line_key", "occurrences", F.size("words").alias("n_words"), _inner(c("words"), buckets, ngrams).alias("buckets")), tag)


def bucket_counts(texts: DataFrame, lines: DataFrame, buckets: int = BUCKETS, ngrams: int = NGRAMS) -> DataFrame:
    """(bucket, n): how often all texts hold a feature of each bucket; at most ``buckets`` rows."""
    inner = lines.select("occurrences", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("occurrences").alias("n"))
    if ngrams == 1:
        return inner
    over = _lines(texts).select(F.explode(_crossing(c("lines"), buckets, ngrams)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return inner.union(over).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Gain of each bucket from two tables (bucket, n): 1000 times the log of the target's smoothed share over the corpus's, floored."""
    both = corpus.select("bucket", c("n").alias("s"), F.lit(0).cast("long").alias("t")).union(target.select("bucket", F.lit(0).cast("long"), "n"))
    per = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    sums = per.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("S"), F.coalesce(F.sum("t"), F.lit(0)).alias("T")).first()
    whole = per.sparkSession.range(buckets).select(c("id").cast("int").alias("bucket")).join(per, "bucket", "left")
    s, t = (F.coalesce(x, F.lit(0)).cast("double") for x in ("s", "t"))
    odds = (t + 1) * F.lit(float(sums["S"] + buckets)) / ((s + 1) * F.lit(float(sums["T"] + buckets)))
    found = whole.select("bucket", F.floor(F.lit(1000.0) * F.log(odds)).alias("gain")).collect()  # as many rows as buckets
    return [r["gain"] for r in sorted(found, key=lambda r: r["bucket"])]


def _total(of: Column, gain: list[int]) -> Column:
    """Sum of the gains of an array of buckets."""
    values = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<long>")
    return F.aggregate(of, F.lit(0).cast("long"), lambda total, b: total + F.get(values, b))


def weigh(docs: DataFrame, lines: DataFrame, gain: list[int], buckets: int = BUCKETS, ngrams: int = NGRAMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: the mean gain of its features, floored.

    A text's sums are those of its lines, times how often it holds each, and of the runs that cross lines. They are taken once a
    text: rows of one text are combined with their number before the shuffle, and get the sums back by its key. A text without
    words, or null, has weight 0. Null and repeated ids are rows like any others.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    summed = lines.select("line_key", "n_words", F.size("buckets").alias("n"), _total(c("buckets"), gain).alias("gain"))
    # the first line of a text tells how many rows hold it
    at = _lines(named).select("text_key", F.posexplode("lines").alias("at", "line"))
    places = at.where("at = 0 OR line <> ''").groupBy("text_key", _key(c("line")).alias("line_key")).agg(F.count("*").alias("times"), F.count_if(c("at") == 0).alias("rows"))
    total = lambda x: F.coalesce(F.sum(c("times") * c(x)), F.lit(0)).alias(x)
    per_text = places.join(summed, "line_key", "left").groupBy("text_key").agg(total("n_words"), total("n"), total("gain"), F.sum("rows").alias("rows"))
    per_text = per_text.select("text_key", *[F.expr(f"{x} div rows").alias(x) for x in ("n_words", "n", "gain")])
    low = F.translate("text", _UPPER, _LOWER)
    own = [_key(low).alias("text_key")]
    if ngrams > 1:
        over = _crossing(F.split(low, "\n"), buckets, ngrams)
        own += [F.size(over).alias("more"), _total(over, gain).alias("more_gain")]
    else:
        own += [F.lit(0).alias("more"), F.lit(0).alias("more_gain")]
    joined = named.select("doc_id", *own).join(per_text, "text_key", "left")
    n, total_gain = F.coalesce("n", F.lit(0)) + c("more"), F.coalesce("gain", F.lit(0)) + c("more_gain")
    sums = joined.select("doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), n.cast("long").alias("n_features"), total_gain.cast("long").alias("gain"))
    floored = F.when(c("n_features") == 0, F.lit(0)).otherwise(F.expr("(gain - pmod(gain, greatest(n_features, 1))) div greatest(n_features, 1)"))
    return sums.select("doc_id", "n_words", "n_features", floored.cast("long").alias("weight"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, ngrams: int = NGRAMS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """Draw ``percent`` of the documents of at least ``min_words`` words, without replacement, in proportion to exp(weight / 1000).

    Each row's weight gets Gumbel noise, made from the seed and its doc_id (a null id: the seed alone), and the highest scores are
    drawn; ties go to the smaller id, a null one first, and equal rows to either. Returns every row: ``(doc_id, n_features, weight,
    score, rank)``, rank null where it isn't drawn. Only the named columns are read, so other columns' names can't clash. An empty
    table gives no rows; an empty target makes rare features of the corpus weigh more.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = target.select(F.col(target_text_col).cast("string").alias("text"))
    own, theirs = distinct_lines(named, buckets, ngrams, "lines"), distinct_lines(wanted, buckets, ngrams, "target-lines")
    gain = gains(bucket_counts(named, own, buckets, ngrams), bucket_counts(wanted, theirs, buckets, ngrams), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(c("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = materialize(weigh(named, own, gain, buckets, ngrams).withColumn("score", (c("weight") + noise).cast("long")), "resample-scores")
    able = materialize(scored.where(c("n_words") >= min_words), "resample-able")
    drawn = able.count() * percent // 100
    placed = ranked(able, [c("score").desc(), c("doc_id").asc_nulls_first()], "resample-ranked")
    rank = F.when(c("rank") < drawn, c("rank") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*columns, rank.alias("rank")).union(scored.where(c("n_words") < min_words).select(*columns, F.lit(None).cast("long")))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = f"""
WITH RECURSIVE own AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}') AS words FROM documents),
theirs AS (SELECT unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}')) AS w FROM benchmark),
grams AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(words) AS w FROM own) GROUP BY ALL),
{crc32_sql("SELECT w FROM grams UNION SELECT w FROM theirs")},
hashed AS (SELECT w, crc % {BUCKETS} AS b FROM crc),
corpus AS (SELECT b, sum(n)::DOUBLE AS s FROM grams JOIN hashed USING (w) GROUP BY b),
target AS (SELECT b, count(*)::DOUBLE AS t FROM theirs JOIN hashed USING (w) GROUP BY b),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM corpus) AS s_all, (SELECT coalesce(sum(t), 0) FROM target) AS t_all),
gained AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + {BUCKETS}) / ((s + 1) * (t_all + {BUCKETS}))))::BIGINT AS gain FROM corpus LEFT JOIN target USING (b), sums),
weighed AS (SELECT id, sum(n * gain) AS gain FROM grams JOIN hashed USING (w) JOIN gained USING (b) GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(len(words), 0) AS n_features, CASE WHEN gain IS NULL THEN 0 ELSE (gain - ((gain % len(words)) + len(words)) % len(words)) // len(words) END AS weight,
    ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM own LEFT JOIN weighed USING (id)
),
noisy AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS score FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= {MIN_WORDS}) AS n FROM noisy)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  CASE WHEN n_features >= {MIN_WORDS} AND r <= {PERCENT} * n // 100 THEN r END::BIGINT AS rank
FROM placed
"""
