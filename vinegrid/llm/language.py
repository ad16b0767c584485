"""Language identification with string kernels: blended n-gram presence, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vinegrid.llm.common import bound_batches, keep_only, table

#: Hashed n-gram space (lengths 1 to 3 together) and bounds of the learning sample: rows and landmarks for each language, and of
#: all languages together, which many languages share evenly.
SPACE = 1 << 13
LENGTHS = (1, 2, 3)
SAMPLE_PER_LANG = 250
LANDMARKS_PER_LANG = 24
SAMPLE_ROWS = 64_000
LANDMARKS = 6_144
RIDGE = 1.0
UNKNOWN = "und"
#: The pipeline rejects documents whose best one-versus-rest output is below this score, unless they are so short (characters)
#: that a low score says little.
REJECT_BELOW = 0.5
SHORT = 200


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray  # SPACE x m, presence
    sizes: np.ndarray  # m, square roots of the landmarks' own kernel values
    weights: np.ndarray  # (m + 1) x languages


@cache
def _letters() -> np.ndarray:
    """Code point -> itself if it is a letter, else blank."""
    points = np.arange(0x110000, dtype=np.uint32)
    known = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(known, points, np.uint32(32))


#: Odd multipliers of the n-gram hash, any will do.
_MIX = tuple(np.uint32(x) for x in (2654435761, 2246822519, 3266489917))


def presence(text: str, out: np.ndarray) -> None:
    """Mark in ``out`` (SPACE bytes) the n-grams of a whole text, lower-cased, everything but letters as blanks."""
    points = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    code = np.zeros(len(points), np.uint32)
    for n, mix in zip(LENGTHS, _MIX):
        if len(points) < n:
            break
        last = points[n - 1 :]
        code = (code[: len(last)] + last) * mix
        out[((code ^ (code >> np.uint32(15))) * _MIX[0]) >> np.uint32(19)] = 1


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_language_model(docs: DataFrame, sample: int = SAMPLE_PER_LANG, landmarks: int = LANDMARKS_PER_LANG, rows_most: int = SAMPLE_ROWS, landmarks_most: int = LANDMARKS) -> LanguageModel | None:
    """Fit on at most ``sample`` rows of each language, the smallest by a hash of id, language and text; None if no row is labelled.

    Only presence vectors of the sample (1 KB each) come to the driver. The first ``landmarks`` rows of each language are the
    Nyström landmarks. Rows go by their own hash, so repeated or null ids keep each row's own label; rows that repeat one
    another count once. Every language is learned: where ``sample`` rows of each are more than ``rows_most``, each gets an equal
    share, and so for landmarks. More languages than ``landmarks_most`` can't have one each, which is an error.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "lang", "text").alias("k"))
    learned = known.agg(F.countDistinct("lang")).first()[0]
    if learned > min(rows_most, landmarks_most):
        raise ValueError(f"{learned} values of lang are more than rows_most or landmarks_most")
    sample, landmarks = min(sample, rows_most // max(learned, 1)), min(landmarks, landmarks_most // max(learned, 1))
    first = Window.partitionBy("lang").orderBy("k")
    keys = known.select("lang", "k").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample)
    keys = keys.groupBy("lang", "k").agg(F.min("nth").alias("nth"))
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in keys.collect()], "lang string, k long, nth int")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for text in batch.column(2):
                row = np.zeros(SPACE, np.uint8)
                presence(text.as_py(), row)
                bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], names=["lang", "nth", "bits"])

    # the keys are at most ``sample`` rows a language
    texts = known.join(F.broadcast(chosen), ["lang", "k"]).select("lang", "nth", "text")
    found = texts.mapInArrow(vectors, "lang string, nth int, bits binary").dropDuplicates(["lang", "nth"]).collect()
    rows = sorted(found, key=lambda r: (r["lang"], r["nth"]))
    if not rows:
        return None
    x = np.array([np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in rows], np.float32)
    languages = sorted({r["lang"] for r in rows})
    marks = x[[r["nth"] <= landmarks for r in rows]]
    sizes = np.sqrt(np.maximum(marks.sum(axis=1), 1))
    kernel = lambda a: (a @ marks.T) / np.sqrt(np.maximum(a.sum(axis=1), 1))[:, None] / sizes
    values, vectors_ = np.linalg.eigh(kernel(marks).astype(np.float64))
    root = vectors_ @ np.diag(np.where(values > 1e-6, 1 / np.sqrt(np.maximum(values, 1e-6)), 0)) @ vectors_.T
    features = np.hstack([kernel(x).astype(np.float64) @ root, np.ones((len(x), 1))])
    goal = np.array([[1.0 if r["lang"] == lang else -1.0 for lang in languages] for r in rows])
    penalty = RIDGE * np.eye(features.shape[1])
    penalty[-1, -1] = 1e-6
    solved = np.linalg.solve(features.T @ features + penalty, features.T @ goal)
    return LanguageModel(languages, marks.T.copy(), sizes.astype(np.float32), np.vstack([root @ solved[:-1], solved[-1:]]).astype(np.float32))


def predict_language(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1), or columns of other names, to every row; no shuffle.

    The columns passed are kept but for those of the same names, which are replaced.

    Whole texts are scored, in batches: presence rows times landmarks, times the regression's weights. A null text or one
    without letters is ``und`` with score 0, as is every text if the model is None.
    """
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        fitted = shared.value
        for batch in batches:
            said, scores = [], []
            for low in range(0, batch.num_rows, 128):
                texts = batch.column(at).slice(low, 128)
                marks, fit = np.zeros((len(texts), SPACE), np.uint8), np.zeros(len(texts), bool)
                for k, text in enumerate(texts):
                    if fitted is not None and (text := text.as_py()) and any(map(str.isalpha, text)):
                        presence(text, marks[k])
                        fit[k] = True
                if fitted is None:
                    said += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                rows = marks.astype(np.float32)
                own = np.sqrt(np.maximum(rows.sum(axis=1), 1))
                outputs = (rows @ fitted.landmarks) / own[:, None] / fitted.sizes @ fitted.weights[:-1] + fitted.weights[-1]
                best = outputs.argmax(axis=1)
                said += [fitted.languages[b] if f else UNKNOWN for b, f in zip(best, fit)]
                scores += np.where(fit, np.clip((outputs.max(axis=1) + 1) / 2, 0, 1), 0).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{names[0]}` string", f"`{names[1]}` double"])
    return docs.mapInArrow(score, schema)


def identify_languages(docs: DataFrame) -> DataFrame:
    """Learn from rows that are not held out and have a language, then predict all rows: ``(doc_id, held_out, text, lang_pred, score)``.

    The prediction sees the text alone. Repeated rows are predicted alike; an empty table gives no rows.
    """
    model = fit_language_model(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text"))
    thin = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict_language(thin, model)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without letters go, and those that no language claims though they are long enough to tell.

    All columns stay as they are.
    """
    bound_batches(spark)
    model = fit_language_model(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text"))
    judged = predict_language(docs, model, names=("_lang_pred", "_lang_score"))
    return judged.where((F.col("_lang_pred") != UNKNOWN) & ((F.col("_lang_score") >= REJECT_BELOW) | (F.length("text") < SHORT))).select(*docs.columns)
