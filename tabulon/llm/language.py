"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text's letters (A-Z lower-cased, everything else a space) give hashed byte n-grams of one to three bytes. Their
root frequencies, weighted by inverse document frequency and normalised, are compared by cosine with several centroids per language,
which spherical k-means has made of a bounded sample of texts of known language. A text is rejected if its nearest
centroid is farther than nearly all stretches of as many letters, cut from its language's sample, were from theirs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import textbytes as tb
from tabulon.llm.tables import small_batches

#: The fit's bounds: texts of the sample over all languages (40 MB of features; two for a language at least), hashed features, centroids per language.
SAMPLE, DIMS, CENTROIDS = 5000, 2048, 4
#: One drawn text of so many is held out of the centroids, for the limits of rejection; a language needs so many of them.
HELD, LEAST_HELD = 5, 30
#: A text is rejected below the cosine that all but this share of its language's stretches of about its length reach, and below this share of their median; least stretches of a length.
REJECT, STRETCHES, NEAR = 0.02, 30, 0.75
#: Clusters with a smaller share of their language's sample are dropped.
LEAST_SHARE = 0.03
_LETTER = tb.byte_class([(65, 90), (97, 122), (128, 255)])


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slice: its first text, a row of DIMS root frequencies per text, and its bytes of letters, 0 without a letter."""
    data, offsets = tb.buffers(column)
    for first, last in tb.slices(offsets):
        part, own = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        letter = _LETTER[part]
        b = np.concatenate([np.where(letter, tb.LOWER[part], 32), np.full(3, 32)]).astype(np.uint64)
        grams, n = [], len(part)
        key = np.zeros(n, np.uint64)
        for k in range(3):
            key = key * np.uint64(256) + b[k : n + k]
            grams.append((tb.mix(key + np.uint64(k << 40)) % np.uint64(DIMS)).astype(np.int64))
        out = np.zeros((last - first, DIMS), np.float32)
        letters = np.zeros(last - first, np.int64)
        for i in range(last - first):
            a, e = own[i], own[i + 1]
            if not letter[a:e].any():
                continue
            if (part[a:e][letter[a:e]] < 128).any() or any(c.isalpha() for c in bytes(part[a:e]).decode("utf-8", "replace")):
                letters[i] = letter[a:e].sum()
            for k, g in enumerate(grams):
                g = g[a:e]
                out[i] += np.bincount(g[letter[a:e]] if k == 0 else g, minlength=DIMS)
        yield first, np.sqrt(out), letters


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def stretches(text: str) -> list[str]:
    """The text, and of 4, 8, 16 ... characters one stretch each that starts with a word, as far as the text is longer."""
    out, n = [text], 4
    while n < len(text):
        at = zlib.crc32(f"{n} {text[:64]}".encode()) % (len(text) - n)
        out.append(text[max(text.rfind(" ", 0, at), text.rfind("\n", 0, at)) + 1 :][:n] if at else text[:n])
        n *= 2
    return out


class Model:
    """IDF weights; centroids with their languages; each language's cosines for rejection, by length."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.languages = sorted(set(langs))
        self.idf = (np.log((len(x) + 1) / ((x > 0).sum(0) + 1)) + 0.1).astype(np.float32)
        x, langs = unit(x * self.idf), np.array(langs, object)
        centres, self.owner, self.least = [], [], [(np.zeros(1), np.zeros(1))] * len(self.languages)
        for n, lang in enumerate(self.languages):
            own = x[langs == lang]
            k = min(CENTROIDS, len(own))
            c = own[np.random.default_rng(n).choice(len(own), k, replace=False)]
            for _ in range(15):
                near = (own @ c.T).argmax(1)
                c = unit(np.stack([own[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))]))
            # a cluster of a few texts is rather mislabelled than a kind of the language
            share = np.bincount((own @ c.T).argmax(1), minlength=len(c)) / len(own)
            c = c[share >= min(LEAST_SHARE, share.max())]
            centres.append(c)
            self.owner += [n] * len(c)
        self.centres = np.concatenate(centres) if centres else np.zeros((0, DIMS), np.float32)
        self.owner = np.array(self.owner, int)

    def calibrate(self, lang: np.ndarray, letters: np.ndarray, cosine: np.ndarray, reject: float = REJECT) -> None:
        """Each language's least cosine at each binary order of letters that enough stretches have."""
        order = np.round(np.log2(letters)).astype(int)
        for n in np.unique(lang):
            own, c = order[lang == n], cosine[lang == n]
            at = [k for k in np.unique(own) if (own == k).sum() >= STRETCHES]
            limit = lambda x: min(np.quantile(x, reject), NEAR * np.median(x))
            self.least[n] = (np.array(at, float), np.array([limit(c[own == k]) for k in at])) if at else (np.zeros(1), np.array([limit(c)]))

    def predict(self, x: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, cosine with its nearest centroid (0 to 1), and whether it is too far for its length to be trusted."""
        cosines = unit(x * self.idf) @ self.centres.T
        at = cosines.argmax(1)
        best = np.clip(cosines[np.arange(len(x)), at].astype(float), 0, 1)
        lang = self.owner[at]
        limit = np.zeros(len(x))
        for n in np.unique(lang):
            limit[lang == n] = np.interp(np.log2(letters[lang == n]), *self.least[n])
        return lang, best, best < limit


def fit(docs: DataFrame, sample: int = SAMPLE, reject: float = REJECT) -> Model:
    """Fit on about sample / number-of-languages texts of each language of docs (doc_id, text, lang), at least about two.

    Rows are drawn by a hash of doc_id and text, equal rows count once. Rows with null text or lang take no part. The
    limits of rejection come from texts held out of the centroids, for languages with few texts from all of them.
    """
    docs = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    small_batches(docs.sparkSession)
    counts = docs.groupBy("lang").count().orderBy("lang").collect()  # a row a language
    if not counts:
        return Model(np.zeros((0, DIMS), np.float32), [])
    share = max(2, sample // len(counts))
    spark = docs.sparkSession
    # as Arrow data: rows would start Python workers of another kind, which stay a while
    wanted = F.broadcast(spark.createDataFrame(pa.table({"lang": pa.array([r["lang"] for r in counts], pa.string()), "wanted": pa.array([min(1.0, share / r["count"]) for r in counts], pa.float64())})))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"), F.lit("language"))
    drawn = docs.withColumn("key", key).join(wanted, "lang").where(F.col("key") / F.lit(2.0**64) + 0.5 < F.col("wanted")).select("key", "lang", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x, letters in features(batch.column("text")):
                keep = pa.array(letters > 0)
                part = batch.slice(first, len(x))
                yield pa.RecordBatch.from_arrays([part.column("key").filter(keep), part.column("lang").filter(keep), pa.array([r.tobytes() for r in x[letters > 0]], pa.binary())], ["key", "lang", "x"])

    table = drawn.mapInArrow(rows, "key long, lang string, x binary").groupBy("lang", "key").agg(F.first("x").alias("x")).orderBy("lang", "key").toArrow()
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(-1, DIMS)
    langs, out = np.array(table.column("lang").to_pylist(), object), table.column("key").to_numpy() % HELD == 0
    names, at = np.unique(langs.astype(str), return_inverse=True) if len(langs) else (langs, np.zeros(0, int))
    enough = np.bincount(at[out], minlength=len(names)) >= LEAST_HELD
    model = Model(x[~(out & enough[at])], langs[~(out & enough[at])].tolist())
    shared = spark.sparkContext.broadcast((model, {lang for lang, e in zip(names, enough, strict=True) if e}))

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held = shared.value
        index = {lang: n for n, lang in enumerate(m.languages)}
        for batch in batches:
            for key, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if lang not in index or (lang in held and key % HELD):
                    continue
                for _, x, letters in features(pa.array(stretches(text), pa.string())):
                    if (letters > 0).any():
                        best = (unit(x[letters > 0] * m.idf) @ m.centres[m.owner == index[lang]].T).max(1)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), key)), pa.array(np.full(len(best), index[lang])), pa.array(letters[letters > 0]), pa.array(best.astype(float))], ["key", "lang", "letters", "cosine"])

    if len(x):
        found = drawn.mapInArrow(cosines, "key long, lang long, letters long, cosine double").distinct().select("lang", "letters", "cosine").toArrow()
        model.calibrate(*(found.column(i).to_numpy() for i in range(3)), reject)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and rejected, which replace columns of these names.

    lang_pred is a learned language, or `und` (score 0, rejected) if text is null, empty or has no letter, or nothing
    was learned. score is the cosine with the nearest centroid. rejected: und, or too far from every centroid; a text
    as near as its language's stretches of its length is kept. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "rejected")
    small_batches(docs.sparkSession)
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).schema
    at = docs.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            lang, score, rejected = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            for first, x, letters in features(batch.column(at)):
                some = np.flatnonzero(letters)
                if len(m.languages) and len(some):
                    lang[first + some], score[first + some], rejected[first + some] = m.predict(x[some], letters[some])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[lang], pa.string()), pa.array(score), pa.array(rejected)], names=schema.names)

    return docs.mapInArrow(predict, schema)
