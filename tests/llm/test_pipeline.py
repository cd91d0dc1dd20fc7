"""Every stage of the pipeline against a brute-force version, on a table with planted rows."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabulon.llm import language, quality, queries

KEPT = ["score", "rejected", "lang_pred", "n_words", "n_items", "ids", "row", "set_id", "label", "hash"]


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """documents with repeated and null ids, copies, leaks and columns that operators use themselves; labels; benchmark."""
    out = f"file://{tmp_path_factory.mktemp('pipeline')}"
    prose = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").where("length(text) < 6000").orderBy("doc_id").limit(250).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet").collect()}
    leak = "these eleven words stand in the benchmark and in some documents"
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in prose]
    clean = [r for r in rows if labels.get(r[0]) == 1 and r[1] and r[2] == "en" and len(r[1].split()) > 60][:12]
    half = lambda a, b, middle="": a[1][len(a[1]) // 2 :] + f" {middle} " + b[1][: len(b[1]) // 2]
    rows += [(clean[0][0], clean[1][1], "en"), (None, clean[2][1], "en"), (None, clean[2][1], "en"), (7_000, clean[3][1] + " more", "en"), (7_001, half(clean[6], clean[7], leak), "en"), (7_001, half(clean[8], clean[9]), None)]
    rows += [(7_002, None, "en"), (7_003, "", None), (None, None, None), (7_004, "12 34 ?!", "de"), (7_004, "12 34 ?!", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    docs.withColumns({c: F.lit(f"own {c}") for c in KEPT}).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, q) for i, q in labels.items()], "doc_id long, quality int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, "So: " + leak.upper() + "!"), (2, None), (None, leak)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def keys(rows):
    return sorted(((r["doc_id"], r["text"], r["lang"]) for r in rows), key=str)


def plain_quality(spark, docs, folder, rows):
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    m = quality.fit(docs, labels)
    cosine = lambda a, b: float(a @ b) / max(1e-12, float(np.linalg.norm(a) * np.linalg.norm(b)))

    def score(text):
        (_, x), *_ = quality.features(pa.array([text], pa.string()))
        x = x[0].astype(float) * m.idf
        x = (x / max(1e-12, np.linalg.norm(x))) @ m.project
        near = sorted(((cosine(x, v.astype(float)), float(y)) for v, y in zip(m.vectors, m.labels, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        near = [(max(s, 0.0), y) for s, y in near]
        floor = min(min(s for s, _ in near), 0.999)
        votes = [(((s - floor) / (1 - floor) + 0.05) * (s > 0), y) for s, y in near]
        return (sum(w * y for w, y in votes) + 0.05 * m.prior) / (sum(w for w, _ in votes) + 0.05)

    scores = [score(r["text"]) for r in rows]
    return [r for r, s in zip(rows, scores, strict=True) if s >= corpus_pipeline.QUALITY], {str(r["text"]) for r, s in zip(rows, scores, strict=True) if abs(s - corpus_pipeline.QUALITY) < 0.05}  # equal neighbours may stand at the edge of the nearest


def plain_languages(spark, docs, folder, rows):
    m, near = language.fit(docs), set()

    def keep(r):
        (_, x, letters), *_ = language.features(pa.array([r["text"]], pa.string()))
        if not letters[0]:
            return False
        x = x[0].astype(float) * m.idf
        cosines = [float(x @ c) / float(np.linalg.norm(x) * np.linalg.norm(c)) for c in m.centres]
        best = int(np.argmax(cosines))
        limit = np.interp(np.log2(letters[0]), *m.least[m.owner[best]])
        if abs(cosines[best] - limit) < 1e-4:
            near.add(str(r["text"]))
        return cosines[best] >= limit

    return [r for r in rows if keep(r)], near


def plain_duplicates(spark, docs, folder, rows):
    lower = lambda t: re.sub("[A-Z]", lambda x: x[0].lower(), t or "")
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(r["text"]))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[find(k) if sets[k] else -1 - k].append(r)
    return groups


def plain_leaks(spark, docs, folder, rows):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = words(r["text"]) if r["item_id"] is not None else []
        windows |= {tuple(w[k : k + 8]) for k in range(max(1, len(w) - 7))} if w else set()
    holds = lambda w: any(tuple(w[k : k + len(x)]) == x for x in windows for k in range(len(w) - len(x) + 1))
    return [r for r in rows if not holds(words(r["text"]))], set()


def test_stages_equal_brute_force(spark, folder):
    import sentencepiece

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], (plain_quality, plain_languages, plain_duplicates, plain_leaks), strict=True):
        rows, got = docs.collect(), stage(spark, docs, folder).collect()
        assert all(r[c] == f"own {c}" for r in got for c in KEPT), name
        if plain is plain_duplicates:
            groups = plain(spark, docs, folder, rows)
            assert len(got) == len(groups) < len(rows)
            left = keys(got)
            for group in groups.values():  # the row of the least id, rows without one last
                ids = [r["doc_id"] for r in group if r["doc_id"] is not None]
                mine = [k for k in left if k in keys(group)]
                assert mine and mine[0][0] == (min(ids) if ids else None)
        else:
            want, close = plain(spark, docs, folder, rows)
            certain = lambda x: [k for k in keys(x) if str(k[1]) not in close]  # noqa: E731, B023
            assert certain(got) == certain(want) and len(want) < len(rows), name
        docs = spark.createDataFrame(got, docs.schema)
        assert docs.columns == columns
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    want = sorted((str(r["doc_id"]), library.encode(r["text"] or ""), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded_sha256"]) for r in coded) == want


def test_clean_documents_stay_and_empty_tables_pass(spark, sf, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).where("doc_id in (7001)").count() == 1
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), folder).count() == 0, name
