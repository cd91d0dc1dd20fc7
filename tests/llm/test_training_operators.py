import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulon.llm import decontaminate, jaccard_join, language, licences, maxent_lm, quality, queries, rans_ids, sentencepieces, url_filter, vantage_points
from tabulon.llm.tables import components

ODD = [(-1, None), (-2, ""), (-3, "   \n\t"), (-4, "one"), (-5, "one"), (None, "a row without an id " * 3), (None, "a row without an id " * 3), (-6, "long " * 40_000), (-7, "日本語 ünï 😀" * 20), (-8, "x" * 5_000)]


@pytest.fixture(scope="module")
def docs(spark, sf):
    """The small table, with odd rows and columns whose names operators use themselves."""
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").where("length(text) < 20000")
    return table.unionByName(odd, allowMissingColumns=True).withColumn("score", F.lit("kept?")).withColumn("ids", F.lit(1)).withColumn("set_id", F.lit(0))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_components(rows, n=5, percent=75):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * (i := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - i):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)] += [i] if i is not None else []
    return sorted(((i, len(sets[k]), (i if not sets[k] else min(least[find(k)], default=None))) for k, (i, _) in enumerate(rows)), key=str)


def test_near_duplicates_equal_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = jaccard_join.near_duplicates(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows)


def test_near_duplicates_in_large_groups(spark, monkeypatch):
    """Groups of many near copies, some on the edge of the threshold, over several chunks of a block."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(3):
        base = list(rng.choice(words, 60))
        for i in range(90):
            own = base[:]
            for p in rng.choice(60, i % 3, replace=False):
                own[p] = f"e{g}-{i}-{p}"
            rows.append((g * 100 + i, " ".join(own)))
    monkeypatch.setattr(jaccard_join, "CHUNK", 16)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows)


def test_tree_bounds_lose_nothing():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(40):
        base = np.unique(rng.integers(0, 2**63, rng.integers(3, 1500)).astype(np.uint64))
        for share in (1.0, 0.95, 0.86, 0.7):
            sets.append(np.sort(base[: max(1, int(len(base) * share))]))
    n = np.array([len(s) for s in sets])
    edges = jaccard_join.connect_all(n, [jaccard_join._bitmap(s) for s in sets], 75, sets)
    parent = list(range(len(sets)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in edges:
        parent[find(a)] = find(b)
    want = list(range(len(sets)))
    find2 = lambda x: x if want[x] == x else find2(want[x])
    for a in range(len(sets)):
        for b in range(a):
            if 100 * (i := len(np.intersect1d(sets[a], sets[b]))) >= 75 * (n[a] + n[b] - i):
                want[find2(a)] = find2(b)
    assert all((find(a) == find(b)) == (find2(a) == find2(b)) for a in range(len(sets)) for b in range(a))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_sql_queries(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df, want = queries.queries()[name](spark, sf), con.sql(sql)
        at = [want.columns.index(c) for c in df.columns]
        assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_contamination(spark, docs):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again"), (2, "Short one"), (2, "Short one"), (3, None), (4, "?!"), (None, "short one")], "item_id long, text string")
    rows = [(1, "He said: the QUICK brown fox, jumps over the lazy dog! Short, one."), (2, "the quick brown fox jumps over the"), (3, None), (4, "a short one"), (4, "a short one")]
    got = sorted(tuple(r) for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).drop("text").collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    # the first text holds the first eight- and the second eight-word window of item 1: nine of its ten words
    assert got == [(1, 13, 11, 2, sha("1,2"), True), (2, 7, 0, 0, sha(""), False), (3, 0, 0, 0, sha(""), False), (4, 3, 2, 1, sha("2"), False), (4, 3, 2, 1, sha("2"), False)]
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated or n_hit > 0").count() == 0


def test_pieces_equal_the_library_and_decode(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    some = docs.where("doc_id is null or doc_id < 60")
    rows = sentencepieces.decode(sentencepieces.encode(some, queries.piece_model(), block=50_000), queries.piece_model()).collect()
    assert len(rows) == some.count()
    assert all(r["ids"] == library.encode(r["text"] or "") and r["decoded"] == (r["text"] or "") for r in rows)


def test_unigram_lattice(spark):
    class Toy:
        bpe, fallback, unknown, byte, longest = False, True, 0, [1000 + b for b in range(256)], 3
        rows = [(" ", 1, -2.0), ("a", 2, -2.0), ("b", 3, -2.0), ("ab", 4, -2.5), (" ab", 5, -6.0), ("ba", 6, -1.0)]

    got = {r["unit"]: r["ids"] for r in sentencepieces.encode_units(spark.createDataFrame([(" ab",), (" aba",), ("é",)], "unit string"), Toy).collect()}
    assert got == {" ab": [1, 4], " aba": [1, 2, 6], "é": [1000 + 0xC3, 1000 + 0xA9]}


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    from tabulon.llm.tables import new_path

    tokenizer = Tokenizer.from_file(queries.token_model())
    some = docs.where("doc_id is null or doc_id < 80").union(spark.createDataFrame([(-9, "x <|endoftext|> y's  z\n\n q"), (-9, "é è l'été　a\u0085 b")], "doc_id long, text string").selectExpr("doc_id", "text", "null", "null", "null", "null")).repartition(3)
    path = new_path(spark, "ids")
    rans_ids.write_ids(some, path, queries.token_model())
    rows = sorted(rans_ids.read_ids(spark, path).collect(), key=lambda r: r["start"])
    lowest = lambda i: -(2**63) if i is None else i
    want = sorted((lowest(r["doc_id"]), tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in some.collect())
    assert sorted((lowest(r["doc_id"]), r["ids"]) for r in rows) == want
    assert [lowest(r["doc_id"]) for r in rows] == [i for i, _ in want]
    assert all(r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1]]


def test_coder_checkpoints_and_frequencies(monkeypatch):
    monkeypatch.setattr(rans_ids, "CHECK", 5_000)
    rng = np.random.default_rng(2)
    for n in (1, 63, 20_000):
        ids = np.minimum(rng.geometric(0.01, n), 3_000).astype(np.uint32)
        freq = rans_ids.scaled(np.bincount(ids, minlength=4_000))
        assert freq.sum() == 1 << rans_ids.SCALE and (freq[ids] > 0).all()
        coder = rans_ids.Coder(freq)
        words, states, lanes, points = coder.encode(ids)
        assert (coder.decode(words, states, lanes, n) == ids).all() and (n < 20_000 or points)
        for token, word, at in points:
            assert (coder.decode(words, at, lanes, n, token, word) == ids[token:]).all()


def test_neighbours_exact_at_factor_one_and_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    more = spark.createDataFrame([(9000, None), (9001, [0.0] * 64), (9002, [float("nan")] * 64), (9003, [1.0] * 64), (9004, [1.0] * 64), (9005, [2.0] * 64), (9050, [1.0] * 64)], "vec_id long, embedding array<float>")
    both = rows.select("vec_id", "embedding").unionByName(more)
    table = [(r["vec_id"], np.array(r["embedding"], float)) for r in both.collect() if r["embedding"] is not None]
    table = [(i, v) for i, v in table if np.isfinite(v).all() and v.any()]
    ids, x = np.array([i for i, _ in table]), np.stack([v for _, v in table])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def truth(q):
        s = np.round(unit @ unit[ids == q][0], 12)
        s[ids == q] = -9
        return ids[np.lexsort((ids, -s))[:5]].tolist()

    asked = both.where("vec_id % 50 = 0")
    exact = defaultdict(list)
    for r in sorted(vantage_points.nearest(both, asked, factor=1.0, shard=100, block=4).collect(), key=lambda r: (r["query_id"], r["rank"])):
        exact[r["query_id"]].append(r["vec_id"])
    assert exact == {int(q): truth(q) for q in ids if q % 50 == 0}
    found = Counter((r["query_id"], r["vec_id"]) for r in vantage_points.nearest(both, asked, shard=100).collect())
    want = [(int(q), i) for q in ids if q % 50 == 0 for i in truth(q)]
    assert sum(w in found for w in want) >= 0.9 * len(want)
    assert vantage_points.nearest(both.where("false"), asked.where("false")).count() == 0


def test_tree_of_many_levels_prunes_and_finds():
    """Shards far above a leaf: exact at factor 1, also with ties and equal vectors; recall and work at 1.15."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 24))
    x = np.concatenate([centres[rng.integers(0, 60, 5000)] + 0.3 * rng.normal(size=(5000, 24)), np.repeat(centres[:5], 40, axis=0)])
    ids = rng.permutation(len(x)).astype(np.int64)
    tree = vantage_points.Tree.opened(vantage_points.Tree(ids, x, 5).closed())
    assert sum(n[1] is None for n in tree.nodes) > 30
    asked = np.unique(np.concatenate([np.arange(0, 5200, 40), np.arange(5000, 5005)]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def truth(a):
        s = np.round(unit @ unit[a], 12)
        s[a] = -9
        return ids[np.lexsort((ids, -s))[:5]].tolist()

    want = {int(ids[a]): truth(a) for a in asked}
    for factor, least in ((1.0, 1.0), (1.15, 0.95), (1.5, 0.9)):
        q, found, _ = tree.search(ids[asked], x[asked], 5, factor)
        got = defaultdict(list)
        for a, b in zip(q.tolist(), found.tolist(), strict=True):
            got[a].append(b)
        hits = sum(len(set(got[a]) & set(w)) for a, w in want.items()) / sum(map(len, want.values()))
        assert hits >= least
        if factor == 1.0:
            assert got == want


def test_quality_and_language_held_out(spark, sf):
    sf = sf.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op3_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) >= 0.95
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in queries.op4_language(spark, sf).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in rows]) >= 0.95


def test_classifiers_on_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 200)], "doc_id long, label int")
    scored = quality.score_quality(docs, quality.fit(docs, labels))
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.score_quality(empty, quality.fit(empty, labels)).count() == 0
    found = language.identify(docs, language.fit(docs))
    assert {r["doc_id"] for r in found.where("lang_pred = 'und'").collect()} == {-1, -2, -3}
    assert found.count() == docs.count() and language.identify(docs, language.fit(empty)).where("lang_pred <> 'und'").count() == 0


def test_language_model_counts(spark, docs, empty, monkeypatch):
    """Counts and both scores equal plain Python's, in one blob and part and in many."""
    some = docs.where("doc_id is null or doc_id < 60").withColumn("row", F.monotonically_increasing_id()).withColumn("blob", F.lit("kept")).withColumn("n_known", F.lit(-1)).cache()
    chosen = F.col("doc_id") % 3 != 0
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]
    rows, training = some.collect(), some.where(chosen).collect()
    c = Counter(w for r in training for w in tokens(r["text"]))
    pad = lambda t: [1, 2, *tokens(t)]
    after = Counter(tuple(p[i - 2 : i]) for r in training for p in [pad(r["text"])] for i in range(2, len(p)))
    three = Counter(tuple(p[i - 2 : i + 1]) for r in training for p in [pad(r["text"])] for i in range(2, len(p)))
    n, v = sum(c.values()), len(c)
    for blob, part in ((maxent_lm.BLOB, maxent_lm.PART), (20_000, 20_000)):
        monkeypatch.setattr(maxent_lm, "BLOB", blob)
        monkeypatch.setattr(maxent_lm, "PART", part)
        got = maxent_lm.score_texts(some, chosen)
        assert [c for c in got.columns if c not in ("n_tokens", "n_known", "train_tokens", "base_score", "score")] == [c for c in some.columns if c not in ("text", "n_known", "score")]
        found = {r["row"]: r for r in got.collect()}
        assert len(found) == len(rows)
        for r in rows:
            t, p, g = tokens(r["text"]), pad(r["text"]), found[r["row"]]
            assert g["blob"] == "kept" and (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
            assert math.isclose(g["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
            # the counts' share of the probability is a lower bound, the prior's whole mass an upper one
            low_, high = (sum(math.log10(max(1e-12, three[tuple(p[i - 2 : i + 1])] + q) / (after[tuple(p[i - 2 : i])] + maxent_lm.PRIOR)) for i in range(2, len(p))) for q in (0, maxent_lm.PRIOR))
            assert low_ <= g["score"] <= high
    assert maxent_lm.score_texts(empty, F.lit(True)).count() == 0
    assert maxent_lm.score_texts(some, F.lit(False)).where("n_known > 0 or train_tokens > 0 or score is null").count() == 0


def test_language_model_beats_word_counts_and_tells_repeats(spark, sf):
    rows = queries.op6_maxent_lm(spark, sf.replace("0.001", "0.01")).toPandas()
    rows["model"], rows["base"] = rows["score"] / rows["n_tokens"], rows["base_score"] / rows["n_tokens"]
    held = rows[rows["held_out"] & (rows["n_tokens"] > 20)]
    assert held["score"].sum() > 0.95 * held["base_score"].sum() and (held["model"] - held["base"]).median() > 0.05
    texts = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", F.xxhash64("text").alias("h")).toPandas()
    seen = rows[~rows["held_out"] & (rows["n_tokens"] > 20)].merge(texts, on="doc_id")
    twice = seen.groupby("h")["doc_id"].transform("count") > 1
    assert seen[twice]["model"].median() > seen[~twice]["model"].median() + 0.1


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(maxent_lm.ROWS, maxent_lm.CLASSES)).astype(np.float32)
    tokens, at = rng.integers(0, 2**63, 50).astype(np.uint64), np.array([0, 20, 20, 50])
    assert np.allclose(np.exp(maxent_lm.log_classes(weights, maxent_lm.contexts(tokens, at))).sum(1), 1, atol=1e-4)


def test_urls(spark):
    urls = ["http://a.Example.org/es/1", "https://example.org/en/17", "https://x.example.org/de/1?q", "http://m.site.com/fr/2", "http://m.site.com/de/2#x", "https://bestcasinowin.example.net/1", "https://adult-x.example.net/1", "https://thehelpblog.example.net/a", None, "no url", "http://notorg/x", "http://org", "http://org/"] + ["https://quietpage.example.net/en/%d" % i for i in range(60)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.fit(pages)).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1][2:] == ("example.org/en/1", "block") and got[2] == ("x.example.org", "/de/1", "org/", "allow")
    assert got[3][2:] == ("com/fr/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5][2:] == (None, "block") and got[6][2:] == (None, "block") and got[7][2:] == (None, "allow")
    assert got[8] == got[9] == ("", "", None, "allow") and got[10][2] is None and got[11] == ("org", "", None, "allow") and got[12][2] == "org/"
    assert url_filter.Lexicon({}).segment("casinoslots") == ["casino", "slots"]


def test_licences(spark, docs):
    rows = [(1, "Hello.\nReleased under the MIT License.\nBye."), (2, "Licensed under CC BY-NC 4.0."), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "The river was released under the bridge, version 2."), (5, None), (6, "Licensed under the Apache License, Version 2.0.\nAll rights reserved")]
    model = licences.fit(docs)
    got = {r["doc_id"]: (r["families"], [n["paragraph"] for n in r["notices"] if n["confirmed"]]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {1: (["mit"], [2]), 2: (["cc-by-nc"], [1]), 3: (["gpl"], [1]), 4: ([], []), 5: ([], []), 6: (["apache-2.0", "proprietary"], [1, 2])}


def test_licence_paragraphs_and_templates():
    """Paragraphs don't depend on where a text stands in its slice; a name or half of a sentence's word pairs confirm a family."""
    texts = ["Held, as we said,\n", "One line\ngoes on,\nHere too\nThere not", "", "\n", None, ",\n\nA"]

    def paragraphs(column):
        return [part[a:b].tobytes().decode() for _, _, part, _, starts, ends, _ in licences._paragraph_slices(pa.array(column, pa.string())) for a, b in zip(starts, ends, strict=True)]

    assert paragraphs(texts) == [p for t in texts for p in paragraphs([t])]
    assert sorted(paragraphs(texts[::-1])) == sorted(paragraphs(texts))
    assert paragraphs(texts)[:3] == ["held, as we said, ", "one line goes on, here too", "there not"]
    model = licences.Model(["The river runs by the old town."] * 3)

    def families(text):
        return [model.families[k] for (w,) in [licences._words([text])] for k in model.confirmations(w)]

    assert families("Code: the MIT License; texts: CC BY-SA 4.0.") == ["cc-by-sa", "mit"]
    assert families("This Source Code Form is subject to the rules of the house") == ["mpl-2.0"]
    assert families("This Source Code is ours") == families("") == families("license") == []


def test_licences_on_odd_rows(spark, empty):
    """No rows, no words and clashing columns: no notices, one row for each."""
    model = licences.fit(empty)
    assert licences.scan(empty, model).count() == 0
    rows = spark.createDataFrame([(1, None, 5, "x"), (2, "", 5, "x"), (3, "\n\n", 5, "x"), (3, "\n\n", 5, "x"), (4, "\nMIT License", 5, "x")], "doc_id long, text string, n_paragraphs int, h string")
    got = sorted((r["doc_id"], r["n_paragraphs"], r["families"], r["h"]) for r in licences.scan(rows, licences.fit(rows)).collect())
    assert got == [(1, 0, [], "x"), (2, 0, [], "x"), (3, 0, [], "x"), (3, 0, [], "x"), (4, 1, ["mit"], "x")]
