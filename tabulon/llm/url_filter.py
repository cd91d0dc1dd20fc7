"""URL filter: host segmentation by unigram Viterbi and a multinomial naive Bayes score.

Hosts and paths are cut at signs into runs of letters and digits; a run is segmented into the words of a lexicon with
the best product of unigram probabilities. The segmented words are scored by a multinomial naive Bayes classifier
whose classes are learned from URLs with a word of the seed lists (block) and from all others (allow). The lexicon and
the classes' word counts have no bound: the lexicon is broadcast as hashes, 16 bytes a word, and the weights of frequent
words are broadcast while the rest are joined. Rules of
host and path come first: a rule fits its host and all subdomains if the path starts with the rule's; the longest wins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import textbytes as tb
from tabulon.llm.tables import written

#: Words whose weights are broadcast, longest word, weight of a seed word's count, words of smoothing.
HEAD, LONGEST, SEED, SMOOTH = 100_000, 24, 50, 10

# Words of hosts and paths that a web corpus leaves out, and common words of other sites.
BLOCK_WORDS = """adult porn xxx sex nude casino casinos poker bet bets betting gambling slots jackpot lottery pills viagra
cialis pharma drugs cheap spam farm ads advert track tracker tracking clicks torrent warez crack keygen malware phishing
escort webcam cams dating win payday loans""".split()
ALLOW_WORDS = """the and news blog shop store wiki help docs home page site web www mail info data book books school
university library science music photo travel food health sport sports weather map maps forum article articles""".split()
#: A single one of these isn't enough: they also stand in harmless names.
WEAK = {"win", "farm", "free", "cheap", "ads", "track", "bet", "cams", "drugs"}

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def split_url(column: F.Column | str = "url") -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no `://`."""
    url = F.col(column) if isinstance(column, str) else column
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest) + 1), "^([^?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: F.Column, path: F.Column, rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def runs(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", text.lower())


class Lexicon:
    """Unigram log probabilities; a stretch outside the lexicon costs as a rare word and by its length."""

    def __init__(self, counts: dict[str, int]):
        counts = dict(counts)
        for w in (*BLOCK_WORDS, *ALLOW_WORDS):
            counts[w] = counts.get(w, 0) + SEED
        total = sum(counts.values())
        own = [w for w in counts if len(w) <= LONGEST]
        data, offsets = tb.buffers(pa.array(own, pa.string()))
        keys = tb.hashes(data, offsets[:-1], offsets[1:])
        order = np.argsort(keys)
        self.keys, self.cost = keys[order], -np.log(np.array([counts[w] for w in own])[order] / total)
        self.unknown = math.log(total) + 2
        self.letter = 1.0
        self.memo: dict[str, list[str]] = {}

    def segment(self, run: str) -> list[str]:
        """The words and unknown stretches of the best path."""
        if run in self.memo:
            return self.memo[run]
        data, offsets = tb.buffers(pa.array(list(run), pa.string()))
        j, back_by = np.divmod(np.arange(len(run) * LONGEST), LONGEST)  # the stretches that end at each letter, by length
        k = np.maximum(j - back_by, 0)
        found = tb.hashes(data, offsets[k], offsets[j + 1])
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        costs = np.where(self.keys[at] == found, self.cost[at], self.unknown + self.letter * (j + 1 - k)).reshape(-1, LONGEST).tolist()
        best, back = [0.0], [0]
        for j in range(1, len(run) + 1):
            cost, i = math.inf, j - 1
            for k in range(max(0, j - LONGEST), j):
                c = costs[j - 1][j - k - 1]
                if best[k] + c < cost:
                    cost, i = best[k] + c, k
            best.append(cost)
            back.append(i)
        words, j = [], len(run)
        while j:
            words.append(run[back[j] : j])
            j = back[j]
        if len(self.memo) < 100_000:
            self.memo[run] = words[::-1]
        return words[::-1]

    def words(self, host: str, path: str) -> list[str]:
        return ["h:" + w for r in runs(host) for w in self.segment(r)] + ["p:" + w for r in runs(path) for w in self.segment(r)]


def seeded(words: list[str]) -> bool:
    """Whether a URL's words are of the block class: one strong seed word, or two weak ones."""
    found = {w[2:] for w in words} & set(BLOCK_WORDS)
    return bool(found - WEAK) or len(found) > 1


class Bayes:
    """Multinomial naive Bayes, given (word, count in allow, count in block) of the most frequent words, both classes' totals over all words, and their URLs.

    Counts are smoothed by SMOOTH words of both classes' own mix, so a rare word of the larger class is no sign of the smaller.
    tail has the counts (w, a, b) of the other words, or is None if there are none.
    """

    def __init__(self, head: list[tuple[str, int, int]], totals: tuple[int, int], urls: dict[int, int], tail: DataFrame | None = None):
        self.totals, self.tail = totals, tail
        both = max(1, sum(totals))
        self.weight = {}
        for w, a, b in head:
            mix = SMOOTH * (a + b) / both
            self.weight[w] = math.log((b + mix) / (totals[1] + SMOOTH)) - math.log((a + mix) / (totals[0] + SMOOTH))
        self.prior = math.log(urls.get(1, 0) + 1) - math.log(urls.get(0, 0) + 1)

    def tail_weights(self) -> DataFrame:
        """w and weight of the other words."""
        mix = SMOOTH * (F.col("a") + F.col("b")) / F.lit(float(max(1, sum(self.totals))))
        return self.tail.select("w", (F.log((F.col("b") + mix) / float(self.totals[1] + SMOOTH)) - F.log((F.col("a") + mix) / float(self.totals[0] + SMOOTH))).alias("weight"))


def fit(pages: DataFrame) -> tuple[Lexicon, Bayes]:
    """Learn the lexicon from the runs of all URLs (those on several hosts) and the classes from all URLs."""
    host, path = split_url()
    names = pages.select(host.alias("host"), path.alias("path"))
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+)"), F.lit(1))
    runs_of = names.select("host", F.explode(F.concat(split(F.col("host")), split(F.col("path")))).alias("w")).where(F.length("w") <= LONGEST)
    # a name of one host alone is no word, but a name to be segmented
    counts = runs_of.groupBy("w", "host").count().groupBy("w").agg(F.sum("count").alias("c"), F.count(F.lit(1)).alias("hosts")).where("hosts > 1")
    known = counts.select("w", "c").toArrow()
    lexicon = Lexicon(dict(zip(known.column(0).to_pylist(), known.column(1).to_pylist(), strict=True)))
    shared = pages.sparkSession.sparkContext.broadcast(lexicon)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        found: dict[tuple[int, str], int] = {}
        for batch in batches:
            for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = lexicon.words(h, p)
                k = int(seeded(words))
                for w in [*words, ""]:  # the empty word counts URLs
                    found[k, w] = found.get((k, w), 0) + 1
            if len(found) > 200_000:
                yield pa.RecordBatch.from_pylist([{"k": k, "w": w, "n": n} for (k, w), n in found.items()], schema=_CLASS)
                found = {}
        yield pa.RecordBatch.from_pylist([{"k": k, "w": w, "n": n} for (k, w), n in found.items()], schema=_CLASS)

    one = lambda k: F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0))
    rows = written(names.mapInArrow(classes, "k int, w string, n long").groupBy("w").agg(one(0).alias("a"), one(1).alias("b")), "url-words")
    urls = next(({0: r["a"], 1: r["b"]} for r in rows.where("w = ''").collect()), {})
    words = rows.where("w <> ''")
    n, *totals = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    head = [tuple(r) for r in words.orderBy((F.col("a") + F.col("b")).desc(), "w").limit(HEAD).collect()]
    tail = None
    if n > HEAD:
        least, last = head[-1][1] + head[-1][2], head[-1][0]
        tail = words.where((F.col("a") + F.col("b") < least) | ((F.col("a") + F.col("b") == least) & (F.col("w") > last)))
    return lexicon, Bayes(head, tuple(totals), urls, tail)


_CLASS = pa.schema([("k", pa.int32()), ("w", pa.string()), ("n", pa.int64())])


def judge(pages: DataFrame, model: tuple[Lexicon, Bayes], rules=RULES) -> DataFrame:
    """pages with host, path, rule, verdict, words and score, which replace columns of these names.

    verdict is the longest fitting rule's, else block if the log odds of the block class (score) are above 0, else
    allow. A null or empty url, or one without `://`, has empty host and path, no words, and the verdict of the prior alone, which is allow unless
    most URLs are blocked. Repeated rows are judged alike.
    """
    bayes = model[1]
    shared = pages.sparkSession.sparkContext.broadcast((model[0], bayes.weight, bayes.prior))
    pages = pages.drop("host", "path", "rule", "verdict", "words", "score")
    host, path = split_url()
    pages = pages.withColumns({"host": host, "path": path})
    tailed = bayes.tail is not None
    extra = [F.lit(0).cast("long").alias("__row"), F.array(F.lit("")).alias("__tail")] if tailed else []
    schema = pages.select("*", F.array(F.lit("")).alias("words"), F.lit(0.0).alias("score"), *extra).schema
    h, p = pages.columns.index("host"), pages.columns.index("path")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weight, prior = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            words = [lexicon.words(a, b) for a, b in zip(batch.column(h).to_pylist(), batch.column(p).to_pylist(), strict=True)]
            scores = np.array([prior + sum(weight.get(x, 0.0) for x in w) for w in words], float)
            more = [pa.array(row + np.arange(len(words))), pa.array([[x for x in w if x not in weight] for w in words], pa.list_(pa.string()))] if tailed else []
            row += len(words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([[x[2:] for x in w] for w in words], pa.list_(pa.string())), pa.array(scores), *more], names=schema.names)

    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    out = pages.mapInArrow(score, schema)
    if tailed:
        out = written(out, "url-scores")
        rest = out.select("__row", F.explode("__tail").alias("w")).join(bayes.tail_weights(), "w").groupBy("__row").agg(F.sum("weight").alias("__rest"))
        out = out.join(rest, "__row", "left").withColumn("score", F.col("score") + F.coalesce("__rest", F.lit(0.0))).drop("__row", "__tail", "__rest")
    return out.withColumns({"rule": rule, "verdict": F.coalesce(verdict, method)})
