"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Lexicon. Words and word beginnings of 4, 5 and 6 bytes that toxic training rows hold at eight times the odds of
clean ones or more, beyond chance (likelihood ratio of 16 or more). Near copies among the training rows count
once: rows with the same smallest shingle hash and label are one. Forms of a stem that training rows do not
hold still match by their beginning. For training, each half of the rows is looked up in the lexicon of the other half,
so words that mark their own rows only earn no trust; scoring uses the lexicon of both.

Features of a text: densities of the lexicon, plain and with look-alike characters read as letters; hits near
a second-person pronoun; capitals, punctuation, obfuscation and length. Neither label, language, source nor
id enters a score.

Fit. Labels come from rows whose crc32 of the id is not divisible by 5 (``held_out`` rows). At most about
``max_rows`` of them, picked by a hash of the id, are joined with their texts; that is the only shuffle of
texts. Trees fitted on each half judge the other half, and those scores calibrate the trees fitted on all.

How it scales. Scoring is a map over documents. The lexicon holds every word and
beginning of the labelled sample that passes both thresholds, so ``max_rows`` alone bounds it.

Edge cases. Null and empty texts are scored like a text without words. Without training rows of both classes
every score is the share of toxic rows (0 without any). A row without a doc_id is not held out. Repeated
labels of one document count each; null labels are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F, types as T

from . import spans as S
from .common import kept, register, table

#: Second-person pronouns of the languages at hand.
SECOND_PERSON = ("you your yours yourself u ur ya du dich dir dein deine deiner deinem ihr euch euer "
                 "tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro").split()
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_ALIKE = _PLAIN.copy()
for _a, _b in zip(b"013457@$!|*", b"oieastasili"):
    _ALIKE[_a] = _b
_STARTS = (4, 5, 6)
_NEAR = 5
N_FEATURES = 19


def _runs(mapped: np.ndarray, offsets) -> S.Spans:
    """Maximal runs of letters, after a map of bytes, within each text."""
    return S.words(np.where(_LETTER[mapped], mapped, np.uint8(32)), offsets)


def _keys(spans: S.Spans) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings; a word that is too short for one has 0 there."""
    base = S._TEXT
    pre = base.prefix(S._BYTE[spans.data])
    size = spans.end - spans.start
    out = [S.mix(base.span(pre, spans.start, spans.end) + size.astype(np.uint64))]
    for k in _STARTS:
        long = size >= k
        h = np.zeros(len(size), np.uint64)
        at = spans.start[long]
        h[long] = S.mix(base.span(pre, at, at + k) ^ np.uint64(0xBE61 + k))
        out.append(h)
    return out


def _pronouns() -> np.ndarray:
    raw = [w.encode() for w in SECOND_PERSON]
    offsets = np.cumsum([0, *map(len, raw)])
    return np.unique(_keys(S.words(np.frombuffer(b"".join(raw), np.uint8), offsets))[0])


def features(data, offsets, lexicon: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """One row of ``N_FEATURES`` numbers for each text; lexicon is sorted."""
    docs = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)

    def rate(flags):
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[offsets]) / size

    def hits(spans):
        best = np.zeros(len(spans.start))
        if len(lexicon):
            for h in _keys(spans):
                at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
                best = np.maximum(best, np.where(lexicon[at] == h, odds[at], 0))
        return best
    plain = _runs(_PLAIN[data], offsets)
    alike = _runs(_ALIKE[data], offsets)
    doc, n = plain.text, np.maximum(plain.counts, 1)
    per = lambda x: np.bincount(doc, x, docs) / n
    weight = hits(plain)
    hit = weight > 0
    masked = np.bincount(alike.text, hits(alike) > 0, docs) - np.bincount(doc, hit, docs)
    you = S.member(_keys(plain)[0], _pronouns())
    reach = np.zeros(len(you) + 1, np.int64)
    np.cumsum(you, out=reach[1:])
    lo = np.maximum(np.arange(len(you)) - _NEAR, plain.first[doc])
    hi = np.minimum(np.arange(len(you)) + _NEAR + 1, plain.first[doc + 1])
    close = hit & (reach[hi] > reach[lo])
    most = np.zeros(docs)
    np.maximum.at(most, doc, weight)
    upper = (data >= 65) & (data < 91)
    caps = np.zeros(len(data) + 1, np.int64)
    np.cumsum(upper, out=caps[1:])
    shout = (caps[plain.end] - caps[plain.start] == plain.end - plain.start) & (plain.end - plain.start > 2)
    digit = (data >= 48) & (data < 58)
    punct = (data > 32) & (data < 127) & ~_LETTER[data] & ~digit
    inner = np.zeros(len(data), bool)
    inner[1:-1] = _LETTER[data[:-2]] & _LETTER[data[2:]] & ~_LETTER[data[1:-1]] & (data[1:-1] > 32) & (data[1:-1] != 39)
    again = np.zeros(len(data), bool)
    again[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & (data[2:] > 32)
    return np.stack([
        np.log1p(plain.counts), per(hit), np.log1p(np.bincount(doc, hit, docs)), per(weight), most,
        np.bincount(doc, weight > 3, docs), np.maximum(masked, 0) / n, np.log1p(np.maximum(masked, 0)), per(you), per(close),
        np.log1p(np.bincount(doc, close, docs)), rate(upper), per(shout), rate(data == 33), rate(data == 63), rate(punct),
        rate(digit), rate(inner), rate(again)], axis=1)


def _train_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """doc_id, toxic, part (remainder of the crc) and text of the bounded sample, near copies once."""
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    marked = labels.where("toxic is not null and doc_id is not null").select("doc_id", "toxic", part.alias("part")).where("part <> 0")
    n = max(1, marked.count())
    least = (1 << 63) - 1 if n <= max_rows else (max_rows << 63) // n
    chosen = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 1) <= F.lit(least)
    rows = marked.where(chosen).join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(chosen), "doc_id")

    def work(batches):
        for b in batches:
            low = []
            for _, _, data, offsets in S.chunks(b.column("text")):
                spans = S.words(data, offsets)
                h, at = spans.hashes(lower=True), S.windows(spans, 5)
                least = np.full(len(offsets) - 1, (1 << 64) - 1, np.uint64)
                np.minimum.at(least, spans.text[at], S.gram_hashes(h, at, 5))
                short = spans.counts < 5
                least[short] = S.gram_hashes(h, spans.first[:-1][short], spans.counts[short])
                low.append(least)
            low = np.concatenate(low).view(np.int64) if low else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low)], [*b.schema.names, "low"])
    rows = rows.mapInArrow(work, "doc_id bigint, toxic int, part bigint, text string, low bigint")
    pick = rows.groupBy("low", "toxic").agg(F.min_by(F.struct("doc_id", "part", "text"), F.struct("doc_id", "text")).alias("r"))
    return kept(pick.select("toxic", "r.doc_id", "r.part", "r.text"), "toxic-train")


def _counts(train: DataFrame) -> DataFrame:
    """key, half, a, c: in how many toxic and clean rows of each half a word or beginning occurs."""
    def work(batches):
        for b in batches:
            toxic, half = (b.column(c).to_numpy(zero_copy_only=False) for c in ("toxic", "half"))
            for at, _, data, offsets in S.chunks(b.column("text"), 1 << 22):
                spans = _runs(_PLAIN[data], offsets)
                keys, doc = np.concatenate(_keys(spans)), np.tile(spans.text, 1 + len(_STARTS))
                doc, keys = doc[keys != 0], keys[keys != 0]
                order = np.lexsort((doc, keys))
                keys, doc = keys[order], doc[order]
                once = np.ones(len(keys), bool)
                once[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
                keys, doc = keys[once], doc[once]
                for h in (0, 1):
                    own = half[at + doc] == h
                    k, bad = keys[own], toxic[at + doc[own]].astype(np.int64)
                    heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
                    total = np.diff(np.r_[heads, len(k)])
                    bad = np.add.reduceat(bad, heads) if len(heads) else heads
                    yield pa.RecordBatch.from_arrays([pa.array(k[heads].view(np.int64)), pa.array(np.full(len(heads), h), pa.int32()),
                                                      pa.array(bad), pa.array(total - bad)], ["key", "half", "a", "c"])
    rows = train.select("toxic", F.when(F.col("part") <= 2, 0).otherwise(1).alias("half"), "text")
    return kept(rows.mapInArrow(work, "key bigint, half int, a bigint, c bigint").groupBy("key", "half")
                .agg(F.sum("a").alias("a"), F.sum("c").alias("c")).where("a + c > 1"), "toxic-words")


def _lexicon(counts: DataFrame, rows: dict, halves: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of words and beginnings, and their log odds, as the given halves of the rows tell."""
    bad, good = (sum(n for (h, y), n in rows.items() if h in halves and y == k) + 1 for k in (1, 0))
    odds = F.log((F.col("a") + 0.5) / bad) - F.log((F.col("c") + 0.5) / good)
    every = F.col("a") + F.col("c")
    ratio = 2 * sum(F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) * (bad + good) / (every * n))).otherwise(0.0)
                    for k, n in (("a", bad), ("c", good)))
    found = (counts.where(F.col("half").isin(*halves)).groupBy("key").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
             .withColumn("odds", odds).withColumn("ratio", ratio).where(F.col("odds") >= float(np.log(8))).where("ratio >= 16")
             .select("key", "odds").collect())
    keys = np.array([r["key"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["odds"] for r in found])[order]


def _featured(rows: DataFrame, carry: list[str], lexicon) -> DataFrame:
    """The carried columns and the features of ``text``."""
    words, odds = lexicon
    column = "text" if "text" in carry else "__text"

    def work(batches):
        for b in batches:
            for lo, hi, data, offsets in S.chunks(b.column(column), 1 << 18):
                flat = features(data, offsets, words, odds).ravel()
                f = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * N_FEATURES, pa.int32()), pa.array(flat))
                own = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in carry), f], [*carry, "__features"])
    fields = [*(rows.schema[c] for c in carry), T.StructField("__features", T.ArrayType(T.DoubleType()))]
    rows = rows.select(*carry) if "text" in carry else rows.select(*carry, F.col("text").alias("__text"))
    return rows.mapInArrow(work, T.StructType(fields))


class Toxicity:
    """A fitted scorer."""

    def __init__(self, lexicon, trees, steps, share: float):
        self.lexicon, self.trees, self.steps, self.share = lexicon, trees, steps, share

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> "Toxicity":
        train = _train_rows(docs, labels, max_rows)
        words = _counts(train)
        n = {(r["half"], r["toxic"]): r["count"] for r in train.groupBy(F.when(F.col("part") <= 2, 0).otherwise(1).alias("half"), "toxic").count().collect()}
        lexicon, first, second = (_lexicon(words, n, h) for h in ((0, 1), (0,), (1,)))
        columns = ["doc_id", "toxic", "part", "text"]
        rows = kept(_featured(train.where("part <= 2"), columns, second).unionByName(
            _featured(train.where("part > 2"), columns, first)).drop("text"), "toxic-features")
        counts = {0: 0, 1: 0} | {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        share = counts[1] / max(1, counts[0] + counts[1])
        if not counts[0] or not counts[1]:
            return cls(lexicon, None, None, share)
        rows = rows.withColumn("features", array_to_vector("__features")).withColumn("label", F.col("toxic").cast("double")).orderBy("doc_id")
        grow = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.4, seed=5, maxBins=64)
        halves = [rows.where("part <= 2"), rows.where("part > 2")]
        if any(h.select("label").distinct().count() < 2 for h in halves):
            halves = [rows, rows]  # too few rows to judge one half by the other
        judged = [grow.fit(one.select("features", "label")).transform(two.select("features", "label")) for one, two in (halves, halves[::-1])]
        judged = judged[0].unionByName(judged[1]).select(vector_to_array("probability")[1].alias("p"), "label")
        steps = IsotonicRegression(featuresCol="p").fit(judged)
        trees = grow.fit(rows.select("features", "label"))
        return cls(lexicon, trees, steps, share)

    def score(self, docs: DataFrame, carry: list[str]) -> DataFrame:
        """The carried columns, ``score`` from 0 to 1 and ``predicted`` (1 from 0.5 on)."""
        if self.trees is None:
            scored = docs.select(*carry, F.lit(float(self.share)).alias("score"))
        else:
            rows = _featured(docs, carry, self.lexicon).withColumn("__vector", array_to_vector("__features"))
            trees = self.trees.copy({self.trees.featuresCol: "__vector", self.trees.predictionCol: "__p1",
                                     self.trees.probabilityCol: "__p2", self.trees.rawPredictionCol: "__p3"})
            rows = trees.transform(rows).withColumn("__p", vector_to_array("__p2")[1])
            steps = self.steps.copy({self.steps.featuresCol: "__p", self.steps.predictionCol: "__score"})
            scored = steps.transform(rows).select(*carry, F.least(F.lit(1.0), F.greatest(F.lit(0.0), "__score")).alias("score"))
        return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@register("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = Toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return model.score(docs, ["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted")
