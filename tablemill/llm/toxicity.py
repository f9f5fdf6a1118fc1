"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and word beginnings that labelled toxic texts hold far more often than others, each with its
log odds. A text becomes a dozen dense features: densities of lexicon words and beginnings, hits near a second-person
pronoun, capitals, punctuation, and obfuscation (``1d10t``, ``i.d.i.o.t`` are read plainly as well). Trees are trained on
features that use a lexicon from the other half of the training rows, so no row sees a term that it taught. A further
slice of the labelled rows calibrates the trees' probability.

Only labels teach, and never those of held-out rows; labels, language, source and id are no inputs of a score. Fitting
takes at most ``SAMPLE`` labelled rows (the smallest by hash of their id); scoring covers every whole text in one pass.

Defined results: null and empty texts have all features at zero and a score; texts of any length are read whole; equal
texts get equal scores; rows repeated in full are scored each; without labels of both classes every score is the share of
toxic labels (0 without labels); an empty table gives an empty result; other columns pass
through, unless they have the name of a new one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.llm.units import slices
from tablemill.session import work_path

SAMPLE = 12_000
TERMS = 600
LEAST_HITS = 3
LEAST_Z = 5.0
NEAR = 6

# Second-person pronouns of the languages that are covered.
SECOND = frozenset("you your yours yourself du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos "
                   "tú ti tus usted ustedes vosotros contigo".split())
WORD = re.compile(r"[^\W\d_]+")
LEET = str.maketrans("013457@$!|", "oieastasii")
NOISE = re.compile(r"[\W\d_]+")
SHOUT = re.compile(r"!|\?")
RUNS = re.compile(r"[!?.]{2,}")

FEATURES = ["word_rate", "stem_rate", "hidden_rate", "distinct", "weight", "weight_rate", "near_you", "you_rate",
            "capitals", "shouted", "marks", "runs", "mixed", "log_words"]


def terms(word: str) -> list[str]:
    """A word and its beginnings of four to six letters, as lexicon keys."""
    return [word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) > n)]


def _hidden(text: str) -> list[str]:
    """Obfuscated tokens of a lower-case text, read plainly."""
    out = []
    for token in text.split():
        if not token.isalpha():
            core = token.strip(".,;:!?\"'()[]«»„“”*")
            if core and not core.isalpha() and any(c.isalpha() for c in core):
                out.append(NOISE.sub("", core.translate(LEET)))
    return out


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    text = text or ""
    low = text.lower()
    words, hidden = WORD.findall(low), _hidden(low)
    count = max(1, len(words))
    exact, stems, found, you, at = 0, 0, {}, [], []
    for i, word in enumerate(words):
        if word in lexicon:
            exact += 1
            found[word] = lexicon[word]
            at.append(i)
        else:
            for n in (6, 5, 4):
                key = f"{word[:n]}-"
                if len(word) > n and key in lexicon:
                    stems += 1
                    found[key] = lexicon[key]
                    at.append(i)
                    break
        if word in SECOND:
            you.append(i)
    veiled = 0
    for word in hidden:
        keys = [t for t in terms(word) if t in lexicon]
        if keys:
            veiled += 1
            found[keys[0]] = lexicon[keys[0]]
    near, k = 0, 0
    for i in at:
        while k < len(you) and you[k] < i - NEAR:
            k += 1
        near += k < len(you) and you[k] <= i + NEAR
    letters = sum(map(len, words)) or 1
    capitals = sum(map(str.isupper, text))
    shouted = sum(1 for w in text.split() if len(w) > 2 and w.isupper())
    weight = sum(found.values())
    return [100 * exact / count, 100 * stems / count, 100 * veiled / count, float(len(found)), weight,
            100 * weight / count, 100 * near / count, 100 * len(you) / count, capitals / letters, shouted / count,
            len(SHOUT.findall(text)) / count, len(RUNS.findall(text)) / count, len(hidden) / count, math.log1p(len(words))]


def _measure(lexicons: dict[int, dict[str, float]], carry: list[str], text: str, fold: str | None) -> Callable:
    """The carried columns and the features; the fold picks the lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for part in slices(iter([batch]), names.index(text)):
                texts = part.column(names.index(text)).to_pylist()
                folds = part.column(names.index(fold)).to_pylist() if fold else [0] * len(texts)
                rows = [features(t, lexicons[f]) for f, t in zip(folds, texts)]
                values = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(FEATURES))]
                yield pa.RecordBatch.from_arrays([*[part.column(names.index(c)) for c in carry], *values],
                                                 names=[*carry, *FEATURES])
    return run


def _measured(df: DataFrame, lexicons: dict[int, dict[str, float]], carry: list[str], text: str, fold: str | None) -> DataFrame:
    """``carry`` and the features; other columns are not even read."""
    needed = list(dict.fromkeys([*carry, text, *([fold] if fold else [])]))
    schema = T.StructType([*[df.schema[c] for c in carry], *[T.StructField(f, T.DoubleType()) for f in FEATURES]])
    return df.select(*needed).mapInArrow(_measure(lexicons, carry, text, fold), schema)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts per term, fold and label, summed per task (the rows are a bounded sample)."""
    seen: Counter = Counter()
    for batch in batches:
        for fold, text, toxic in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
            low = (text or "").lower()
            keys = {t for w in {*WORD.findall(low), *_hidden(low)} if len(w) > 2 for t in terms(w)}
            seen.update((k, fold, toxic) for k in keys)
    if seen:
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen], pa.int32()),
             pa.array([k[2] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())],
            names=["term", "fold", "toxic", "n"])


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def _lexicon(counts: DataFrame, folds: list[int], toxic: int, clean: int) -> dict[str, float]:
    """At most ``TERMS`` terms that toxic texts of these folds favour, with their log odds."""
    if not toxic or not clean:
        return {}
    base = toxic / (toxic + clean)
    sums = counts.where(F.col("fold").isin(folds)).groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("q"))
    z = (F.col("p") - (F.col("p") + F.col("q")) * base) / F.sqrt((F.col("p") + F.col("q")) * base * (1 - base))
    top = sums.where(F.col("p") >= LEAST_HITS).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(
        F.desc("z"), "term").limit(TERMS).collect()
    return {r.term: math.log((r.p + 0.5) / (toxic + 1)) - math.log((r.q + 0.5) / (clean + 1)) for r in top}


class Scorer:
    """Fits on the labelled part of a table and scores any table."""

    def __init__(self, docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 7):
        spark = docs.sparkSession
        taught = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy(
            "doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        chosen = taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        # folds 1 and 2 teach terms and trees, fold 3 calibrates
        slot = F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string"))) % 5
        rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").select(
            "doc_id", F.when(slot < 2, 1).when(slot < 4, 2).otherwise(3).alias("fold"), "text", "toxic")
        path = work_path(spark, "taught")
        rows.write.parquet(path)
        rows = spark.read.parquet(path)
        sizes = {(r.fold, r.toxic): r.n for r in rows.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        toxic, all_ = sum(n for (_, t), n in sizes.items() if t == 1), sum(sizes.values())
        self.rate = toxic / all_ if all_ else 0.0
        self.model = self.calibration = None
        self.lexicon: dict[str, float] = {}
        if not all(sizes.get((f, t)) for f in (1, 2) for t in (0, 1)):
            return

        path = work_path(spark, "terms")
        rows.where("fold < 3").mapInArrow(_count, "term string, fold int, toxic int, n bigint").groupBy(
            "term", "fold", "toxic").agg(F.sum("n").alias("n")).write.parquet(path)
        counts = spark.read.parquet(path)
        lexicons = {f: _lexicon(counts, folds, sum(sizes.get((k, 1), 0) for k in folds), sum(sizes.get((k, 0), 0) for k in folds))
                    for f, folds in ((1, [2]), (2, [1]), (3, [1, 2]))}
        self.lexicon = lexicons[3]
        path = work_path(spark, "measured")
        # a bounded table: one ordered file makes the fit the same every time
        _measured(rows, lexicons, ["doc_id", "fold", "toxic"], "text", "fold").repartition(1).sortWithinPartitions("doc_id").write.parquet(path)
        measured = self._assemble(spark.read.parquet(path))
        trees = GBTClassifier(featuresCol="features", labelCol="toxic", maxIter=40, maxDepth=3, stepSize=0.15,
                              minInstancesPerNode=3, seed=seed, cacheNodeIds=False)
        self.model = trees.fit(measured.where("fold < 3"))
        if sizes.get((3, 0)) and sizes.get((3, 1)):
            raw = self._raw(measured.where("fold = 3")).select("raw", F.col("toxic").cast("double").alias("toxic"))
            self.calibration = IsotonicRegression(featuresCol="raw", labelCol="toxic", predictionCol="calibrated").fit(raw)

    @staticmethod
    def _assemble(df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)

    def _raw(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).withColumn("raw", vector_to_array("probability")[1])

    def score(self, docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
        """The carried columns (all) of every row, ``score``, ``predicted`` and the features.

        A carried column with one of these names gives way to the new one.
        """
        new = {"score", "predicted", "features", "raw", "calibrated", "rawprediction", "probability", "prediction", *FEATURES}
        carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new]
        measured = _measured(docs, {0: self.lexicon}, carry, text, None)
        if self.model is None:
            scored = measured.withColumn("score", F.lit(self.rate))
        else:
            scored = self._raw(self._assemble(measured))
            if self.calibration is None:
                scored = scored.withColumn("score", F.col("raw"))
            else:
                # the calibrated steps keep the order of the trees inside a step
                scored = self.calibration.transform(scored).withColumn(
                    "score", F.col("calibrated") * 0.999 + F.col("raw") * 0.001)
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
        return scored.select(*carry, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), *FEATURES)
