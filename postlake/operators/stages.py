"""Spark ML stages: normalisation, softmax classifier, decision ladder and a bigram classifier, for use in a Pipeline.

Every stage keeps the rows and columns it gets, and saves and loads alone or within a pipeline.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizerModel, IndexToString, Normalizer, SQLTransformer, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol, HasProbabilityCol, HasThreshold
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions import rules as RU
from postlake.functions import text as X
from postlake.operators import classifier as CL
from postlake.operators import vectors as V
from postlake.plans.cut import cut

QUERIES: dict = {}
ORACLE: dict = {}


class TextNormalizer(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The whole text chain of inputCol in outputCol; null counts as empty."""

    @keyword_only
    def __init__(self, *, inputCol: str = "text", outputCol: str = "normalised"):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="normalised")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        plain = dataset.withColumn("_plain", X.nfkd_unescape(F.coalesce(F.col(self.getInputCol()), F.lit(""))))
        return X.normalised(plain, "_plain", self.getOutputCol()).drop("_plain")


class RuleLadder(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """final_label, final_conf, reason and low_confidence from text, context (null where there is no such column),
    and base_label and base_conf."""

    @keyword_only
    def __init__(self):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if "context" in dataset.columns:
            return RU.decide(dataset)
        return RU.decide(dataset.withColumn("context", F.lit(None).cast("string"))).drop("context")


class _ClassifierParams(HasInputCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasThreshold):
    """inputCol text, labelCol its class as a string, predictionCol the class told, probabilityCol a vector in the
    order of the classes, threshold the confidence below which ``fallbackCol`` is true."""

    fallbackCol = Param(Params._dummy(), "fallbackCol", "column that says that another classifier is to be asked", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(inputCol="text", labelCol="label", predictionCol="prediction", probabilityCol="probability", threshold=0.6, fallbackCol="fallback_required")

    def _told(self, df: DataFrame, confidence: str) -> DataFrame:
        text = F.coalesce(F.col(self.getInputCol()), F.lit(""))
        return df.withColumn(self.getOrDefault("fallbackCol"), (F.col(confidence) < self.getThreshold()) | F.contains(text, F.lit("_sarcasm_tag_")))


class SoftmaxClassifier(Estimator, _ClassifierParams, DefaultParamsReadable, DefaultParamsWritable):
    """``classifier.fit`` as an Estimator; idCol names each row once."""

    idCol = Param(Params._dummy(), "idCol", "column that names each row once", TypeConverters.toString)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "most tokens of the vocabulary", TypeConverters.toInt)
    balanced = Param(Params._dummy(), "balanced", "every class weighs the same in all", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCol="text", labelCol="label", predictionCol="prediction", probabilityCol="probability", idCol="doc_id", maxFeatures=40000, balanced=False, threshold=0.6):
        super().__init__()
        self._setDefault(idCol="doc_id", maxFeatures=40000, balanced=False)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SoftmaxClassifierModel:
        g = self.getOrDefault
        rows = dataset.select(F.col(g("idCol")).alias("doc_id"), F.col(self.getInputCol()).alias("text"), F.col(self.getLabelCol()).alias("label"))
        made = SoftmaxClassifierModel(CL.fit(rows, max_features=g("maxFeatures"), balanced=g("balanced")))
        return self._copyValues(made)


class SoftmaxClassifierModel(Model, _ClassifierParams, MLReadable, MLWritable):
    """Adds prediction, probability, base_label, base_conf and the fallback flag; saved as parameters and one table."""

    def __init__(self, model: CL.SoftmaxModel | None = None):
        super().__init__()
        self.model = model

    @property
    def classes(self) -> tuple[str, ...]:
        return self.model.classes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = CL.with_base(dataset, self.getInputCol(), self.model, self.classes)
        p = [f"base_p_{k}" for k in self.classes]
        x = x.withColumn(self.getProbabilityCol(), array_to_vector(F.array(*map(F.col, p)))).withColumn(self.getPredictionCol(), F.col("base_label")).drop(*p)
        return self._told(x, "base_conf")

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, stage: SoftmaxClassifierModel):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.model.save(self.sparkSession, f"{path}/model")


class _ModelReader(MLReader):
    def load(self, path: str) -> SoftmaxClassifierModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = SoftmaxClassifierModel(CL.load(self.sparkSession, f"{path}/model"))
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


class ClassWeights(Estimator, HasLabelCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Rows / (classes * rows of the class) in outputCol, so that every class weighs the same in all."""

    @keyword_only
    def __init__(self, *, labelCol="label", outputCol="weight"):
        super().__init__()
        self._setDefault(labelCol="label", outputCol="weight")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        label, out = self.getLabelCol(), self.getOutputCol()
        counts = dataset.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("k")).count().collect()  # one row a class
        total = sum(r["count"] for r in counts)
        quoted = lambda k: "'" + k.replace("\\", "\\\\").replace("'", "\\'") + "'"
        arms = " ".join(f"WHEN {quoted(r.k)} THEN {total / (len(counts) * r['count'])!r}D" for r in sorted(counts))
        made = f"CASE CAST(`{label}` AS STRING) {arms} ELSE 0.0D END" if arms else "0.0D"
        return SQLTransformer(statement=f"SELECT *, {made} AS `{out}` FROM __THIS__")


class BigramClassifier(Estimator, _ClassifierParams, DefaultParamsReadable, DefaultParamsWritable):
    """The other classifier: words and word pairs, 1 + log of their counts by idf, every class with the same weight,
    multinomial logistic regression. Built of Spark's own stages; ``frequent_terms`` finds the vocabulary.

    Rows without a label are left out of the fit."""

    maxFeatures = Param(Params._dummy(), "maxFeatures", "most terms of the vocabulary", TypeConverters.toInt)
    minDF = Param(Params._dummy(), "minDF", "rows that a term is in at least", TypeConverters.toFloat)
    inverseReg = Param(Params._dummy(), "inverseReg", "inverse strength of regularisation over all rows", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol="text", labelCol="label", predictionCol="prediction", probabilityCol="probability", maxFeatures=15000, minDF=2.0, inverseReg=1.5, threshold=0.6):
        super().__init__()
        self._setDefault(maxFeatures=15000, minDF=2.0, inverseReg=1.5)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> BigramClassifierModel:
        g, text = self.getOrDefault, self.getInputCol()
        rows = dataset.where(F.col(self.getLabelCol()).isNotNull()).select(F.col(text).alias("_text"), F.col(self.getLabelCol()).cast("string").alias("_label"))
        n = rows.count()
        if n == 0:
            raise ValueError("no row has a label")
        index = StringIndexer(inputCol="_label", outputCol="_index", stringOrderType="alphabetAsc").fit(rows)
        weights = ClassWeights(labelCol="_label", outputCol="_weight").fit(rows)
        words = SQLTransformer(statement=r"SELECT *, array_remove(split(lower(coalesce(_text, '')), '[^\\p{L}\\p{N}_]+'), '') AS _words FROM __THIS__")
        pairs = SQLTransformer(statement="SELECT *, zip_with(slice(_words, 1, greatest(size(_words) - 1, 0)), slice(_words, 2, size(_words)), (a, b) -> concat(a, ' ', b)) AS _pairs FROM __THIS__")
        both = SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__")
        terms = PipelineModel(stages=[words, pairs, both])
        count = CountVectorizerModel.from_vocabulary(frequent_terms(words.transform(rows).select("_words"), g("maxFeatures"), g("minDF") if g("minDF") >= 1 else g("minDF") * n), inputCol="_terms", outputCol="_counts")
        # all that follows reads these counts, not the texts
        counted = cut(weights.transform(index.transform(count.transform(terms.transform(rows)))).select("_index", "_weight", "_counts"))
        dampen = LogCounts(inputCol="_counts", outputCol="_logs")
        idf = IDF(inputCol="_counts", outputCol="_tfidf").fit(counted).setInputCol("_logs")  # a count is above 0 where its logs are
        unit = Normalizer(inputCol="_tfidf", outputCol="_features")
        lr = LogisticRegression(family="multinomial", featuresCol="_features", labelCol="_index", weightCol="_weight", regParam=1.0 / (g("inverseReg") * n), maxIter=200, standardization=False, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_told")
        back = IndexToString(inputCol="_told", outputCol="_class", labels=index.labels)
        vectors = [dampen, idf, unit]
        fitted = lr.fit(PipelineModel(stages=vectors).transform(counted).select("_index", "_weight", "_features"))
        made = BigramClassifierModel(PipelineModel(stages=[words, pairs, both, count, *vectors, fitted, back]))
        return self._copyValues(made)


def frequent_terms(rows: DataFrame, most: int, least: float) -> list[str]:
    """The ``most`` most frequent words and word pairs of ``rows`` (one array of words each) that ``least`` rows hold;
    of equally frequent ones words come first, then the order of names.

    A pair is not more frequent than its words, nor in more rows. So a pair that comes before the last of ``most`` words
    consists of words before that last one: only such pairs are counted, by the numbers of their words."""

    def tally(text: np.ndarray, code: np.ndarray, n: int) -> list[pa.Array]:
        held = np.unique(text * max(n, 1) + code) % max(n, 1)
        return [pa.array(np.bincount(x, minlength=n).astype(np.int64)) for x in (code, held)]

    def placed(words: pa.ListArray) -> np.ndarray:
        return np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in V.chunks(b):
                coded = c.column(0).flatten().dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([coded.dictionary, *tally(placed(c.column(0)), code, len(coded.dictionary))], names=["term", "n", "df"])

    def top(counts: DataFrame) -> DataFrame:
        x = counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).where(F.col("df") >= least)
        return x.orderBy(F.desc("n"), "term").limit(most).select("term", "n")

    words = {r.term: r.n for r in top(rows.mapInArrow(single, "term string, n bigint, df bigint")).collect()}  # at most maxFeatures rows
    names = sorted(words)
    if not names:
        raise ValueError("no term is in enough rows")
    at = pa.array(names, pa.string())

    def double(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in V.chunks(b):
                text = placed(c.column(0))
                code = pc.index_in(c.column(0).flatten(), value_set=at).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                beside = np.flatnonzero((text[:-1] == text[1:]) & (code[:-1] >= 0) & (code[1:] >= 0))
                pair, which = np.unique(code[beside] * len(names) + code[beside + 1], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), *tally(text[beside], which, len(pair))], names=["term", "n", "df"])

    pairs = top(rows.mapInArrow(double, "term bigint, n bigint, df bigint")).collect()  # at most maxFeatures rows
    found = [(-n, 0, (w,)) for w, n in words.items()] + [(-r.n, 1, (names[r.term // len(names)], names[r.term % len(names)])) for r in pairs]
    return [" ".join(term) for *_, term in sorted(found)[:most]]


class LogCounts(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """1 + ln of every count of a sparse vector."""

    @keyword_only
    def __init__(self, *, inputCol="counts", outputCol="logs"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # a vector comes and goes as the frame of its parts
        @F.pandas_udf(VectorUDT())
        def logs(v: pd.DataFrame) -> pd.DataFrame:
            return v.assign(values=[1.0 + np.log(x) for x in v["values"]])

        return dataset.withColumn(self.getOutputCol(), logs(F.col(self.getInputCol())))


class BigramClassifierModel(Model, _ClassifierParams, MLReadable, MLWritable):
    """Adds prediction, probability, base_label, base_conf and the fallback flag."""

    def __init__(self, stages: PipelineModel | None = None):
        super().__init__()
        self.stages = stages

    @property
    def classes(self) -> tuple[str, ...]:
        return tuple(self.stages.stages[-1].getLabels())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        before = dataset.columns
        x = self.stages.transform(dataset.withColumn("_text", F.col(self.getInputCol())))
        made = {self.getProbabilityCol(): F.col("_p"), self.getPredictionCol(): F.col("_class"), "base_label": F.col("_class"), "base_conf": F.array_max(vector_to_array("_p"))}
        x = x.select(*[F.col(f"`{c}`") for c in before if c not in made], *[c.alias(k) for k, c in made.items()])
        return self._told(x, "base_conf")

    def write(self) -> MLWriter:
        return _BigramWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _BigramReader()


class _BigramWriter(MLWriter):
    def __init__(self, stage: BigramClassifierModel):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.stages.write().overwrite().save(f"{path}/stages")


class _BigramReader(MLReader):
    def load(self, path: str) -> BigramClassifierModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = BigramClassifierModel(PipelineModel.load(f"{path}/stages"))
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


def bigram_metrics(s: SparkSession, d: str) -> DataFrame:
    """Recall per class, and accuracy in all (class null), of the balanced bigram classifier of ``labels.quality`` on the
    labelled documents whose crc32(doc_id) mod 5 is 0, learnt on the others."""
    docs = s.read.parquet(f"{d}/documents.parquet").join(s.read.parquet(f"{d}/labels.parquet"), "doc_id").withColumn("label", F.col("quality").cast("string"))
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    told = BigramClassifier().fit(docs.where(~out)).transform(docs.where(out & F.col("label").isNotNull()))
    return told.rollup(F.col("label").alias("class")).agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("recall"))


QUERIES["bigram_metrics"] = bigram_metrics
