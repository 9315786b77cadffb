"""A calibrated classifier as a stage of pyspark.ml: fitted, saved, loaded and applied like any other.

Trees are trained on all but one fold of groups, and isotonic regression learns on that
fold what their scores are worth; the model's score is the mean over the folds. One more
ensemble, trained on all rows, tells the importance of features.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import cut
from . import ml


class _Settings(Params):
    features = Param(Params._dummy(), "features", "columns that the trees take", TypeConverters.toListString)
    label = Param(Params._dummy(), "label", "column of the label, 0 or 1", TypeConverters.toString)
    group = Param(Params._dummy(), "group", "column of the groups, which stay together", TypeConverters.toString)
    score = Param(Params._dummy(), "score", "column that the score goes to", TypeConverters.toString)
    folds = Param(Params._dummy(), "folds", "folds at most", TypeConverters.toInt)
    trees = Param(Params._dummy(), "trees", "trees of an ensemble", TypeConverters.toInt)

    def __init__(self, *args) -> None:  # noqa: ANN002
        super().__init__(*args)
        self._setDefault(label="label", group="grp", score="score", folds=3, trees=250)


class CalibratedClassifier(Estimator, _Settings):
    """Fits a CalibratedModel. Rows of one group are never on both sides of a fold."""

    @keyword_only
    def __init__(self, *, features: list[str] | None = None, label: str = "label", group: str = "grp", score: str = "score", folds: int = 3, trees: int = 250) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CalibratedModel:
        features, trees = self.getOrDefault("features"), self.getOrDefault("trees")
        rows = dataset.withColumnsRenamed({self.getOrDefault("label"): "label", self.getOrDefault("group"): "grp"})
        dealt = cut(rows.select("grp", "label", *features).join(ml.stratified_folds(rows, self.getOrDefault("folds")).select("grp", "fold"), "grp"))

        def fitted(fold: int | None) -> tuple[GBTClassificationModel, IsotonicRegressionModel | None]:
            if fold is None:  # all rows
                return ml.train(dealt, features, trees), None
            model = ml.train(dealt.where(F.col("fold") != fold), features, trees)
            held = ml.predict(model, dealt.where(F.col("fold") == fold), features).select("score", "label")
            return model, IsotonicRegression(featuresCol="score", labelCol="label", predictionCol="calibrated").fit(held)

        *parts, (whole, _) = ml.at_once(fitted, [*sorted(r["fold"] for r in dealt.select("fold").distinct().collect()), None])
        return self._copyValues(CalibratedModel(parts, whole))


class CalibratedModel(Model, _Settings, MLWritable, MLReadable):
    """parts: trees and the isotonic map of each fold; whole: the trees of all rows."""

    def __init__(self, parts: list[tuple[GBTClassificationModel, IsotonicRegressionModel]], whole: GBTClassificationModel) -> None:
        super().__init__()
        self.parts, self.whole = parts, whole

    @property
    def numFeatures(self) -> int:  # noqa: N802
        return self.whole.numFeatures

    def importances(self) -> list[tuple[str, float]]:
        return ml.importances(self.whole, self.getOrDefault("features"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = VectorAssembler(inputCols=self.getOrDefault("features"), outputCol="__x", handleInvalid="keep").transform(dataset)
        for i, (model, shape) in enumerate(self.parts):
            named = {model.featuresCol: "__x", model.rawPredictionCol: f"__r{i}", model.probabilityCol: f"__p{i}", model.predictionCol: f"__d{i}"}
            out = model.copy(named).transform(out).withColumn(f"__s{i}", vector_to_array(f"__p{i}")[1])
            out = shape.copy({shape.featuresCol: f"__s{i}", shape.predictionCol: f"__c{i}"}).transform(out).drop(f"__r{i}", f"__p{i}", f"__d{i}", f"__s{i}")
        n = len(self.parts)
        mean = sum((F.col(f"__c{i}") for i in range(n)), F.lit(0.0)) / n
        return out.withColumn(self.getOrDefault("score"), mean).drop("__x", *[f"__c{i}" for i in range(n)])

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: CalibratedModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"parts": len(self.model.parts)})
        for i, (model, shape) in enumerate(self.model.parts):
            model.write().save(f"{path}/part{i}/trees")
            shape.write().save(f"{path}/part{i}/shape")
        self.model.whole.write().save(f"{path}/whole")


class _Reader(MLReader):
    def load(self, path: str) -> CalibratedModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        parts = [(GBTClassificationModel.load(f"{path}/part{i}/trees"), IsotonicRegressionModel.load(f"{path}/part{i}/shape")) for i in range(metadata["parts"])]
        model = CalibratedModel(parts, GBTClassificationModel.load(f"{path}/whole"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def load(spark: SparkSession, path: str) -> CalibratedModel:
    return _Reader().session(spark).load(path)
