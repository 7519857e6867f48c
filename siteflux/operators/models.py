"""Boosted-tree regression with blocked inner folds and leave-one-event-out validation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .iterate import cut
from .parallel import side_by_side

# The reference settings that have an equivalent here.
SETTINGS = {"stepSize": 0.01, "maxDepth": 4, "minInstancesPerNode": 1000, "minInfoGain": 0.1, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.7"}


def fold_of(block: str, folds: int, seed: int) -> Column:
    """All rows of a spatial block share a fold."""
    return F.pmod(F.xxhash64(F.col(block), F.lit(seed)), F.lit(folds)).cast("int")


@dataclass
class BlockedBoosting:
    """fit() finds, for each fold of blocks, the round from which the held-out error no longer falls by
    min_delta within patience rounds, and refits all rows with the mean of those rounds, cut to a whole
    number. keep_held_out: held_out has all rows with the prediction of the folds that never saw them."""

    features: list[str]
    outcome: str
    block: str
    weight: str | None = None
    categorical: list[str] = field(default_factory=list)
    settings: dict = field(default_factory=lambda: dict(SETTINGS))
    rounds: int = 2000
    folds: int = 5
    patience: int = 100
    min_delta: float = 1e-5
    seed: int = 1
    threads: int = 4
    keep_held_out: bool = False
    model: object = None
    stages: list = field(default_factory=list)
    medians: dict = field(default_factory=dict)
    best: list = field(default_factory=list)
    held_out: DataFrame | None = None

    def _booster(self, rounds: int) -> GBTRegressor:
        extra = {"weightCol": self.weight} if self.weight else {}
        return GBTRegressor(featuresCol="__vector", labelCol=self.outcome, predictionCol="prediction", maxIter=rounds, seed=self.seed, **self.settings, **extra)

    def _vectors(self, data: DataFrame) -> DataFrame:
        """Nulls and NaN of numbers become the training rows' median, beside a column that marks them."""
        for f, middle in self.medians.items():
            known = F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
            data = data.withColumns({f"_{f}": F.coalesce(known, F.lit(middle)), f"_{f}_none": known.isNull().cast("double")})
        for s in self.stages:
            data = s.transform(data)
        return data

    def _rounds(self, train: DataFrame, test: DataFrame) -> int:
        """The round from which the error on test has not fallen by min_delta for patience rounds. The rounds
        that are fitted double until that is known, so that a quick end costs few of them."""
        n = min(self.rounds, max(1, 2 * self.patience))
        while True:
            errors = self._booster(n).fit(train).evaluateEachIteration(test, "squared")
            low, at = float("inf"), 0
            for i, e in enumerate(errors):
                if e < low - self.min_delta:
                    low, at = e, i
                elif i - at >= self.patience:
                    return at + 1
            if n >= self.rounds:
                return at + 1
            n = min(self.rounds, 2 * n)

    def fit(self, data: DataFrame) -> BlockedBoosting:
        numbers = [f for f in self.features if f not in self.categorical]
        v = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
        found = data.agg(*[F.median(v(f)).alias(f) for f in numbers]).first() if numbers else {}
        self.medians = {f: 0.0 if found[f] is None else float(found[f]) for f in numbers}
        self.stages = [StringIndexer(inputCol=c, outputCol=f"_{c}", handleInvalid="keep").fit(data) for c in self.categorical]
        inputs = [x for f in self.features for x in ([f"_{f}"] if f in self.categorical else [f"_{f}", f"_{f}_none"])]
        self.stages.append(VectorAssembler(inputCols=inputs, outputCol="__vector", handleInvalid="error"))
        rows = cut(self._vectors(data).withColumn("_fold", fold_of(self.block, self.folds, self.seed)))
        self.held_out = None

        def one(k: int) -> tuple[int, DataFrame | None] | None:
            test, train = rows.filter(F.col("_fold") == k), rows.filter(F.col("_fold") != k)
            if test.isEmpty() or train.isEmpty():
                return None
            best = self._rounds(train, test)
            return best, self._booster(best).fit(train).transform(test) if self.keep_held_out else None

        found = [x for x in side_by_side([lambda k=k: one(k) for k in range(self.folds)], self.threads) if x]
        self.best = [n for n, _ in found]
        for _, part in found if self.keep_held_out else []:
            self.held_out = part if self.held_out is None else self.held_out.unionByName(part)
        self.held_out = None if self.held_out is None else self._plain(self.held_out)
        self.model = self._booster(max(1, sum(self.best) // max(1, len(self.best)))).fit(rows)
        return self

    def _plain(self, data: DataFrame) -> DataFrame:
        return data.drop("__vector", "_fold", *[f"_{c}" for c in self.features], *[f"_{c}_none" for c in self.medians])

    def save(self, path: str) -> None:
        """The model as the library writes it, and what its inputs need as a table beside it."""
        self.model.write().overwrite().save(f"{path}/model")
        for k, s in enumerate(self.stages):
            s.write().overwrite().save(f"{path}/stages/{k}")
        SparkSession.active().createDataFrame([(f, m) for f, m in self.medians.items()], "feature string, median double").write.mode("overwrite").parquet(f"{path}/medians")

    def load(self, path: str) -> BlockedBoosting:
        spark = SparkSession.active()
        self.model = GBTRegressionModel.load(f"{path}/model")
        n = len(self.categorical)
        self.stages = [StringIndexerModel.load(f"{path}/stages/{k}") for k in range(n)] + [VectorAssembler.load(f"{path}/stages/{n}")]
        self.medians = {r["feature"]: r["median"] for r in spark.read.parquet(f"{path}/medians").collect()}  # one row a feature
        return self

    def predict(self, data: DataFrame) -> DataFrame:
        """Every row of data with its prediction, also those with nulls."""
        return self._plain(self.model.transform(self._vectors(data)))


def leave_one_out(data: DataFrame, event: str, events: list, make, threads: int = 4) -> DataFrame:
    """data's rows with the prediction of a model that never saw their event. Models are fitted side by side, threads at a time."""

    def one(e) -> DataFrame:
        return make().fit(data.filter(F.col(event) != e)).predict(data.filter(F.col(event) == e))

    out = None
    for part in side_by_side([lambda e=e: one(e) for e in events], threads):
        out = part if out is None else out.unionByName(part)
    return out


def assembled(data: DataFrame, features: list[str], name: str = "all") -> DataFrame:
    """data with one array of the features, in their order; nulls stay null."""
    return data.withColumn(name, F.array(*[F.col(f).cast("double") for f in features]))


def chosen(data: DataFrame, features: list[str], part: list[str], name: str = "all", to: str = "part") -> DataFrame:
    """data with the array of those features of an assembled one that a model is fitted on."""
    missing = [f for f in part if f not in features]
    if missing:
        raise ValueError(f"not among the assembled features: {missing}")
    return data.withColumn(to, F.array(*[F.get(name, F.lit(features.index(f))) for f in part]))


def weighted_logistic(data: DataFrame, features: list[str], outcome: str, weight: str | None = None, c: float = 1.0):
    """L2-penalised logistic regression whose penalty is 1 / (2 c), as for summed losses; the
    library averages losses over the weights' sum, hence the conversion."""
    total = data.agg(F.sum(weight) if weight else F.count("*")).first()[0]
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(data)
    extra = {"weightCol": weight} if weight else {}
    lr = LogisticRegression(featuresCol="_x", labelCol=outcome, regParam=1.0 / (c * float(total)), elasticNetParam=0.0, standardization=False, tol=1e-10, maxIter=200, **extra)
    return lr.fit(rows)
