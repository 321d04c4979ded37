"""A posture classifier: candidates are fitted on one part of the groups, chosen by macro-F1 on a second and reported on a third."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry

# The classes, the worst first; candidates, the simplest first, which wins a tie.
CLASSES = ["CRITICAL", "HIGH", "MODERATE", "LOW"]
CANDIDATES = ["dummy", "logistic", "forest"]


@dataclass
class Classifier:
    name: str
    model: object  # of the dummy: the place of the class that is always given
    features: list[str]


def _vectors(rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with _x; a missing value counts as -1."""
    return rows.withColumn("_x", array_to_vector(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(-1.0)) for f in features])))


def fit_candidates(rows: DataFrame, features: list[str], label: str, seed: int = 7) -> list[Classifier]:
    """A classifier of each kind over rows; rows with a label outside CLASSES take no part."""
    place = F.array_position(F.array(*map(F.lit, CLASSES)), F.col(label)) - 1
    x = _vectors(rows, features).withColumn("_y", place.cast("double")).where("_y >= 0").select("_x", "_y")
    counts = {int(r["_y"]): r["count"] for r in x.groupBy("_y").count().collect()}
    if not counts:
        raise ValueError("no row has a known label")
    most = min(counts, key=lambda k: (-counts[k], k))
    common = {"featuresCol": "_x", "labelCol": "_y", "predictionCol": "_p"}
    logistic = LogisticRegression(**common, family="multinomial", maxIter=50, regParam=0.01)
    forest = RandomForestClassifier(**common, numTrees=20, maxDepth=6, seed=seed)
    return [Classifier("dummy", most, features), *[Classifier(n, f.fit(x), features) for n, f in (("logistic", logistic), ("forest", forest))]]


def predict(rows: DataFrame, classifier: Classifier, name: str = "predicted") -> DataFrame:
    """rows with the predicted class; validation is always NOT_VALIDATED, since labels come from a rubric and not from incidents."""
    if classifier.name == "dummy":
        out = rows.withColumn("_p", F.lit(float(classifier.model)))
    else:
        out = classifier.model.transform(_vectors(rows, classifier.features)).drop("_x", "rawPrediction", "probability")
    spoken = F.element_at(F.array(*map(F.lit, CLASSES)), F.col("_p").cast("int") + 1)
    return out.withColumns({name: spoken, "validation": F.lit("NOT_VALIDATED")}).drop("_p")


def macro_f1(cells: dict[tuple[str, str], int]) -> float:
    """The mean F1 of the classes that appear, as actual or as predicted ones; cells: (predicted, actual) -> rows."""
    scores = []
    for c in sorted({x for pair in cells for x in pair}):
        both = cells.get((c, c), 0)
        given, there = (sum(n for pair, n in cells.items() if pair[i] == c) for i in (0, 1))
        scores.append(2 * both / (given + there))
    return sum(scores) / len(scores) if scores else 0.0


def choose(rows: DataFrame, features: list[str], label: str, part: str = "part") -> tuple[Classifier, list[dict]]:
    """The candidate of the best macro-F1 on the rows of part VALIDATION, fitted on TRAIN, and all figures with those on TEST; of equal ones the simplest."""
    found = fit_candidates(rows.where(F.col(part) == "TRAIN"), features, label)
    figures = []
    for c in found:
        counts = predict(rows.where(F.col(part) != "TRAIN"), c).groupBy(part, "predicted", label).count().collect()  # a few classes by a few
        validation, test = (round(macro_f1({(r["predicted"], r[label]): r["count"] for r in counts if r[part] == p}), 4) for p in ("VALIDATION", "TEST"))
        figures.append({"model": c.name, "validation_f1": validation, "test_f1": test})
    best = max(range(len(found)), key=lambda i: (figures[i]["validation_f1"], -i))
    return found[best], [x | {"chosen": i == best} for i, x in enumerate(figures)]


def save(spark: SparkSession, classifier: Classifier, path: str) -> dict:
    """Store a classifier; see registry."""
    if classifier.name == "dummy":
        model = spark.createDataFrame([(classifier.model,)], "always int")
    else:
        model = lambda folder: classifier.model.write().overwrite().save(folder)
    return registry.save(model, spark, path, "posture", classifier.features, kind=classifier.name)


def load(spark: SparkSession, path: str, features: list[str]) -> Classifier:
    """The classifier under path, after its manifest and the digest of every file have been checked; otherwise ModelRejected."""
    kind = registry.manifest(spark, path, "posture", features).get("kind")
    if kind == "dummy":
        return Classifier(kind, spark.read.parquet(f"{path}/model").first()["always"], features)
    readers = {"logistic": LogisticRegressionModel, "forest": RandomForestClassificationModel}
    if kind not in readers:
        raise registry.ModelRejected(f"kind is {kind}")
    return Classifier(kind, readers[kind].load(f"{path}/model"), features)
