import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from paperlens.functions.vectors import dense, sparse_one_hot
from paperlens.operators import classifiers, journals, logistic, onehot
from paperlens.operators.logistic import Gradient, Newton, fit, masked_points


@pytest.fixture(scope="module")
def papers(spark):
    return spark.createDataFrame([
        ("1", "J", ["X", "Y"], 2015), ("2", "J", ["X", "X"], 2016), ("3", "K", ["Y"], 2015),
        ("4", "L", ["Z"], 2015), ("5", "L", None, 2015), ("6", "K", ["Z"], 2015),
    ], "eid string, issn string, subjareas array<string>, year short")


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(
        [("1", [1.0, 1.0]), ("2", [3.0, 5.0]), ("3", [2.0, 2.0]), ("4", [7.0, 7.0]), ("x", [0.0, 0.0])],
        "id string, embedding array<double>")


def test_centroids(spark, papers, vectors, rows):
    assert rows(journals.journal_centroids(papers, vectors, dimension=2)) == [
        ("J", (2.0, 3.0)), ("K", (2.0, 2.0)), ("L", (7.0, 7.0))]
    areas = spark.createDataFrame([("J", ["X"]), ("nobody", ["Q"])], "issn string, subjareas array<string>")
    assert rows(journals.journal_centroids(papers, vectors, areas=areas)) == [
        ("J", (2.0, 3.0), ("X",)), ("K", (2.0, 2.0), ()), ("L", (7.0, 7.0), ())]
    by_year = journals.journal_year_centroids(papers, vectors, dimension=2, areas=areas)
    assert by_year.columns == ["id", "embedding", "year", "subjareas"]
    assert rows(by_year.drop("subjareas")) == [
        ("J", (1.0, 1.0), 2015), ("J", (3.0, 5.0), 2016), ("K", (2.0, 2.0), 2015), ("L", (7.0, 7.0), 2015)]


def test_area_one_hot(papers, vectors, rows):
    index = onehot.area_index(papers, slots=4)
    assert rows(index) == [("X", 0), ("Y", 1), ("Z", 2)]
    assert rows(onehot.area_one_hot(papers, vectors, index, slots=4)) == [
        ("1", (1, 1, 0, 0), (1.0, 1.0)), ("2", (1, 0, 0, 0), (3.0, 5.0)),
        ("3", (0, 1, 0, 0), (2.0, 2.0)), ("4", (0, 0, 1, 0), (7.0, 7.0))]
    with pytest.raises(ValueError, match="more than 2"):
        onehot.area_index(papers, slots=2)


def test_journal_one_hot(papers, rows):
    assert rows(onehot.journal_index(papers, ["Y", "Z"])) == [("J", 1), ("K", 0), ("L", 2)]
    encoded = onehot.journal_one_hot(papers, ["Y"])
    assert encoded.dtypes == [("id", "string"), ("ohe", "struct<size:int,slot:int>")]
    assert rows(encoded.select("id", dense(F.col("ohe")))) == [
        ("1", (1, 0)), ("2", (1, 0)), ("3", (0, 1)), ("6", (0, 1))]


def test_issn_frequency(papers, rows):
    assert rows(onehot.issn_frequency(papers, ["X", "Y"])) == [("J", 4), ("K", 1)]
    assert rows(onehot.issn_frequency(papers, ["X", "Y"], distinct_papers=True)) == [("J", 2), ("K", 1)]


@pytest.fixture(scope="module")
def separable(spark):
    rows = [(f"p{i}", [int(i % 2 == 0), int(i % 3 == 0)], [float(i % 2), float(i % 3), i / 60]) for i in range(60)]
    return spark.createDataFrame(rows, "id string, ohe array<int>, features array<double>")


def test_area_models(spark, separable, rows):
    hits, total = classifiers.area_accuracy(0, separable)
    assert 0 < total < 30 and hits == total
    named = spark.createDataFrame([("even", 0), ("thirds", 1)], "area string, areaIndex int")
    result = classifiers.all_areas_accuracy(separable, named, slots=2)
    assert [(r.label, r.totalcount, r.accuracy) for r in result.orderBy("label").collect()] == [
        ("even", total, 100.0), ("thirds", total, 100.0)]
    assert {r.label for r in classifiers.all_areas_accuracy(separable, slots=2).collect()} == {"0", "1"}


@pytest.fixture(scope="module")
def noisy(spark):
    """Labels of 70 slots, more than a word holds, that no plane separates."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 4)) * [1, 10, 0.1, 3] + [0, 5, 0, -2]
    true = rng.normal(size=(70, 4)) / [1, 10, 0.1, 3]
    flags = (x - x.mean(axis=0)) @ true.T + rng.normal(size=(700, 70)) * 2 > 0.3
    rows = [(f"p{i}", [int(f) for f in flags[i]], [float(v) for v in x[i]]) for i in range(700)]
    return spark.createDataFrame(rows, "id string, ohe array<int>, features array<double>").repartition(5)


@pytest.mark.parametrize("solver, within", [(Newton(), 1e-3), (Gradient(steps=60), 1e-2)])
def test_models_are_those_of_another_solver(noisy, solver, within):
    points = masked_points(noisy, 70)
    training, testing = classifiers.split(points)
    models = fit(training, 70, solver)
    hits, total = models.hits(testing)
    assert total == testing.count() and 0 < total < 200
    for slot in (0, 62, 63, 69):
        flagged = models.transform(training, slot).select("label", array_to_vector("features").alias("features"))
        other = LogisticRegression(tol=1e-10, maxIter=300).fit(flagged)
        assert models.weights[slot] == pytest.approx(other.coefficients.toArray(), rel=10 * within, abs=within)
        assert models.intercepts[slot] == pytest.approx(other.intercept, rel=10 * within, abs=10 * within)
        scored = models.transform(testing, slot)
        assert scored.where("label = prediction").count() == hits[slot]


def test_all_models_take_one_pass_a_step(noisy, monkeypatch):
    monkeypatch.setattr(logistic, "MERGERS", 2)
    passes = []
    summed = logistic._summed
    monkeypatch.setattr(logistic, "_summed", lambda *a: passes.append(a[1]) or summed(*a))
    fit(masked_points(noisy, 70), 70, Gradient(steps=3))
    assert passes == [70, 70, 70]


def test_models_of_sparse_one_hots_and_of_little(spark, separable):
    """The same models from flags and from slots; one label only, one row, no rows."""
    flags = separable.select("id", F.array(F.col("ohe")[0], 1 - F.col("ohe")[0]).alias("ohe"), "features")
    slots = separable.select("id", sparse_one_hot(1 - F.col("ohe")[0], 2).alias("ohe"), "features")
    wanted = classifiers.all_areas_accuracy(flags, slots=2).collect()
    assert classifiers.all_areas_accuracy(slots, slots=2).collect() == wanted
    assert classifiers.area_accuracy(1, slots) == classifiers.area_accuracy(1, flags)
    always = separable.withColumn("ohe", F.array(F.lit(1)))
    hits, total = classifiers.area_accuracy(0, always)
    assert hits == total > 0
    assert classifiers.area_accuracy(0, separable.where("id = 'p1'"))[1] <= 1
    assert classifiers.area_accuracy(0, separable.limit(0)) == (0, 0)
    uneven = separable.withColumn("features", F.expr("if(id = 'p3', array(1D), features)"))
    with pytest.raises(ValueError, match="length"):
        classifiers.area_accuracy(0, uneven)


def test_model_evaluation(separable):
    model, training, testing = classifiers.train_area_model(0, separable)
    result = classifiers.evaluate_model(model, training=training, testing=testing)
    assert {r["set"]: (r.cases, r.accuracy) for r in result.collect()} == {
        "training": (training.count(), 1.0), "testing": (testing.count(), 1.0)}


def test_evaluation_rates(spark):
    def one(*pairs):
        df = spark.createDataFrame(list(pairs), "label double, prediction double")
        return classifiers.evaluate(df).first()

    mixed = one((1.0, 1.0), (1.0, 0.0), (0.0, 0.0), (0.0, 1.0), (0.0, 0.0))
    assert (mixed.accuracy, mixed.prevalence, mixed.recall, mixed.specificity, mixed.ppv, mixed.npv) == (
        0.6, 0.4, 0.5, 2 / 3, 0.5, 2 / 3)
    assert (mixed.false_positives, mixed.false_negatives) == (1, 1)
    assert one((0.0, 0.0)).recall is None and one((0.0, 0.0)).ppv is None
    assert one((1.0, 0.0), (0.0, 1.0)).accuracy == 0.0


def test_evaluations_merge(spark, rows):
    df = spark.createDataFrame([(i % 3, float(i % 2), float(i % 5 > 2)) for i in range(40)], "part int, label double, prediction double")
    assert rows(classifiers.merge_evaluations(classifiers.evaluate(df, "part"))) == rows(classifiers.evaluate(df))


def test_one_journal_against_others(spark):
    papers = spark.createDataFrame(
        [(str(i), "JKL"[i % 3], ["X", "Y"] if i % 6 == 2 else ["X"]) for i in range(90)],
        "eid string, issn string, subjareas array<string>")
    vectors = spark.createDataFrame([(str(i), [float(i % 3 == 0), i / 90]) for i in range(90)], "id string, embedding array<double>")
    row = classifiers.one_journal_against_others(papers, vectors, ["X", "Y"], ["J", "K"]).first()
    assert row.fitcount == row.totalcount > 0
    assert (row.complement_fitcount, row.complement_totalcount) == (45, 45)


@pytest.mark.parametrize("dimension", [2, None])
@pytest.mark.parametrize("wrong", [[1.0, 2.0, 3.0], [1.0, None]])
def test_centroids_of_unfit_vectors_are_an_error(spark, dimension, wrong):
    from paperlens.operators.embeddings import centroids

    df = spark.createDataFrame([("k", [1.0, 2.0]), ("k", wrong)], "key string, embedding array<double>")
    with pytest.raises(Exception, match="vectors differ in length"):
        centroids(df, "key", dimension=dimension).collect()


def test_steps_read_small_parts_together(spark, monkeypatch):
    points = masked_points(spark.range(600).repartition(90).select(
        "id", F.array((F.col("id") % 2).cast("int")).alias("ohe"), F.array((F.col("id") % 7).cast("double")).alias("features")), 1)
    parts, summed = [], logistic._summed

    def seen(stepped, *rest):
        parts.append(stepped.rdd.getNumPartitions())
        return summed(stepped, *rest)

    monkeypatch.setattr(logistic, "_summed", seen)
    model = fit(points, 1, Gradient(steps=2))
    assert len(parts) == 2 and max(parts) <= spark.sparkContext.defaultParallelism
    whole = fit(points.coalesce(1), 1, Gradient(steps=2))
    assert model.weights == pytest.approx(whole.weights) and model.intercepts == pytest.approx(whole.intercepts)
