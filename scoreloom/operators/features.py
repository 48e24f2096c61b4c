"""Features and models on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.scores import classification_columns, confusion, quantiles, score_table


def finite(c: str) -> Column:
    """The column as a number, null where it is NaN or infinite."""
    v = F.col(c).cast("double")
    return F.when(F.abs(v) < 1e300, v)


def imputation_values(df: DataFrame, numeric: list[str], categorical: list[str]) -> dict[str, float | str]:
    """Exact medians, and modes with the smallest value on ties."""
    out: dict[str, float | str] = {}
    clean = df.select(*[finite(c).alias(c) for c in numeric], *categorical)
    if numeric:
        long = clean.select(F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in numeric])).alias("x")).select("x.*", F.lit(0).alias("y"))
        out |= {r.f: r.value for r in quantiles(score_table(long, "v", "y", ["f"]), [0.5], ["f"]).collect()}
    if categorical:
        row = clean.agg(*[F.mode(c, True).alias(c) for c in categorical]).first()
        out |= {c: row[c] for c in categorical if row[c] is not None}
    return out


def scales(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, float]]:
    """(median, mean after filling, population deviation or 1) of each column."""
    if not columns:
        return {}
    medians = imputation_values(df, columns, [])
    value = {c: F.coalesce(finite(c), F.lit(medians.get(c, 0.0))) for c in columns}
    row = df.agg(*[F.avg(v).alias(f"m_{c}") for c, v in value.items()], *[F.stddev_pop(v).alias(f"s_{c}") for c, v in value.items()]).first()
    return {c: (medians.get(c, 0.0), row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def scaled(c: str, scale: tuple[float, float, float]) -> Column:
    """(x - mean) / deviation, a missing x being the median."""
    median, mean, deviation = scale
    return (F.coalesce(finite(c), F.lit(median)) - F.lit(mean)) / F.lit(deviation)


def standardised(df: DataFrame, columns: list[str], fitted: DataFrame | None = None) -> DataFrame:
    """Columns with median imputation, then (x - mean) / population deviation (1 if it is 0)."""
    fit = scales(fitted if fitted is not None else df, columns)
    return df.withColumns({f"z_{c}": scaled(c, fit[c]) for c in columns}) if columns else df


def categories_seen(df: DataFrame, columns: list[str], most: int = 1000) -> dict[str, tuple[str | None, list[str]]]:
    """(mode, sorted categories) of each column; an error beyond ``most`` categories, which is no categorical feature."""
    modes = imputation_values(df, [], columns) if columns else {}
    out = {}
    for c in columns:
        seen = [r[0] for r in df.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c).limit(most + 1).collect()]
        if len(seen) > most:
            raise ValueError(f"{c} has more than {most} categories")
        out[c] = (modes.get(c), seen)
    return out


def one_hot(df: DataFrame, columns: list[str], fitted: DataFrame | None = None, most: int = 1000) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
    """A 0/1 column for each category seen in fitting, and what each stands for; unknown ones are all zero.

    Columns are numbered, as categories may differ in case only.  most: an error beyond so many
    categories of a column, which is no categorical feature then.
    """
    out, names = {}, {}
    for c, (mode, seen) in categories_seen(fitted if fitted is not None else df, columns, most).items():
        v = F.coalesce(F.col(c), F.lit(mode))
        for i, k in enumerate(seen):
            out[f"is_{c}_{i}"] = F.coalesce((v == k).cast("double"), F.lit(0.0))
            names[f"is_{c}_{i}"] = (c, k)
    return (df.withColumns(out) if out else df), names


def _term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of one- and two-word terms: words of two or more characters, lower case."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), 0)
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    # Texts are placed by key once; counting in a text and its norm then need no shuffle of terms.
    placed = df.select(F.col(key), F.col(text)).repartition(F.col(key))
    return placed.select(F.col(key), F.explode(F.concat(words, pairs)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def _known_terms(tf: DataFrame, df: DataFrame, least_documents: int) -> DataFrame:
    """(term, df, tf, idf) of terms in enough texts, tf being that of all texts."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    known = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")).where(F.col("df") >= least_documents)
    return known.crossJoin(F.broadcast(n)).withColumn("idf", F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).drop("n")


def term_table(df: DataFrame, key: str, text: str, least_documents: int = 5) -> DataFrame:
    """(term, df, tf, idf) of one- and two-word terms over all texts: one pass, in which no term meets its texts again.

    idf = ln((1 + n) / (1 + df)) + 1.
    """
    return _known_terms(_term_counts(df, key, text), df, least_documents)


def term_weights(df: DataFrame, key: str, text: str, least_documents: int = 5) -> DataFrame:
    """(key, term, tf, df, idf, weight) of the same terms, L2-normed in each text."""
    tf = _term_counts(df, key, text)
    known = _known_terms(tf, df, least_documents).drop("tf")
    # Which side is sent whole is left to adaptive execution, by the measured size of the vocabulary.
    # The norm is over the texts' own partitioning where the join keeps it.
    raw = tf.join(known, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.withColumn("weight", F.col("raw") / norm).select(key, "term", "tf", "df", "idf", "weight")


def class_weights(df: DataFrame, target: str) -> dict[int, float]:
    """n / (classes * rows of the class)."""
    counts = {r[0]: r[1] for r in df.groupBy(target).count().collect()}
    n = sum(counts.values())
    return {k: n / (len(counts) * v) for k, v in counts.items()}


def weighted(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    c = F.lit(1.0)
    for k, w in class_weights(df, target).items():
        c = F.when(F.col(target) == k, w).otherwise(c)
    return df.withColumn(name, c)


def _flags(value: Column, categories: list[str]) -> Column:
    """An array with 1 where the value is the category, and 0."""
    return F.transform(F.array(*map(F.lit, categories)), lambda k: F.coalesce((value == k).cast("double"), F.lit(0.0)))


class Tabular:
    """Imputed, scaled and one-hot encoded columns, and optionally TF-IDF of a text, as one vector.

    Everything learnt is learnt in ``fit``; ``transform`` is expressions and Spark ML stages only.
    """

    def __init__(self, numeric: list[str], categorical: list[str], text: str | None = None, least_documents: int = 5, vocabulary: int = 30_000):
        if not numeric and not categorical and not text:
            raise ValueError("no feature columns")
        self.numeric, self.categorical, self.text = numeric, categorical, text
        self.least_documents, self.vocabulary = least_documents, vocabulary

    def fit(self, df: DataFrame) -> "Tabular":
        self.scales, self.seen = scales(df, self.numeric), categories_seen(df, self.categorical)
        if self.text:
            split = [RegexTokenizer(inputCol="_text", outputCol="_w1", pattern=r"(?U)\b\w\w+\b", gaps=False), NGram(n=2, inputCol="_w1", outputCol="_w2"), SQLTransformer(statement="SELECT *, concat(_w1, _w2) AS _terms FROM __THIS__")]
            count = CountVectorizer(inputCol="_terms", outputCol="_tf", minDF=float(self.least_documents), vocabSize=self.vocabulary)
            self.tokens = Pipeline(stages=[*split, count]).fit(self._with_text(df))
            found = IDF(inputCol="_tf", outputCol="_idf").fit(self.tokens.transform(self._with_text(df)))
            # Smoothed, and never 0: ln((1 + n) / (1 + df)) + 1.
            weights = [math.log((1 + found.numDocs) / (1 + d)) + 1 for d in found.docFreq]
            self.weighing = PipelineModel([ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="_tf", outputCol="_weighed"), Normalizer(p=2.0, inputCol="_weighed", outputCol="_tfidf")])
        return self

    def _with_text(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_text", F.lower(F.coalesce(F.col(self.text), F.lit(""))))

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        cells = [scaled(c, self.scales[c]) for c in self.numeric]
        flags = [_flags(F.coalesce(F.col(c), F.lit(mode)), seen) for c, (mode, seen) in self.seen.items() if seen]
        wide, parts = df, []
        if cells or flags:
            wide, parts = wide.withColumn("_cells", array_to_vector(F.concat(F.array(*cells).cast("array<double>"), *flags) if cells else F.concat(*flags))), ["_cells"]
        if self.text:
            wide, parts = self.weighing.transform(self.tokens.transform(self._with_text(wide))), [*parts, "_tfidf"]
        vector = VectorAssembler(inputCols=parts, outputCol=out).transform(wide)
        return vector.drop("_cells", "_text", "_w1", "_w2", "_terms", "_tf", "_weighed", "_tfidf")


def logistic(features: str = "features", target: str = "target", weight: str = "weight", total_weight: float = 1.0) -> LogisticRegression:
    """L2-regularised with C = 1, on features as they are."""
    return LogisticRegression(featuresCol=features, labelCol=target, weightCol=weight, regParam=1.0 / max(total_weight, 1e-9), elasticNetParam=0.0, standardization=False, maxIter=200)


def boosted(features: str = "features", target: str = "target", weight: str = "weight", rounds: int = 20, depth: int = 4, step: float = 0.1) -> GBTClassifier:
    return GBTClassifier(featuresCol=features, labelCol=target, weightCol=weight, maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=0.85, seed=42)


def probability(model: Transformer, df: DataFrame, out: str = "score") -> DataFrame:
    """Rows with the positive class's probability."""
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def fit_logistic(df: DataFrame, features: str, target: str):
    """The balanced model; the weights of all rows add up to their number, whatever the classes."""
    train = weighted(df.select(features, target).where(F.col(target).isNotNull()), target)
    return logistic(features, target, "weight", float(train.count() or 1)).fit(train)


def out_of_fold(df: DataFrame, fold: str, k: int, features: str, target: str, out: str) -> DataFrame:
    """Every row scored by a model that was not fitted on its fold."""
    parts = []
    for i in range(k):
        model = fit_logistic(df.where(F.col(fold) != i), features, target)
        parts.append(probability(model, df.where(F.col(fold) == i), out))
    return reduce(DataFrame.unionByName, parts)


def cross_validated(df: DataFrame, fold: str, k: int, target: str, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(folds, mean, std) of balanced accuracy; fit(train) gives a function that adds ``pred`` to rows.

    std is that of the population of folds.
    """
    parts = [fit(df.where(F.col(fold) != i))(df.where(F.col(fold) == i)).select(F.lit(i).alias("fold"), F.col(target), "pred") for i in range(k)]
    cells = confusion(reduce(DataFrame.unionByName, parts), target, "pred", ["fold"])
    each = cells.select(classification_columns()["balanced_accuracy"].alias("b"))
    return each.agg(F.count("b").alias("folds"), F.avg("b").alias("mean"), F.stddev_pop("b").alias("std"))


def embedding_vector(c: Column) -> Column:
    """An array of floats as a vector of length one."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return array_to_vector(F.transform(c, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0))))
