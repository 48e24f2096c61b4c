"""Runs of the workbench: fit model variants, choose thresholds by a policy, write what came of it.

A run's folder holds scored rows with decisions and gains curves as Parquet, the summary as CSV, the
selected model, and ``report.json``.  Reports are small: measures, settings and paths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.operators import features, policies, profiles, scores, splits
from scoreloom.operators.policies import Policy
from scoreloom.session import checkpointed
from scoreloom.sources import files

#: A variant: fit(train) gives (a function that adds ``score`` to rows, a function that saves the model).
Fit = Callable[[DataFrame], tuple[Callable[[DataFrame], DataFrame], Callable[[str], None]]]


def _saved(prep: features.Tabular, model) -> Callable[[str], None]:
    """Writes the model and, as JSON, what the features learnt."""

    def save(path: str) -> None:
        model.write().overwrite().save(f"{path}/model")
        if prep.text:
            prep.tokens.write().overwrite().save(f"{path}/tokens")
            prep.weighing.write().overwrite().save(f"{path}/weighing")
        files.write_report(f"{path}/features.json", {"scales": prep.scales, "categories": prep.seen})

    return save


def logistic(numeric: list[str], categorical: list[str], text: str | None = None) -> Fit:
    def fit(train: DataFrame):
        prep = features.Tabular(numeric, categorical, text).fit(train)
        model = features.fit_logistic(prep.transform(train), "features", "target")
        return lambda df: features.probability(model, prep.transform(df)).drop("features"), _saved(prep, model)

    return fit


def boosted(numeric: list[str], categorical: list[str], rounds: int = 260, depth: int = 6, step: float = 0.05) -> Fit:
    def fit(train: DataFrame):
        prep = features.Tabular(numeric, categorical).fit(train)
        model = features.boosted(rounds=rounds, depth=depth, step=step).fit(features.weighted(prep.transform(train), "target"))
        return lambda df: features.probability(model, prep.transform(df)).drop("features"), _saved(prep, model)

    return fit


def risk_profiles(numeric: list[str], categorical: list[str], bins: int = 8, least: int = 80, smoothing: float = 20.0) -> Fit:
    def fit(train: DataFrame):
        edges = profiles.edges_of(train, numeric, bins)
        table = checkpointed(profiles.build(train, "target", edges, categorical, least, smoothing))
        return lambda df: profiles.score(df, table, edges, categorical), lambda path: profiles.export(table).write.mode("overwrite").csv(f"{path}/profile", header=True)

    return fit


def variants(numeric: list[str], categorical: list[str], text: str | None, names: list[str]) -> dict[str, Fit]:
    known = {
        "logistic_tabular": logistic(numeric, categorical),
        "logistic_text_fusion": logistic(numeric, categorical, text),
        "boosted_trees": boosted(numeric, categorical),
        "risk_profiles": risk_profiles(numeric, categorical),
    }
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown variants: {', '.join(unknown)}")
    return {n: known[n] for n in names}


def cross_validation(train: DataFrame, key: str, fit: Fit, k: int) -> dict[str, float]:
    """Mean and population deviation of balanced accuracy over k folds, at a score of 0.5."""
    rows = splits.folds(train, key, "target", k)

    def one(part: DataFrame):
        add, _ = fit(part)
        return lambda df: add(df).withColumn("pred", (F.col("score") >= 0.5).cast("int"))

    row = features.cross_validated(rows, "fold", k, "target", one).first()
    return {"cv_balanced_accuracy_mean": row["mean"], "cv_balanced_accuracy_std": row["std"]}


def run(df: DataFrame, out: str, key: str, models: dict[str, Fit], policy: Policy, folds: int = 0) -> dict:
    """Fits every variant on train_fit, tunes it on validation by the policy, evaluates it on test.

    df: rows with ``split`` and ``target``.  folds: of the cross-validation of each variant, none if
    0.  Returns the report, which is also written.
    """
    spark = df.sparkSession
    train, rest = df.where("split = 'train_fit'"), df.where("split IN ('validation', 'test')")
    found, savers = [], {}
    for name, fit in models.items():
        add, savers[name] = fit(train)
        add(rest).select(key, "split", "target", "score").write.mode("overwrite").parquet(f"{out}/scored/model={name}")
        rows = spark.read.parquet(f"{out}/scored/model={name}")
        row = policies.evaluate(rows, "score", "target", key, "split", policy, name)
        if folds:
            row |= cross_validation(train, key, fit, folds)
        review = policy.manual_rate if policy.kind == policies.REVIEW else 0.0
        policies.with_decisions(rows.where("split = 'test'"), "score", key, row["threshold"], review).write.mode("overwrite").parquet(f"{out}/predictions/model={name}")
        scores.gains_curve(rows, "score", "target", "split").write.mode("overwrite").parquet(f"{out}/gains/model={name}")
        found.append(row)
    table = policies.summary(found, policy)
    names = list(dict.fromkeys(k for r in table for k in r))
    spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in table], ", ".join(f"`{n}` string" for n in names)).coalesce(1).write.mode("overwrite").csv(f"{out}/summary", header=True)
    best = next(r["model_name"] for r in table if r["selected"])
    savers[best](f"{out}/best")
    report = {"policy": policy.__dict__, "rows": {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}, "selected_model": best, "models": table, "paths": {k: f"{out}/{k}" for k in ("scored", "predictions", "gains", "summary", "best")}}
    files.write_report(f"{out}/report.json", report)
    return report


def prompts(df: DataFrame, numeric: list[str], categorical: list[str], text: str) -> DataFrame:
    """Rows with ``input``: their feature text."""
    from scoreloom.functions import texts

    cells = [(n, texts.value_text(F.col(n), True)) for n in numeric] + [(n, texts.value_text(F.col(n), False)) for n in categorical]
    return df.withColumn("input", texts.feature_text(cells, F.col(text)))


def training_samples(df: DataFrame, key: str, text: str, system: str, stages: int = 1, teacher=None) -> tuple[DataFrame, DataFrame]:
    """(samples, audit) for fine-tuning on rows with ``input`` and ``target``.

    One stage teaches the action; two teach a reason and then the action with the reason in the
    prompt, reasons being a teacher's (a generator told the label).  A row without text, or whose
    teacher does not hold the label, is dropped; the audit says so for every row.
    """
    from scoreloom import scorers
    from scoreloom.functions import parsing, texts

    rows = df.withColumn("action", texts.label_action(F.col("target"))).withColumn("_blank", F.coalesce(parsing.strip(F.col(text)) == "", F.lit(True)))
    why, reason = F.when(F.col("_blank"), "no_text"), F.lit("")
    if stages == 2:
        if teacher is None:
            raise ValueError("two stages need a teacher")
        asked = rows.withColumn("_prompt", F.concat(F.lit("[Known Label]\naction="), "action", F.lit("\n\n[Input]\n"), "input"))
        said = checkpointed(scorers.generate(asked, teacher, "_prompt", key, "_raw"))
        rows = rows.join(said, key).withColumn("_p", texts.parsed_response(F.col("_raw"), texts.last_json(F.col("_raw"))))
        why = why.when(F.col("_p.status") != "ok_json", "bad_json").when(F.col("_p.label") != F.col("target"), "label_mismatch").when(F.col("_p.reason") == "", "no_reason")
        reason = F.col("_p.reason")
    rows = rows.withColumn("_why", why.otherwise("ok")).withColumn("_reason", reason)
    audit = rows.select(key, "target", F.col("action").alias("expected_action"), F.when(F.col("_why") == "ok", "kept").otherwise("dropped").alias("status"), F.col("_why").alias("reason"))
    sample = lambda stage, user, answer: F.struct(F.lit(stage).alias("stage"), scorers.chat(F.lit(system), user, answer).alias("sample"))
    made = [sample("action", F.col("input") if stages == 1 else F.concat("input", F.lit("\n\n[Reason]\n"), "_reason"), F.col("action"))]
    if stages == 2:
        made.insert(0, sample("reason", F.col("input"), F.col("_reason")))
    return rows.where("_why = 'ok'").select(key, F.explode(F.array(*made)).alias("_s")).select(key, "_s.stage", "_s.sample"), audit


def infer(df: DataFrame, key: str, generator, stages: int = 1) -> DataFrame:
    """(key, response, pred_action, pred_label, pred_reason, parse_status) of rows with ``input``."""
    from scoreloom import scorers
    from scoreloom.functions import texts

    rows = df.select(key, "input")
    if stages == 2:
        first = checkpointed(scorers.generate(rows, generator, "input", key, "_r"))
        rows = rows.join(first, key).withColumn("input", F.concat("input", F.lit("\n\n[Reason]\n"), F.coalesce(texts.reason_text(F.col("_r"), texts.last_json(F.col("_r"))), F.lit("")))).drop("_r")
    said = scorers.generate(rows, generator, "input", key, "response").withColumn("_p", texts.parsed_response(F.col("response"), texts.last_json(F.col("response"))))
    return said.select(key, "response", F.col("_p.action").alias("pred_action"), F.col("_p.label").alias("pred_label"), F.col("_p.reason").alias("pred_reason"), F.col("_p.status").alias("parse_status"))
