"""Undersampling and model fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldseries.catalog.fixtures import SITE, site_panel, table
from fieldseries.catalog.registry import query
from fieldseries.operators.learners import fit_predict, tune_classifier, with_vector
from fieldseries.operators.materialize import materialize
from fieldseries.operators.metrics import ranking_metrics
from fieldseries.operators.tomek import remove_tomek_links, tomek_links
from fieldseries.plans.experiments import disease_benchmark, simple_benchmark
from fieldseries.plans.weather import weather_benchmark

TOMEK_SQL = """with p as (select vec_id, label % 2 as y, embedding::double[] as x from embeddings),
  d as (select a.vec_id as a, b.vec_id as b, a.y as ya, b.y as yb,
          round(list_sum(list_transform(range(1, 65), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i]))), 9) as dist
        from p a join p b on a.vec_id <> b.vec_id),
  nn as (select * from d qualify row_number() over (partition by a order by dist, b) = 1),
  links as (select l.a as vec_id, l.ya as y, l.b as partner_id from nn l join nn r on l.a = r.b and l.b = r.a where l.ya <> l.yb)"""


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("x"), (F.col("label") % 2).cast("int").alias("y")
    )


@query("tomek_links", f"{TOMEK_SQL} select vec_id, cast(y as int) as y, partner_id from links")
def tomek_link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tomek_links(embedding_rows(spark, sf_dir), "x", "y", "vec_id", block_rows=64, visitor_rows=128)


@query(
    "tomek_undersampling",
    f"""{TOMEK_SQL}, c as (select sum(y) as n1, sum(1 - y) as n0 from p)
      select vec_id, cast(y as int) as y from p where vec_id not in
        (select vec_id from links, c where y = case when n1 >= n0 then 1 else 0 end)""",
)
def tomek_undersampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_tomek_links(embedding_rows(spark, sf_dir), "x", "y", "vec_id").select("vec_id", "y")


# -- fits with their default parameters: SQL knows the rows and what must hold for them ----


def quality_rows(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Labelled documents in three parts, split by the last digit of the id."""
    text, length = F.col("text"), F.greatest(F.length("text"), F.lit(1))

    def share(pattern: str) -> Column:
        # whole runs go at once
        return 1.0 - F.length(F.regexp_replace(text, f"{pattern}+", "")) / length

    features = {"size": F.log1p(length), "letters": share(r"\p{L}"), "spaces": share(r"\s"), "capitals": share(r"\p{Lu}"), "marks": share(r"[#$%&*!|]")}
    documents = table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in features.items()])
    rows = table(spark, sf_dir, "labels").join(documents, "doc_id")
    part = F.pmod("doc_id", F.lit(10))
    rows = materialize(with_vector(rows, list(features)).withColumn("part", part))
    return {
        "train": rows.where("part < 6"),
        "validation": rows.where("part in (6, 7)"),
        "test": rows.where("part > 7"),
    }


FIT_SQL = """select l.doc_id, l.quality, true as score_in_range, true as decision_follows, true as ranks_training_rows
  from labels l join documents d on l.doc_id = d.doc_id where l.doc_id % 10 > 7"""


def checked_fit(model: str, parts: dict[str, DataFrame], params: dict | None = None) -> DataFrame:
    """Test rows, and what must hold of any fit: scores are probabilities, decisions follow
    the chosen threshold, and training rows are ranked better than by chance."""
    both = parts["test"].withColumn("_test", F.lit(True)).unionByName(parts["train"].withColumn("_test", F.lit(False)))
    scored, choice = fit_predict(model, parts["train"], both, "quality", parts["validation"], params)
    scored = materialize(scored.select("doc_id", "quality", "y_score", "y_pred_binary", "_test"))
    auc = ranking_metrics(scored.where("not _test"), "quality", "y_score").select((F.col("roc_auc") > 0.5).alias("ranks_training_rows"))
    return scored.where("_test").select(
        "doc_id",
        "quality",
        F.col("y_score").between(0.0, 1.0).alias("score_in_range"),
        (F.col("y_pred_binary") == (F.col("y_score") >= choice["threshold"]).cast("int")).alias("decision_follows"),
        auc.scalar().alias("ranks_training_rows"),
    )


def _fit_query(model: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return checked_fit(model, quality_rows(spark, sf_dir))

    return run


# the three boosters are presets of one learner
for _name, _model in {"logreg": "logreg", "svm": "svm", "rf": "rf", "gbt_depth_4": "xgboost", "gbt_depth_5": "lightgbm", "gbt_depth_6": "catboost"}.items():
    query(f"fit_{_name}", FIT_SQL)(_fit_query(_model))


@query("tuned_logreg", FIT_SQL)
def tuned_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = quality_rows(spark, sf_dir)
    best = tune_classifier("logreg", parts["train"], parts["validation"], "quality", 10)
    return checked_fit("logreg", parts, best)


@query("disease_benchmark")
def disease_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = disease_benchmark(
        materialize(site_panel(spark, sf_dir)), SITE, ["logreg", "simcast", "arima"], variants=["interaction_fe"], fallback=True
    )
    return out["runs"].drop("seconds")


@query("simple_benchmark")
def simple_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = materialize(site_panel(spark, sf_dir))
    return simple_benchmark(panel, SITE, ["logreg", "blitecast"], fallback=True)["runs"]


@query("weather_benchmark")
def weather_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = materialize(site_panel(spark, sf_dir))
    out = weather_benchmark(panel, SITE, ["lightgbm_hybrid"], [7], params={"n_trees": 2, "max_depth": 3})
    return out["summary"].drop("seconds")
