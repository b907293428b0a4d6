"""Queries over scores, gates, filters, neighbours and classifier searches."""

from pyspark.sql import functions as F

from strideline.models import isolation as iso
from strideline.models import metrics as me
from strideline.models import neighbours as nn
from strideline.models import search as se
from strideline.operators.splits import stratified_split
from workload.base import query, r6, table
from workload.segments import HASHED_SQL


def judged(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("actual"), F.col("toxic").alias("predicted"))


@query("i10_accuracy", "SELECT round(avg((quality = toxic)::INTEGER), 6) AS accuracy FROM labels")
def _(spark, sf):
    return me.accuracy(judged(spark, sf), "actual", "predicted").select(r6("accuracy"))


@query("i11_confusion_matrix", """WITH l AS (SELECT DISTINCT quality AS v FROM labels UNION SELECT toxic FROM labels)
SELECT a.v AS actual, b.v AS predicted, count(labels.doc_id) AS rows FROM l a, l b LEFT JOIN labels ON labels.quality = a.v AND labels.toxic = b.v GROUP BY 1, 2""")
def _(spark, sf):
    return me.confusion_matrix(judged(spark, sf), "actual", "predicted")


REPORT_SQL = """
WITH l AS (SELECT DISTINCT quality AS v FROM labels UNION SELECT toxic FROM labels),
c AS (SELECT v, (SELECT count(*) FROM labels WHERE quality = v) AS support, (SELECT count(*) FROM labels WHERE toxic = v) AS said,
  (SELECT count(*) FROM labels WHERE quality = v AND toxic = v) AS hits FROM l),
p AS (SELECT CAST(v AS VARCHAR) AS entry, coalesce(hits::DOUBLE / nullif(said, 0), 0) AS precision, coalesce(hits::DOUBLE / nullif(support, 0), 0) AS recall,
  coalesce(2.0 * hits / nullif(said + support, 0), 0) AS f1, support, hits FROM c)
SELECT entry, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM p
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits)::DOUBLE / sum(support), 6), sum(support)::BIGINT FROM p
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM p
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM p"""


@query("i12_classification_report", REPORT_SQL)
def _(spark, sf):
    out = me.classification_report(judged(spark, sf), "actual", "predicted")
    return out.select("entry", r6("precision"), r6("recall"), r6("f1"), "support")


# Combinations of a sweep: supplier and line number of every sold item, train and test by flag.
COMBO_SQL = """cm AS (SELECT l_suppkey AS combo, CASE l_returnflag WHEN 'A' THEN 'train' WHEN 'R' THEN 'test' ELSE 'valid' END AS part,
  CASE WHEN l_quantity < 20 THEN 1.0 ELSE 3.0 END::DOUBLE AS label FROM lineitem)"""


def combos(spark, sf):
    part = F.when(F.col("l_returnflag") == "A", "train").when(F.col("l_returnflag") == "R", "test").otherwise("valid")
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("combo"), part.alias("part"), F.when(F.col("l_quantity") < 20, 1.0).otherwise(3.0).alias("label")
    )


SHARES_SQL = COMBO_SQL + """,
sh AS (SELECT combo, part, count(*) FILTER (label = 1)::DOUBLE / count(*) AS share FROM cm GROUP BY 1, 2),
gate AS (SELECT combo, max(share) FILTER (part = 'train') AS train_share, max(share) FILTER (part = 'test') AS test_share,
  count(*) FILTER (share > 0.36 AND share < 0.4 AND part IN ('train', 'test')) = 2 AS distribution_ok FROM sh GROUP BY 1)"""


@query("i13_representative", f"WITH {SHARES_SQL} SELECT combo, round(train_share, 6) AS train_share, round(test_share, 6) AS test_share, distribution_ok FROM gate")
def _(spark, sf):
    out = me.representative(combos(spark, sf), ["combo"], "part", "label", 1.0, 0.36, 0.4)
    return out.select("combo", r6("train_share"), r6("test_share"), "distribution_ok")


@query("i14_enough_rows", f"""WITH {COMBO_SQL} SELECT combo, count(*) FILTER (part = 'train') AS train_rows, count(*) FILTER (part = 'test') AS test_rows
FROM cm GROUP BY 1 HAVING train_rows >= 200 AND test_rows >= 200""")
def _(spark, sf):
    return me.enough_rows(combos(spark, sf), ["combo"], "part", 200)


SCORE_SQL = """sc AS (SELECT l_suppkey AS combo, CASE l_linenumber % 4 WHEN 1 THEN 'svc' WHEN 2 THEN 'cart_tree' WHEN 3 THEN 'random_forrest' ELSE 'mlp_classifier' END AS model,
  round(avg(l_discount) * 10, 1) AS score FROM lineitem GROUP BY 1, 2)"""


def scores(spark, sf):
    kind = F.col("l_linenumber") % 4
    name = F.when(kind == 1, "svc").when(kind == 2, "cart_tree").when(kind == 3, "random_forrest").otherwise("mlp_classifier")
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("combo"), name.alias("model")).agg(
        F.round(F.avg("l_discount") * 10, 1).alias("score"))


@query("i15_best_model", f"""WITH {SCORE_SQL} SELECT combo, model, score FROM sc WHERE score > 0
ORDER BY score DESC, combo, list_position(['svc', 'cart_tree', 'random_forrest', 'mlp_classifier'], model) LIMIT 1""")
def _(spark, sf):
    return me.best_model(scores(spark, sf))


@query("j6_run_summary", f"""WITH {SHARES_SQL}, {SCORE_SQL} SELECT gate.combo, round(train_share, 6) AS train_share, round(test_share, 6) AS test_share, distribution_ok, model, score
FROM gate LEFT JOIN sc USING (combo)""")
def _(spark, sf):
    shares = me.representative(combos(spark, sf), ["combo"], "part", "label", 1.0, 0.36, 0.4)
    out = me.run_summary(shares, scores(spark, sf), ["combo"])
    return out.select("combo", r6("train_share"), r6("test_share"), "distribution_ok", "model", "score")


# --- filters and classifiers over the embeddings -----------------------------------------

FEATURES = [f"e{i}" for i in range(64)]


def vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", (F.col("label") >= 5).cast("double").alias("label"), F.col("embedding").cast("array<double>").alias("series"),
                    *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(FEATURES)])


@query("i1_isolation_filter")
def _(spark, sf):
    return iso.isolation_filter(vectors(spark, sf), FEATURES, ["vec_id"], contamination=0.05).select("vec_id", "label")


# Short searches: few iterations and shallow trees.
SHORT = {
    "svc": {"max_iter": (2, 5), "kernel": ["rbf", "linear"]}, "cart_tree": {"max_depth": (1, 4)},
    "random_forrest": {"max_depth": (1, 4), "n_estimators": (2, 8)}, "mlp_classifier": {"max_iter": (2, 8)},
}


def search(spark, sf, model_type, draws=2, folds=2, space=None):
    parts = stratified_split(vectors(spark, sf), "label", "vec_id", 0.3, seed=1)
    train, test = parts.where("part = 'train'"), parts.where("part = 'test'")
    found = se.random_search(train, FEATURES, "label", "vec_id", model_type, draws=draws, folds=folds, space=space)
    return se.predict(found.model, test, FEATURES, ["vec_id", "label"])


@query("i2_i3_search_tree")
def _(spark, sf):
    """The whole search: 50 settings of the whole space by 5 folds."""
    return search(spark, sf, "cart_tree", draws=50, folds=5)


@query("i4_search_forest")
def _(spark, sf):
    return search(spark, sf, "random_forrest", space=SHORT["random_forrest"])


@query("i5_search_svc")
def _(spark, sf):
    return search(spark, sf, "svc", space=SHORT["svc"])


@query("i6_search_mlp")
def _(spark, sf):
    """10 settings of the whole space by 5 folds."""
    return search(spark, sf, "mlp_classifier", draws=10, folds=5)


def knn_sql(distance: str) -> str:
    return f"""WITH {HASHED_SQL.format(seed=1)},
pt AS (SELECT e.vec_id, e.label, e.embedding::DOUBLE[] AS v, rk < floor(n * 0.3) AS test FROM embeddings e JOIN hr USING (vec_id)),
ds AS (SELECT a.vec_id, b.vec_id AS neighbour, b.label, {distance} AS d FROM pt a JOIN pt b ON a.test AND NOT b.test),
nb AS (SELECT * FROM ds QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) <= 5),
vt AS (SELECT vec_id, label, count(*) AS c FROM nb GROUP BY 1, 2)
SELECT vec_id, label::DOUBLE AS prediction FROM vt QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) = 1"""


def knn(spark, sf, metric):
    e = table(spark, sf, "embeddings")
    parts = stratified_split(e, "label", "vec_id", 0.3, seed=1)
    return nn.knn_predict(parts.where("part = 'train'"), parts.where("part = 'test'"), "vec_id", "embedding", "label", 5, metric)


@query("i7_knn_euclidean", knn_sql("list_distance(a.v, b.v)"))
def _(spark, sf):
    return knn(spark, sf, "euclidean")


@query("i7_knn_cityblock", knn_sql("list_sum(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i])))"))
def _(spark, sf):
    return knn(spark, sf, "cityblock")


@query("i7_knn_sqeuclidean", knn_sql("list_distance(a.v, b.v) ** 2"))
def _(spark, sf):
    return knn(spark, sf, "sqeuclidean")


@query("i7_knn_dtw")
def _(spark, sf):
    return knn(spark, sf, "dtw")


@query("i7_knn_softdtw")
def _(spark, sf):
    return knn(spark, sf, "softdtw")


@query("i8_series_svc")
def _(spark, sf):
    """Support vectors on whole series taken as vectors."""
    e = vectors(spark, sf)
    names = [f"s{i}" for i in range(64)]
    wide = e.select("vec_id", "label", *[F.col("series")[i].alias(n) for i, n in enumerate(names)])
    parts = stratified_split(wide, "label", "vec_id", 0.3, seed=1)
    found = se.random_search(parts.where("part = 'train'"), names, "label", "vec_id", "svc", draws=1, folds=2, space=SHORT["svc"])
    return se.predict(found.model, parts.where("part = 'test'"), names, ["vec_id", "label"])


@query("i9_predict")
def _(spark, sf):
    """Accuracy of a stored tree on the rows held back."""
    return me.accuracy(search(spark, sf, "cart_tree", space=SHORT["cart_tree"]), "label", "prediction")
