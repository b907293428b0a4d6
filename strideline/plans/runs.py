"""Training, inference and experiment runs."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.functions.features import extract_features
from strideline.functions.motifs import MOTIF_COLUMNS, infer_motifs, sweep_motifs
from strideline.functions.scalar import known
from strideline.functions.relevance import imputation_values, impute, impute_wide, melt_features, relevance_table, replay_catalogue
from strideline.materialise import cut
from strideline.models.isolation import isolation_filter
from strideline.models.metrics import best_model, classification_report, confusion_matrix, enough_rows, representative
from strideline.models.search import SearchResult, predict, random_search, score
from strideline.operators.cleaning import encode
from strideline.operators.combine import union_all
from strideline.operators.segments import chunk_evenly, homogeneous_chunks, majority_label, number_blocks
from strideline.operators.signal import REDUCED
from strideline.ordering import int_div
from strideline.plans.preparation import prepare_inference, prepare_training
from strideline.plans.settings import FEATURES, PREPARATION, Settings, digest
from strideline.sources import store

BLOCK = ["part", "block_id"]


def tag_of(settings: Settings) -> str:
    """The name of a run; runs of different settings have different names."""
    return f"{store.run_tag(settings.extractor, settings.freq, settings.reduction, settings.block_rows)}_{digest(settings)}"


class Stages:
    """Results of stages over the same readings, kept under a digest of the settings they depend on."""

    def __init__(self, readings: DataFrame, labels: DataFrame):
        self.readings, self.labels = readings, labels
        self.kept: dict[tuple[str, str], tuple] = {}

    def _once(self, name: str, key: str, make):
        if (name, key) not in self.kept:
            self.kept[name, key] = make()
        return self.kept[name, key]

    def signal(self, settings: Settings) -> tuple[DataFrame, dict[str, float]]:
        return self._once("signal", digest(settings, PREPARATION), lambda: prepare_training(self.readings, self.labels, settings))

    def features(self, settings: Settings):
        if settings.extractor not in FEATURES:
            raise ValueError(f"unknown extractor {settings.extractor!r}")
        make = statistical_tables if settings.extractor == "statistical" else motif_tables
        return self._once("features", digest(settings, FEATURES[settings.extractor]), lambda: make(self.signal(settings)[0], settings))


def training_blocks(signal: DataFrame, settings: Settings) -> DataFrame:
    """Rows of chunks with one label, renumbered into blocks: ``part, block_id, i`` and the label."""
    encoded = encode(signal, ["road_label"])
    chunks = chunk_evenly(encoded, ["part"], "idx", settings.block_rows)
    pure = homogeneous_chunks(chunks, ["part"], "chunk", "road_label")
    blocks = number_blocks(pure, ["part"], "idx", settings.block_rows, "block_id", "row", settings.slice_rows)
    return blocks.withColumn("i", F.col("row") % settings.block_rows)


def statistical_tables(signal: DataFrame, settings: Settings) -> tuple[DataFrame, list[str], DataFrame, dict]:
    """Feature table ``part, block_id, label, selected features``, the selected names, the p-values.

    Missing and infinite values are imputed before the relevance test, and in all parts, from
    the training part; the last result has these values, for inference.
    """
    blocks = cut(training_blocks(signal, settings))
    labels = majority_label(blocks, BLOCK, "road_label", "i").select(*BLOCK, F.col("label").cast("int").alias("label"))
    train = blocks.where("part = 'train'")
    everything = extract_features(train, BLOCK, "i", REDUCED, settings.catalogue)
    labelled = everything.join(labels, on=BLOCK, how="inner")
    long = cut(melt_features(labelled, [*BLOCK, "label"]))
    relevance = cut(relevance_table(cut(impute(long)), "label", settings.fdr_level))
    # One row per feature of the catalogue.
    selected = [r["feature"] for r in relevance.where("relevant").select("feature").orderBy("feature").collect()]
    if not selected:
        raise ValueError("no feature passed the relevance test")
    wanted = replay_catalogue(selected)[REDUCED]
    wide = extract_features(blocks, BLOCK, "i", REDUCED, wanted)
    features = wide.join(labels, on=BLOCK, how="inner").select(*BLOCK, "label", *[f"`{s}`" for s in selected])
    known_values = imputation_values(long.where(F.col("feature").isin(selected))).collect()
    found = {r["feature"]: {k: r[k] for k in ("middle", "low", "high")} for r in known_values}
    values = {s: found.get(s, {}) for s in selected}
    return cut(impute_wide(features, values)), selected, relevance, values


def motif_tables(signal: DataFrame, settings: Settings) -> DataFrame:
    """Motif features of every (radius, length) of every part: label 1 becomes 0, 3 becomes 1."""
    found = sweep_motifs(
        signal, ["part"], "idx", REDUCED, "road_label", settings.radii, settings.lengths, settings.max_motifs,
        settings.slice_rows,
    )
    return cut(encode(found, ["label"]))


def _fill(df: DataFrame, columns: list[str], keep: list[str]) -> tuple[DataFrame, list[str]]:
    """``keep`` and the features under plain names ``c0, c1, ..``.

    Classifiers take no missing values; statistical features are imputed before, and what is
    still undefined counts as zero.
    """
    names = [f"c{i}" for i in range(len(columns))]
    filled = [
        F.coalesce(known(F.col(f"`{c}`")), F.lit(0.0)).alias(n) for c, n in zip(columns, names)
    ]
    return df.select(*keep, *filled), names


def _search(
    combo: int, table: DataFrame, columns: list[str], row_keys: list[str], settings: Settings
) -> tuple[list[dict], dict, dict[str, SearchResult]]:
    """Filter, gate and search one feature table; returns scores, shares and models."""
    filled, names = _fill(table, columns, [*dict.fromkeys(["part", *row_keys, "label"])])
    filled = filled.withColumn("_row", F.abs(F.xxhash64(*row_keys)) % F.lit(1 << 40))
    parts = [
        isolation_filter(
            filled.where(F.col("part") == p), names, row_keys, settings.contamination, settings.trees,
            settings.tree_rows, settings.seed,
        ) for p in ("train", "test")
    ]
    kept = cut(union_all(parts)).withColumn("combo", F.lit(combo))
    low, high = settings.class_bounds
    # The gate is on the share of city, which the encoding makes 0.
    gate = representative(kept, ["combo"], "part", "label", 0, low, high).first().asDict()
    if not gate["distribution_ok"] or enough_rows(kept, ["combo"], "part", settings.folds).isEmpty():
        return [], gate, {}
    train, test = kept.where("part = 'train'"), kept.where("part = 'test'")
    scores, models = [], {}
    for name in settings.models:
        found = random_search(
            train, names, "label", "_row", name, settings.draws, settings.folds, seed=settings.seed,
            space=settings.space.get(name),
        )
        scores.append({"combo": combo, "model": name, "score": score(found, test, "label")})
        models[name] = found
    return scores, gate, models


def train_run(
    spark: SparkSession, readings: DataFrame, labels: DataFrame, settings: Settings, root: str, stages: Stages | None = None
) -> DataFrame:
    """Prepare, extract, search, validate and store; returns the run summary.

    ``stages`` holds what other runs over the same readings have made.
    """
    tag, stages = tag_of(settings), stages or Stages(readings, labels)
    stats, made = stages.signal(settings)[1], stages.features(settings)
    selected, values, combos = [], {}, []
    if settings.extractor == "statistical":
        table, selected, _p, values = made
        combos.append((None, None, table, selected, BLOCK))
    else:
        table = made
        for radius in settings.radii:
            for length in settings.lengths:
                rows = table.where((F.col("radius") == radius) & (F.col("length") == length))
                combos.append((radius, length, rows, MOTIF_COLUMNS, ["part", "motif", "occurrence"]))

    scores, gates, models, tables = [], [], {}, {}
    for number, (radius, length, rows, columns, row_keys) in enumerate(combos):
        if rows.where("part = 'train'").isEmpty() or rows.where("part = 'test'").isEmpty():
            continue
        found, gate, trained = _search(number, rows, columns, row_keys, settings)
        scores += found
        gates.append({"combo": number, "radius": None if radius is None else float(radius), "length": length, **{k: gate[k] for k in ("train_share", "test_share", "distribution_ok")}})
        models.update({(number, name): result for name, result in trained.items()})
        tables[number] = (rows, columns, row_keys, radius, length)
    if not scores:
        raise ValueError("no combination passed the gates")

    score_table = spark.createDataFrame(scores, "combo int, model string, score double")
    gate_table = spark.createDataFrame(
        gates, "combo int, radius double, length int, train_share double, test_share double, distribution_ok boolean"
    )
    best = best_model(score_table).first()
    chosen = models[(best["combo"], best["model"])]
    rows, columns, row_keys, radius, length = tables[best["combo"]]

    held, names = _fill(rows.where("part = 'valid'"), columns, [*row_keys, "label"])
    valid = isolation_filter(
        held, names, row_keys, settings.contamination, settings.trees, settings.tree_rows, settings.seed
    )
    said = cut(predict(chosen.model, valid, names, [*row_keys, "label"]).withColumn("label", F.col("label").cast("double")))
    report = [r.asDict() for r in classification_report(said, "label", "prediction").collect()]
    matrix = [r.asDict() for r in confusion_matrix(said, "label", "prediction").collect()]

    for number, (kept, *_rest) in tables.items():
        store.write_table(kept, root, f"features_{number}", tag)
    store.write_table(said, root, "validation", tag)
    store.write_model(chosen.model, f"{root}/model/run_tag={tag}")
    notes = {
        "stats": stats, "features": columns, "radius": radius, "length": length, "model": best["model"],
        "params": chosen.params, "score": best["score"], "report": report, "confusion": matrix,
        "selected": selected, "imputation": values, "settings": {k: v for k, v in asdict(settings).items() if k != "catalogue"},
    }
    store.write_notes(spark, notes, root, tag)
    summary = gate_table.join(score_table, on="combo", how="left").withColumn("run_tag", F.lit(tag)).withColumn(
        "chosen", F.coalesce((F.col("combo") == best["combo"]) & (F.col("model") == best["model"]), F.lit(False))
    )
    store.write_table(summary, root, "summary", tag)
    return store.read_table(spark, root, "summary", tag)


def inference_run(spark: SparkSession, readings: DataFrame, settings: Settings, root: str) -> DataFrame:
    """Predict new readings with what :func:`train_run` stored; writes and returns the predictions."""
    tag = tag_of(settings)
    notes = store.read_notes(spark, root, tag)
    model = store.load_model(f"{root}/model/run_tag={tag}")
    signal = cut(prepare_inference(readings, notes["stats"], settings))
    if settings.extractor == "motif":
        table = infer_motifs(signal, [], "idx", REDUCED, radius=notes["radius"], length=notes["length"], max_motifs=settings.max_motifs)
        keys = ["motif", "occurrence"]
    else:
        blocks = signal.select(
            int_div("idx", settings.block_rows).alias("block_id"), (F.col("idx") % settings.block_rows).alias("i"), REDUCED
        )
        wanted = replay_catalogue(notes["selected"])[REDUCED]
        table = impute_wide(extract_features(blocks, ["block_id"], "i", REDUCED, wanted), notes["imputation"])
        keys = ["block_id"]
    filled, names = _fill(table, notes["features"], keys)
    said = predict(model, filled, names, keys)
    store.write_table(said, root, "predictions", tag)
    return store.read_table(spark, root, "predictions", tag)


def experiment_grid(
    spark: SparkSession, readings: DataFrame, labels: DataFrame, grid: list[Settings], root: str
) -> DataFrame:
    """Train every setting of the grid and union the summaries.

    Stages that settings share are computed once; equal settings are refused, they would overwrite each other.
    """
    tags = [tag_of(s) for s in grid]
    if len(set(tags)) < len(tags):
        raise ValueError("the grid holds equal settings")
    stages = Stages(readings, labels)
    return union_all([train_run(spark, readings, labels, s, root, stages) for s in grid])
