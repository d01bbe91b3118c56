"""Training curves: configuration, a simulated curve, early stopping and best epochs."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import CURVE_DECAY, CURVE_FALL, CURVE_FLOOR, CURVE_LEAST, CURVE_NOISE, CURVE_PLATEAU, CURVE_START


@dataclass(frozen=True)
class TrainingConfig:
    """Hyper-parameters of a fine-tuning run."""

    epochs: int = 10
    batch_size: int = 8
    learning_rate: float = 1e-4
    lora_r: int = 8
    lora_alpha: int = 16
    patience: int = 3

    def to_dict(self) -> dict:
        return asdict(self)


def early_stopping(curve: DataFrame, *keys: str, epoch: str = "epoch", value: str = "cer", patience: int = 3) -> DataFrame:
    """The rows of each curve up to the epoch that ends `patience` epochs in a row without a new strict minimum."""
    w = Window.partitionBy(*keys).orderBy(epoch)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = curve.withColumn("__better", F.coalesce(F.col(value) < F.min(value).over(before), F.lit(True)))
    last = F.max(F.when(F.col("__better"), F.col("__n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__n", F.row_number().over(w)).withColumn("__stop", F.col("__n") - last >= patience)
    stopped = F.coalesce(F.max(F.col("__stop").cast("int")).over(before), F.lit(0))
    return rows.withColumn("__stopped", stopped).where("__stopped = 0").drop("__better", "__n", "__stop", "__stopped")


def best_epoch(curve: DataFrame, *keys: str, epoch: str = "epoch", value: str = "cer") -> DataFrame:
    """The least value of each curve and its first epoch."""
    return curve.groupBy(*keys).agg(F.min(value).alias("best_value"), F.min_by(epoch, F.struct(value, epoch)).alias("best_epoch"), F.count(F.lit(1)).alias("n_epochs"))


def simulated_curve(spark: SparkSession, n_train: int, config: TrainingConfig = TrainingConfig(), seed: int = 42) -> DataFrame:
    """(epoch, cer): an exponential descent to a plateau with seeded noise, stopped early. As many rows as epochs."""
    start, plateau = CURVE_START, max(CURVE_LEAST, CURVE_PLATEAU - n_train * CURVE_FALL)
    noise = np.random.default_rng(seed).normal(0, CURVE_NOISE, config.epochs)
    rows = [(e, float(noise[e - 1])) for e in range(1, config.epochs + 1)]
    cer = F.greatest(F.lit(plateau * CURVE_FLOOR), F.lit(start) - F.lit(start - plateau) * (1 - F.exp(-CURVE_DECAY * F.col("epoch"))) + F.col("noise"))
    curve = spark.createDataFrame(rows, "epoch int, noise double").select("epoch", cer.alias("cer"), F.lit(0).alias("run"))
    return early_stopping(curve, "run", patience=config.patience).select("epoch", "cer")


def history(curve: DataFrame) -> dict:
    """The curve's values rounded to 4 digits, its best value and epoch."""
    rows = curve.orderBy("epoch").collect()
    best = min(rows, key=lambda r: (r["cer"], r["epoch"]))
    return {"cer_par_epoch": [round(r["cer"], 4) for r in rows], "meilleur_cer": round(best["cer"], 4), "meilleure_epoch": best["epoch"]}


def save_curve(found: dict, config: TrainingConfig, folder: str) -> str:
    """The history with its configuration as JSON on the driver; a run of the same rank replaces it."""
    path = Path(folder) / f"courbe_lora_r{config.lora_r}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"config": config.to_dict(), **found}, indent=2, ensure_ascii=False), encoding="utf-8")
    return str(path)


def fine_tune(spark: SparkSession, n_train: int, folder: str, config: TrainingConfig = TrainingConfig(), journal_path: str | None = None, seed: int = 42) -> dict:
    """A simulated run: its history, saved, and noted in the journal."""
    from ..sources import journal

    found = history(simulated_curve(spark, n_train, config, seed))
    save_curve(found, config, folder)
    if journal_path:
        journal.append_entry(spark, journal_path, f"finetune_trocr_lora_r{config.lora_r}", config.to_dict(), {"meilleur_cer_val": found["meilleur_cer"]}, f"Fine-tuning sur {n_train} lignes")
    return found
