"""What the two classifiers share: fitting on the rows they may learn from, scoring by batch, and calibration."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship, tidy
from .textkit import chunks, text_bytes

FOLDS = 5
#: So many ids with labels are broadcast (some 32 MB).
BROADCAST_MOST = 2_000_000


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 0 by FOLDS: such rows are never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def known_labels(labels: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """(l_id, y): labels 0 or 1 of ids that are not held out, the largest of each id."""
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("l_id").isNotNull() & ~held_out(F.col("l_id")))
    return known.groupBy("l_id").agg(F.max("y").alias("y"))


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str) -> tuple[DataFrame, float]:
    """(id, y, lang or "", text) of every document with a label that may be learnt from, and the share of class 1 among the labels.

    The labels are counted, and broadcast up to BROADCAST_MOST of them; more are joined by a shuffle.
    """
    known = known_labels(labels, label_col, id_col)
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(lang.cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(known) if n <= BROADCAST_MOST else known, F.col("id") == F.col("l_id"))
    return rows.select("id", "y", "lang", "text"), counts.get(1, 0) / max(1, n)


def fit_in_task(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, per_class: int, text_bytes_most: int, class_bytes_most: int, fit: Callable[[pa.Table, float], object]) -> tuple[object | None, float]:
    """fit(sample, share) run by one task, and the share of class 1 among all labelled rows that are not held out.

    The sample (columns y, lang or null, text, in order of ids) has at most per_class labelled rows of either class,
    lowest hash first, of at most class_bytes_most bytes a class; texts beyond text_bytes_most bytes are left out.
    Its ids are bounded and are broadcast, its texts never reach the driver, the fitted object does. Without any row
    there is nothing to fit and the object is None.
    """
    ship(docs.sparkSession)
    known = known_labels(labels, label_col, id_col)
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("l_id"), "l_id").limit(per_class) for y in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(sample, F.col("id") == F.col("l_id")).where(F.octet_length("text") <= text_bytes_most)
    so_far = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("bytes", F.sum(F.octet_length("text").cast("long")).over(so_far)).where(F.col("bytes") <= class_bytes_most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if any(b.num_rows for b in held):
            table = pa.Table.from_batches(held)
            order = np.argsort(table["id"].to_numpy(zero_copy_only=False), kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(table.take(pa.array(order)), share))], pa.binary())], names=["fitted"])

    found = rows.select("id", "y", "lang", "text").repartition(1).mapInArrow(run, "fitted binary").collect()
    fitted = pickle.loads(found[0]["fitted"]) if found else None
    del found
    tidy(docs.sparkSession)
    return fitted, share


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def platt(margins: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins, by damped Newton steps."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(steps):
        p = sigmoid(a * margins + b)
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * margins * margins).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-7:
            break
    return float(max(a, 1e-3)), float(b)


def score_batches(score: Callable[[np.ndarray, np.ndarray], np.ndarray], text_at: int) -> Callable:
    """A mapInArrow function that puts a score column after the others, in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(text_at))
            out = np.zeros(batch.num_rows)
            for lo, hi in chunks(offsets):
                out[lo:hi] = score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            rest = [c for i, c in enumerate(batch.columns) if i != text_at]
            names = [c for i, c in enumerate(batch.schema.names) if i != text_at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.round(out, 6))], names=[*names, "score"])

    return run
