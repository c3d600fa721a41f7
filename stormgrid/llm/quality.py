"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormgrid.llm.common import materialize, sliced, small_batches, table

THRESHOLD = 0.3
SEED = 20240
WIDTH = 192  # random features
BANDWIDTH = 4.0  # of the Gaussian kernel, in standard deviations of the statistics
RIDGE = 1e-3  # times the number of training rows
CELLS = 1000  # of the raw score's unit, for calibration
FAN = 32  # partial sums that one task adds up

#: Statistics of a text that the kernel sees. None depends on the number of the row or its tags.
STATISTICS = [
    "log_bytes", "log_words", "word_length", "word_spread", "distinct", "top_word", "repeats", "letters",
    "upper", "digits", "commas", "marks", "odd_marks", "blanks", "log_lines", "same_lines", "entropy",
]

_CLASSES = {
    "letters": [*range(65, 91), *range(97, 123), *range(128, 256)],
    "upper": range(65, 91),
    "digits": range(48, 58),
    "commas": [44, 46],
    "marks": [33, 34, 39, 40, 41, 45, 58, 59, 63],
    "odd_marks": [35, 36, 37, 38, 42, 43, 47, *range(60, 63), 64, *range(91, 97), *range(123, 127)],
    "blanks": [9, 10, 13, 32],
}
_MASKS = np.array([[b in x for b in range(256)] for x in map(set, _CLASSES.values())], float).T


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text; those of an empty text are all 0."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(data)
    shares = counts @ _MASKS / n
    p = counts[counts > 0] / n
    tally = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    again = sum(map(bytes.__eq__, words[1:], words[:-1]))
    lines = data.split(b"\n")
    return [
        np.log1p(n),
        np.log1p(len(words)),
        min(float(sizes.mean()), 40.0),
        min(float(sizes.std()), 40.0),
        len(tally) / len(words) ** 0.9,
        max(tally.values()) / len(words),
        again / len(words),
        *shares.tolist(),
        np.log1p(len(lines)),
        1 - len(set(lines)) / len(lines),
        float(-(p * np.log2(p)).sum()),
    ]


def featurize(df: DataFrame, text_col: str = "text", out: str = "stats") -> DataFrame:
    """Add ``out``, the statistics of the whole text, rounded so that sums of them are exact."""
    keep = [c for c in df.columns if c.lower() not in (out.lower(), text_col.lower())]
    schema = df.select(*keep, F.array(F.lit(0.0)).alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.round(statistics(t), 6).tolist() for t in batch.column(text_col).to_pylist()]
            columns = [*(batch.column(c) for c in keep), pa.array(rows, pa.list_(pa.float64()))]
            yield from sliced(pa.RecordBatch.from_arrays(columns, [*keep, out]))

    return df.mapInArrow(run, schema)


@dataclass
class Model:
    """Standardised statistics -> random features -> ridge score -> calibrated score."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores
    levels: np.ndarray  # their calibrated scores

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Cosine features, in whole 4096ths: sums of their products are whole numbers, exact in any order."""
        rng = np.random.default_rng(SEED)
        directions = rng.standard_normal((len(STATISTICS), WIDTH)) / BANDWIDTH
        phases = rng.uniform(0, 2 * np.pi, WIDTH)
        x = np.clip((stats - self.mean) / self.spread, -8, 8)
        z = np.cos(x @ directions + phases)
        return np.concatenate([np.round(z * 4096), np.full((len(x), 1), 4096.0)], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0.0, 1.0)


def _stack(column) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(-1, len(STATISTICS))


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each statistic, from exact decimal sums."""
    whole = [F.round(F.col("stats")[k] * 1_000_000).cast("decimal(20,0)") for k in range(len(STATISTICS))]
    sums = [F.sum(x).alias(f"a{k}") for k, x in enumerate(whole)]
    squares = [F.sum((x * x).cast("decimal(38,0)")).alias(f"b{k}") for k, x in enumerate(whole)]
    got = rows.agg(F.count("*").alias("n"), *sums, *squares).first()
    n = max(got["n"], 1)
    mean = np.array([float(got[f"a{k}"] or 0) / n for k in range(len(STATISTICS))]) / 1e6
    square = np.array([float(got[f"b{k}"] or 0) / n for k in range(len(STATISTICS))]) / 1e12
    spread = np.sqrt(np.maximum(square - mean**2, 0))
    return mean, np.where(spread > 1e-6, spread, 1.0)


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """Z'Z, Z'y and the row count: one sum for each partition, added up in a tree of ``FAN``."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((WIDTH + 2, WIDTH + 1))
        for frame in frames:
            z = model.features(_stack(frame["stats"]))
            total[:-1] += z.T @ z
            total[-1] += z.T @ frame["label"].to_numpy(float)
        yield pd.DataFrame({"node": [TaskContext.get().partitionId()], "total": [total.tobytes()]})

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in frame["total"])
        return pd.DataFrame({"node": [int(frame["node"].iloc[0])], "total": [total.tobytes()]})

    schema = "node bigint, total binary"
    sums = rows.select("stats", "label").mapInPandas(partial, schema)
    for _ in range(2):
        sums = sums.withColumn("node", F.expr(f"node div {FAN}")).groupBy("node").applyInPandas(added, schema)
    # What is left: one row of WIDTH**2 numbers for each 1024 partitions.
    total = sum(np.frombuffer(x["total"]) for x in sums.toLocalIterator())
    total = np.reshape(total, (WIDTH + 2, WIDTH + 1)) if np.ndim(total) else np.zeros((WIDTH + 2, WIDTH + 1))
    return total[:-1], total[-1], float(total[WIDTH, WIDTH]) / 4096**2


def isotonic(counts: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """The non-decreasing rates nearest to positives / counts: pools of adjacent violators."""
    pools: list[list[float]] = []
    for n, k in zip(counts.tolist(), positives.tolist(), strict=True):
        pools.append([n, k, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n1, k1, m1 = pools.pop()
            pools[-1] = [pools[-1][0] + n1, pools[-1][1] + k1, pools[-1][2] + m1]
    return np.concatenate([np.full(m, k / n) for n, k, m in pools]) if pools else np.zeros(0)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def fit(rows: DataFrame) -> Model:
    """Fit on ``rows`` with stats, label (0 or 1) and fold: folds 1 to 3 for ridge, 4 for calibration."""
    ridge, calibration = rows.where("fold in (1, 2, 3)"), rows.where("fold = 4")
    mean, spread = _moments(ridge)
    model = Model(mean, spread, np.zeros(WIDTH + 1), np.array([0.0]), np.array([0.5]))
    zz, zy, n = _normal_equations(ridge, model)
    if not n:
        return model
    penalty = np.full(WIDTH + 1, RIDGE * n * 4096**2)
    penalty[-1] = 1e-9
    model.weights = np.linalg.solve(zz + np.diag(penalty), zy)
    fitted = Model(**vars(model))

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cell = np.clip(np.floor(fitted.raw(_stack(frame["stats"])) * CELLS), -2 * CELLS, 3 * CELLS)
            yield pd.DataFrame({"cell": cell.astype(np.int64), "label": frame["label"].to_numpy(np.int64)})

    tally = calibration.select("stats", "label").mapInPandas(cells, "cell bigint, label bigint")
    # At most 5 * CELLS rows, however many documents there are.
    tally = tally.groupBy("cell").agg(F.count("*").alias("n"), F.sum("label").alias("k")).orderBy("cell").toPandas()
    if len(tally):
        model.knots = (tally["cell"].to_numpy(float) + 0.5) / CELLS
        model.levels = isotonic(tally["n"].to_numpy(float), tally["k"].to_numpy(float))
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """Score every document: doc_id, held_out, score (0 to 1, higher is better), predicted, and rows.

    One pass over the texts makes their statistics, which are kept in the shared folder. A ridge
    model on random Fourier features (a Gaussian kernel's approximation) is fitted from sums of
    each partition over all labelled rows of three folds, and calibrated on a fourth by isotonic
    regression over a grid of raw scores. Fold 0 is never learned from.

    Null and empty texts have statistics 0 and a score like any other. Rows with a null id are
    scored but not learned from; repeated rows are scored alike; null labels are left out, of
    contradicting ones the smaller counts. Without labels every score is 0.5. Other columns are
    not read but for those of ``keep``, which are returned as well; an empty table gives no rows.
    """
    stats = featurize(docs.select("doc_id", *keep, "text"))
    stats = materialize(stats.withColumn("fold", fold_of(F.col("doc_id")).cast("int")), "quality")
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"))
    train = stats.where("fold > 0").join(known, "doc_id").select("stats", "label", "fold")
    model = fit(train)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            columns = [*(batch.column(c) for c in ("doc_id", *keep, "fold")), pa.array(model.score(x), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *keep, "fold", "score"])

    schema = stats.select("doc_id", *keep, "fold", F.lit(0.0).alias("score")).schema
    return stats.mapInArrow(apply, schema).select(
        "doc_id",
        *keep,
        (F.col("fold") == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
