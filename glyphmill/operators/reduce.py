"""How far a matrix can be compressed: truncated SVD and PCA reports from one decomposition each.

The spectrum is computed once at the largest rank; every smaller rank is a prefix of it. It comes from a randomised range
finder (``factor``), or from the columns' sums of products (``moments``) where those are few and most of them are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions.scalars import WINDOW, dim_ladder, max_components
from glyphmill.operators import factor
from glyphmill.operators.windows import parts_of, weight_literals
from glyphmill.sources.catalog import decimals

THRESHOLD = 0.95
#: Columns up to which their products may be summed: 8 bytes times their square on the driver, 512 MB.
GRAMIAN = 8192
#: Products of entries that a task holds before it sums them up.
PRODUCTS = 4_000_000
#: Entries of a Gramian that a task holds whole, 8 bytes each: products are then added in place and never sorted.
DENSE = 4_000_000
#: Number of rows, sums of the columns, and the Gramian.
Moments = tuple[int, np.ndarray, np.ndarray]


def dense_features(rows: DataFrame, values: str) -> DataFrame:
    return rows.select(F.sequence(F.lit(0), F.size(values) - 1).alias("indices"), F.col(values).cast("array<double>").alias("values"))


def sparse_features(vectors: DataFrame) -> DataFrame:
    """From (indices, values) of the windows."""
    return vectors.select("indices", F.col("values").cast("array<double>").alias("values"))


def moments(features: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, sums of the columns, and the Gramian, from rows (indices, values) without repeated indices."""
    if size >= 1 << 31:
        raise ValueError("too many columns")

    dense = size * size <= DENSE

    def triangles(column: np.ndarray, value: np.ndarray, width: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys and products of the entries of a row with itself and those behind it, for many rows of one width at once."""
        starts = np.cumsum(width) - width
        for w in np.unique(width[width > 0]).tolist():
            a, b = np.triu_indices(w)
            rows, most = starts[width == w], max(1, PRODUCTS // 4 // len(a))
            for lo in range(0, len(rows), most):
                at = rows[lo : lo + most, None] + np.arange(w)
                j, x = column[at], value[at]
                yield (j[:, a] * size + j[:, b]).ravel(), (x[:, a] * x[:, b]).ravel()

    def sums_of_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, gram, total = 0, np.zeros(size * size), np.zeros(size)
        keys, values, held = [], [], 0

        def add() -> None:
            nonlocal gram, keys, values, held
            gram += np.bincount(np.concatenate(keys), np.concatenate(values), size * size)
            keys, values, held = [], [], 0

        for batch in batches:
            n += batch.num_rows
            width = np.diff(batch.column(0).offsets.to_numpy()).astype(np.int64)
            j, x = batch.column(0).flatten().to_numpy().astype(np.int64), batch.column(1).flatten().to_numpy()
            total += np.bincount(j, x, size)
            for k, v in triangles(j, x, width):
                keys.append(k)
                values.append(v)
                held += len(k)
                if held >= PRODUCTS:
                    add()
        if held:
            add()
        gram = gram.reshape(size, size)
        gram = (np.triu(gram) + np.tril(gram, -1).T).ravel()  # whichever of the two columns came first in a row
        at, of = np.flatnonzero(gram), np.flatnonzero(total)
        keys = np.concatenate([at, -1 - of, [FEW]])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate([gram[at], total[of], [float(n)]]))], ["entry", "total"])

    def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(at, np.concatenate(values), len(k))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, keys, values, held = 0, [], [], 0

        def out() -> pa.RecordBatch:
            k, v = summed(keys, values)
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(v)], ["entry", "total"])

        for batch in batches:
            n += batch.num_rows
            column, value = batch.column(0), batch.column(1)
            width = np.diff(column.offsets.to_numpy()).astype(np.int64)
            j, x = column.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy()
            starts = np.cumsum(width) - width
            for lo in range(0, len(width), 2000):  # each entry with each entry of its row
                w, s = width[lo : lo + 2000], starts[lo : lo + 2000]
                each = np.repeat(w, w)
                left = np.repeat(np.arange(s[0], s[0] + w.sum()) if len(w) else s, each)
                place = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)
                right = np.repeat(np.repeat(s, w), each) + place
                upper = j[left] <= j[right]
                left, right = left[upper], right[upper]
                keys += [j[left] * size + j[right], -1 - j[s[0] : s[0] + w.sum()]]  # columns' sums below zero
                values += [x[left] * x[right], x[s[0] : s[0] + w.sum()]]
                held += len(left)
                if held > PRODUCTS:
                    k, v = summed(keys, values)
                    keys, values, held = [k], [v], 0
                    if len(k) > PRODUCTS // 4:
                        yield out()
                        keys, values = [], []
        keys.append(np.array([FEW]))
        values.append(np.array([float(n)]))
        yield out()

    return _collected(features.select("indices", "values").mapInArrow(sums_of_products if dense else products, "entry long, total double"), size)


def _collected(parts: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """What ``moments`` returns from the tasks' sums (entry, total)."""
    sums = parts.groupBy("entry").agg(F.sum("total").alias("total"))
    # a row of the Gramian a line: the driver reads one after another
    lines = sums.groupBy(F.when(F.col("entry") >= 0, F.floor(F.col("entry") / size)).otherwise(-1).alias("i")).agg(F.collect_list("entry").alias("entries"), F.collect_list("total").alias("totals"))
    n, column, gram = 0, np.zeros(size), np.zeros((size, size))
    for line in lines.toLocalIterator():
        entries, totals = np.array(line.entries, np.int64), np.array(line.totals)
        if line.i >= 0:
            gram[line.i, entries % size] = totals
            gram[entries % size, line.i] = totals
        else:
            n = int(totals[entries == FEW].sum())
            column[-1 - entries[entries != FEW]] = totals[entries != FEW]
    return n, column, gram


def window_moments(rows: DataFrame, size: int, bos: int, eos: int, width: int = WINDOW, tokens: str = "ids") -> tuple[int, np.ndarray, np.ndarray]:
    """What ``moments`` returns for the context vectors of all windows of rows of ids, without making them.

    Two tokens that lie d apart are together in width - d windows, always with the same pairs of weights: the Gramian is the
    counts of pairs by distance, times the sums of those weights' products. That takes width steps a token and not
    width^2 / 2. Only pairs inside the padding are in fewer windows, the same for every row.
    """
    if size >= 1 << 31 or not (0 <= bos < size and 0 <= eos < size):
        raise ValueError("too many columns, or marks outside of them")
    weight = np.array(weight_literals(width))
    apart = [float(weight[: width - d] @ weight[d:]) for d in range(width)]
    first, last = np.cumsum(weight)[::-1], np.cumsum(weight[::-1])[-2::-1]  # weights of the padding's places in each window that has some
    dense = size * size <= DENSE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, texts, total, gram = 0, 0, np.zeros(size), np.zeros(size * size if dense else 0)
        keys, values, held = [], [], 0

        def entries() -> tuple[np.ndarray, np.ndarray]:
            k, at = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
            return k, np.bincount(at, np.concatenate([np.zeros(0), *values]), len(k))

        def add() -> Iterator[pa.RecordBatch]:
            nonlocal keys, values, held
            if dense:
                gram[:] += np.bincount(np.concatenate(keys), np.concatenate(values), size * size)
                keys, values, held = [], [], 0
                return
            k, v = entries()
            keys, values, held = [k], [v], 0
            if len(k) > PRODUCTS // 4:
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v)], ["entry", "total"])
                keys, values = [], []

        for batch in batches:
            for numbers, lists in parts_of(batch.column(0), batch.column(1), 32):
                sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                token = lists.flatten().to_numpy().astype(np.int64)
                if len(token) and not 0 <= token.min() <= token.max() < size:
                    raise IndexError(f"tokens {token.min()} to {token.max()} of {size}")
                n, texts = n + int((sizes + width).sum()), texts + len(numbers)
                total += np.bincount(token, minlength=size)
                whole = sizes + 2 * width
                starts = np.cumsum(whole) - whole
                place = np.arange(int(whole.sum())) - np.repeat(starts, whole)
                p = np.full(len(place), eos)
                p[place < width] = bos
                before_end = place < np.repeat(sizes + width, whole)
                p[(place >= width) & before_end] = token
                for d in range(1, width):
                    at = np.flatnonzero(before_end & (place >= width - d))
                    a, b = p[at], p[at + d]
                    keys.append(np.minimum(a, b) * size + np.maximum(a, b))
                    values.append(np.where(a == b, 2 * apart[d], apart[d]))
                    held += len(at)
                    if held >= PRODUCTS:
                        yield from add()
        column = total * weight.sum()
        keys.append(np.arange(size) * (size + 1))
        values.append(total * apart[0])
        for mark, of in ((bos, first), (eos, last)):
            column[mark] += texts * of.sum()
            keys.append(np.array([mark * (size + 1)]))
            values.append(np.array([texts * float(of @ of)]))
        if dense:
            yield from add()
            at = np.flatnonzero(gram)
            k, v = at, gram[at]
        else:
            k, v = entries()
        of = np.flatnonzero(column)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k, -1 - of, [FEW]])), pa.array(np.concatenate([v, column[of], [float(n)]]))], ["entry", "total"])

    return _collected(rows.select("row_id", tokens).mapInArrow(run, "entry long, total double"), size)


#: The key of the number of rows.
FEW = -(1 << 62)


def _decomposed(features: DataFrame, size: int, k: int, centred: bool, accurate: bool, sums: Moments | None = None) -> tuple[int, np.ndarray, float, np.ndarray, np.ndarray]:
    """Rows, mean, sum of squares around nothing, the ``k`` largest singular values, and their right vectors as columns.

    Where most of a moderate number of columns is asked for, sparse rows' sums of products take a small part of the work of
    a QR of all columns, and lose only values below 1e-8 of the largest; ``accurate`` doesn't take that way. ``sums`` are
    what ``moments`` gives for the features, where that is known already.
    """
    k = min(k, size)
    if sums is None and (accurate or size > GRAMIAN or factor.EXACT * (k + factor.MORE) < size):
        n, column, squares = factor.column_sums(features, size)
        mean = column / max(1, n)
        s, v = factor.decomposed(features, size, k, mean if centred else None)
        return n, mean, squares, s, v
    n, column, gram = sums or moments(features, size)
    mean = column / max(1, n)
    values, v = np.linalg.eigh(gram - n * np.outer(mean, mean) if centred else gram)
    return n, mean, float(np.trace(gram)), np.sqrt(np.maximum(0.0, values[::-1][:k])), v[:, ::-1][:, :k]


def svd_spectrum(features: DataFrame, size: int, k: int, accurate: bool = False, sums: Moments | None = None) -> tuple[list[tuple[int, float, float]], np.ndarray]:
    """(component, singular value, share of the columns' variance) and the components as columns.

    Rows aren't centred, so a component's variance is s^2 / n minus its squared mean.
    """
    n, mean, squares, s, v = _decomposed(features, size, k, False, accurate, sums)
    total = squares / max(1, n) - mean @ mean
    share = (s**2 / max(1, n) - (mean @ v) ** 2) / total if total > 0 else np.zeros(len(s))
    return [(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(s, share))], v


def pca_spectrum(features: DataFrame, size: int, k: int, accurate: bool = False, sums: Moments | None = None) -> tuple[list[tuple[int, float, float]], np.ndarray]:
    """The same for centred rows: a singular value is the root of (n - 1) times the component's variance."""
    n, mean, squares, s, v = _decomposed(features, size, k, True, accurate, sums)
    total = max(squares - n * (mean @ mean), 0.0)
    return [(i + 1, float(a), float(a * a / total) if total > 0 else 0.0) for i, a in enumerate(s)], v


def spectrum_table(spark: SparkSession, spectrum: list[tuple[int, float, float]]) -> DataFrame:
    return spark.createDataFrame(spectrum, "component int, singular_value double, ratio double")


def components_table(spark: SparkSession, v: np.ndarray) -> DataFrame:
    """The fitted model: one row a component; its first ``k`` rows are the model of rank ``k``."""
    return spark.createDataFrame([(i + 1, [float(x) for x in v[:, i]]) for i in range(v.shape[1])], "component int, loadings array<double>")


def projected(features: DataFrame, components: np.ndarray) -> DataFrame:
    """(reduced) of each row (indices, values): its products with the components, which are columns."""
    shared = features.sparkSession.sparkContext.broadcast(components.astype(np.float64))  # 8 bytes times columns times rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for columns, x in factor.sparse_blocks(batches):
            y = x @ v[columns]
            ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], ["reduced"])

    return features.select("indices", "values").mapInArrow(run, "reduced array<double>")


def svd_report(spectrum: DataFrame, original: int, dims: list[int], threshold: float = THRESHOLD) -> DataFrame:
    """A row for each dimension, the largest first; the smallest that reaches the threshold is flagged."""
    upto = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)  # one row a component
    sums = spectrum.select(F.col("component").alias("reduced_dim"), F.sum("ratio").over(upto).alias("rate"), F.sum("singular_value").over(upto).alias("singular_value_sum"), F.max("singular_value").over(upto).alias("top_singular_value"))
    ok = F.col("rate") >= threshold
    rows = sums.where(F.col("reduced_dim").isin(dims)).withColumn("ok", ok)
    smallest = F.min(F.when(F.col("ok"), F.col("reduced_dim"))).over(Window.partitionBy())
    return rows.select(
        F.lit(original).alias("original_dim"), "reduced_dim", (F.col("reduced_dim") / original).alias("compression_ratio"), F.col("rate").alias("reconstruction_rate"),
        (1 - F.col("rate")).alias("information_loss_rate"), F.col("ok").alias("threshold_ok"), F.coalesce(F.col("reduced_dim") == smallest, F.lit(False)).alias("is_min_dim_over_threshold"),
        "singular_value_sum", "top_singular_value",
    ).orderBy(F.desc("reduced_dim"))


def pca_report(spectrum: DataFrame, original: int, k: int, threshold: float = THRESHOLD) -> DataFrame:
    """One row for the dimension asked for; its flag only repeats whether the threshold is reached."""
    report = svd_report(spectrum, original, [k], threshold)
    return report.withColumnRenamed("reconstruction_rate", "explained_variance_rate").withColumn("is_min_dim_over_threshold", F.col("threshold_ok"))


def formatted(report: DataFrame) -> DataFrame:
    """Text columns as the reports print them: four decimals, lower-case booleans."""
    kinds = dict(report.dtypes)
    return report.select(*(decimals(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c).cast("string").alias(c) for c in report.columns))


def svd_sweep(features: DataFrame, original: int, rows: int, step: int = 200, least: int = 1000, threshold: float = THRESHOLD, sums: Moments | None = None) -> DataFrame:
    dims = dim_ladder(original, max_components(rows, original), step, least)
    spectrum, _ = svd_spectrum(features, original, max(dims), sums=sums)
    return svd_report(spectrum_table(features.sparkSession, spectrum), original, dims, threshold)
