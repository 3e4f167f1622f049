"""Vector codes of a product quantiser in whole numbers, assigned by Walsh-Hadamard coefficients.

A vector is cut into equal parts, and each part gets the number of the nearest of up to
256 entries. Parts and entries are padded with zeros to a power of two and transformed by
the integer Walsh-Hadamard transform, which multiplies every squared distance by the padded
width. Coefficients are taken in sequency order, where the first ones hold most of a smooth
part: squared differences are added up one coefficient at a time, and an entry whose sum is
above the whole distance of a good guess is out. Nothing is rounded, so the result is exact.

A round is one pass over the vectors: each task adds its parts up by entry, and the driver
gets one row for each entry of the codebooks, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.session import broadcast_if_small, materialize

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Parts that meet all entries at once.
CHUNK = 2048
_WORD = 1 << 63


def sequency_order(width: int) -> np.ndarray:
    """Rows of a Hadamard matrix of a power of two, by rising number of sign changes."""
    bits = width.bit_length() - 1
    gray = np.arange(width) ^ (np.arange(width) >> 1)
    return np.array([int(format(g, f"0{bits}b")[::-1], 2) if bits else 0 for g in gray], np.int64)


def walsh_hadamard(rows: np.ndarray) -> np.ndarray:
    """The transform of every row, padded with zeros to a power of two, in sequency order."""
    n, given = rows.shape
    width = 1 << max(0, given - 1).bit_length()
    out = np.zeros((n, width), rows.dtype)
    out[:, :given] = rows
    half = 1
    while half < width:
        pairs = out.reshape(n, width // (2 * half), 2, half)
        out = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], 2).reshape(n, width)
        half *= 2
    return out[:, sequency_order(width)]


def _largest(values: np.ndarray) -> int:
    return max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest row of ``entries``, squared distance) of every row of ``parts``; ties to the lower index."""
    width = 1 << max(0, parts.shape[1] - 1).bit_length()
    if (width * (_largest(parts) + _largest(entries))) ** 2 * width >= _WORD:
        parts, entries = parts.astype(object), entries.astype(object)  # beyond 64 bits: Python's whole numbers
    codes, distances = [], []
    known = walsh_hadamard(entries)
    for at in range(0, len(parts), CHUNK):
        own = walsh_hadamard(parts[at : at + CHUNK])
        head = max(1, width // 4)
        total = np.zeros((len(own), len(known)), own.dtype)
        for c in range(head):
            apart = own[:, c, None] - known[None, :, c]
            total += apart * apart
        guess = known[total.argmin(1)]
        bound = ((own - guess) * (own - guess)).sum(1)
        row, entry = np.nonzero((total <= bound[:, None]).astype(bool))
        left = total[row, entry]
        for c in range(head, width):
            apart = own[row, c] - known[entry, c]
            left = left + apart * apart
            in_play = (left <= bound[row]).astype(bool)
            row, entry, left = row[in_play], entry[in_play], left[in_play]
        starts = np.searchsorted(row, np.arange(len(own)))
        least = np.minimum.reduceat(left, starts)
        winners = np.flatnonzero(left == least[row])
        first = winners[np.unique(row[winners], return_index=True)[1]]
        codes.append(entry[first])
        distances.append(least // width)
    return np.concatenate(codes), np.concatenate(distances)


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of finite numbers, exactly."""
    values = values.astype(np.float64)
    if not values.size or np.abs(values).max() < 2.0**50:
        return np.floor(SCALE * values).astype(np.int64)
    big = [int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(SCALE * v) for v in values.ravel()]
    return np.array(big, object).reshape(values.shape)


def kept_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vec) of the rows whose vector is there, with all components finite numbers."""
    vec = F.col(vec_col)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(vec.isNotNull() & finite).select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), vec.alias("vec")
    )


def _rows_of(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(whole numbers of the vectors with ``size`` components, which rows these are)."""
    fits = pc.equal(pc.list_value_length(column), size)
    flat = column.filter(fits).flatten().to_numpy(zero_copy_only=False)
    which = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    return whole_numbers(flat).reshape(len(which), size), which


def _cut(rows: np.ndarray, parts: int) -> list[np.ndarray]:
    width = rows.shape[1] // parts
    return [rows[:, p * width : (p + 1) * width] for p in range(parts)]


def first_codebooks(kept: DataFrame, parts: int, entries: int) -> list[np.ndarray] | None:
    """The parts of the vectors with the smallest ids: at most ``entries`` rows come to the driver."""
    usable = kept.where(F.size("vec") % parts == 0)
    by_id = [F.col("vec_id").asc_nulls_last(), "vec"]
    first = usable.orderBy(*by_id).limit(1).select(F.size("vec")).collect()
    if not first:
        return None
    size = first[0][0]
    rows = usable.where(F.size("vec") == size).orderBy(*by_id).limit(entries).select("vec").collect()
    values = np.array([r.vec for r in rows], np.float64).reshape(len(rows), size)
    return _cut(whole_numbers(values), parts)


def _means(kept: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Every entry replaced by the mean of the parts it is nearest to, rounded down; unused entries stay."""
    parts, width, entries = len(books), books[0].shape[1], len(books[0])

    def add_up(batches):
        counts = np.zeros((parts, entries), np.int64)
        sums = [np.zeros((entries, width), object) for _ in books]
        for batch in batches:
            rows, _ = _rows_of(batch.column(0), parts * width)
            if not len(rows):
                continue
            for p, part in enumerate(_cut(rows, parts)):
                code, _ = nearest(part, books[p])
                order = np.argsort(code, kind="stable")
                used, starts = np.unique(code[order], return_index=True)
                counts[p, used] += np.diff([*starts, len(code)])
                if width:
                    sums[p][used] += np.add.reduceat(part[order], starts, 0)
        at = [(p, e) for p in range(parts) for e in range(entries) if counts[p, e]]
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([p for p, _ in at], pa.int32()),
                "entry": pa.array([e for _, e in at], pa.int32()),
                "n": pa.array([int(counts[x]) for x in at], pa.int64()),
                "sums": pa.array([[str(v) for v in sums[p][e]] for p, e in at], pa.list_(pa.string())),
            }
        )

    partial = kept.select("vec").mapInArrow(add_up, "part int, entry int, n bigint, sums array<string>")
    whole = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
    means = [np.array(book) for book in books]
    for row in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *whole).collect():
        mean = [int(row[f"s{j}"]) // row.n for j in range(width)]
        if mean and max(map(abs, mean)) >= 1 << 62:
            means[row.part] = means[row.part].astype(object)
        means[row.part][row.entry] = mean
    return means


def codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray] | None:
    """One table of entries for each part; None if there is no vector."""
    books = first_codebooks(kept, parts, entries)
    for _ in range(rounds if books else 0):
        books = _means(kept, books)
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimal text, by part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def encode(kept: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of every kept vector."""
    parts, size = len(books), sum(book.shape[1] for book in books)

    def code_of(batches):
        for batch in batches:
            rows, which = _rows_of(batch.column(2), size)
            found = [nearest(part, books[p]) for p, part in enumerate(_cut(rows, parts))] if len(rows) else []
            codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
            for i, row in enumerate(which):
                codes[row] = "".join(f"{int(code[i]):02x}" for code, _ in found)
                error = sum(int(distance[i]) for _, distance in found)
                errors[row] = error if error < _WORD else None
            columns = [batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    kinds = dict(kept.dtypes)
    return kept.mapInArrow(code_of, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def vector_codes(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row for each vector that is kept.

    Rows without a vector, or with a null or non-finite component, are dropped. Components
    become floor(1024 * x). A part's codebook starts as that part of the vectors with the
    ``entries`` smallest ids, null last, ties by the vector itself; with fewer vectors it is
    smaller. In each of ``rounds`` rounds all parts are assigned and every used entry becomes
    the mean of its parts, rounded down. ``label_error`` sums ``error`` over equal labels,
    nulls together. Repeated rows count as often as they are there. All vectors should have
    the length of the first one whose length ``parts`` divides; others, empty ones included,
    cannot be coded with it and come with null code and error. An error or label error
    beyond 64 bits is null; components up to 10**34 are exact. Other columns are not read;
    no rows give no rows.
    """
    kept = kept_vectors(vectors, id_col, vec_col, label_col)
    books = codebooks(kept, parts, entries, rounds)
    if books is None:
        digest = hashlib.sha256(b"").hexdigest()
        coded = kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    else:
        digest, coded = codebooks_digest(books), encode(kept, books)
    coded = materialize(coded, "vector-codes")
    by_label = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    by_label = broadcast_if_small(by_label.withColumnRenamed("label", "_label"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
