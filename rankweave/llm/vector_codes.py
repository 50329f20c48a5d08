"""Product codes of integer vectors, exact in spite of a matrix product in single precision.

Components become integers, vectors are cut into equal parts, and each part is coded by the
nearest of up to 256 codebook entries, which move to their parts' mean (rounded down) for some
rounds. The nearest entry follows from ``|c|^2 - 2 x.c``. The products come from a float32 matrix
product; Cauchy-Schwarz and the bound on summing n products in any order give each value an
interval that holds the true one. Entries whose interval reaches below the least upper end are
computed anew in int64, and the least of them, of equal ones the first, is the code. So the codes
are those of integer arithmetic, whatever the order of summation.

A round is one pass over the vectors. A task adds up its vectors in int64 and sends one block of
sums for each part and 16 entries; the driver sees the codebooks alone, ``entries`` rows of a vector's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import joined
from .textcore import fixed_binary, stored, tidy

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors whose products are in memory at once, and codebook entries of one block of sums.
ROWS, BLOCK = 2048, 16
_UNIT = 2.0**-24


def largest(dim: int) -> int:
    """The largest component with which no sum of squared differences over ``dim`` leaves int64."""
    return int((2.0**61 / max(dim, 1)) ** 0.5) // 2


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of ``x`` the first nearest row of ``book`` and the squared distance, and how many pairs were computed anew."""
    n = x.shape[1]
    book_norm = (book * book).sum(1)
    lengths = np.sqrt(book_norm.astype(float)), np.sqrt((x * x).sum(1).astype(float))
    gamma = (n + 4) * _UNIT / (1 - (n + 4) * _UNIT)  # n products and sums, two conversions, and a margin
    half = lengths[1][:, None] * (lengths[0] * (2 * gamma * (1 + 1e-6)))[None, :]
    mid = -2.0 * (x.astype(np.float32) @ book.astype(np.float32).T).astype(float) + book_norm.astype(float)
    half += (np.abs(mid) + book_norm.astype(float)) * 2.0**-50 + 1e-3  # conversions and sums in double precision
    best = (mid + half).min(1)
    row, entry = np.nonzero(mid - half <= best[:, None])
    exact = np.empty(len(row), np.int64)
    for lo in range(0, len(row), 1 << 16):
        diff = x[row[lo : lo + (1 << 16)]] - book[entry[lo : lo + (1 << 16)]]
        exact[lo : lo + (1 << 16)] = (diff * diff).sum(1)
    first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1]) if len(row) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(exact, first) if len(row) else exact
    hit = exact == np.repeat(least, np.diff(first, append=len(row)))
    place = np.where(hit, entry, np.iinfo(np.int64).max)
    return (np.minimum.reduceat(place, first) if len(row) else place), least, len(row)


def _integers(scale: int):
    """Batches of vectors as packed int64 components; ``sound`` where none is null, non-finite or out of range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            values = v.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is NaN
            off, given = v.offsets.to_numpy(), v.is_valid().to_numpy(zero_copy_only=False)
            parts: list = [None] * len(v)
            with np.errstate(over="ignore"):
                scaled = np.floor(values * scale)
            for i in np.flatnonzero(given).tolist():
                x = scaled[off[i] : off[i + 1]]
                if len(x) and np.abs(x).max() <= largest(len(x)):  # false with NaN
                    parts[i] = x.astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(parts, pa.binary())], names=["vec_id", "label", "ints"])

    return run


def _matrix(b: pa.RecordBatch, dim: int) -> np.ndarray:
    return fixed_binary(b.column("ints"), np.int32, dim).astype(np.int64)


def _sums(books: list[np.ndarray], dim: int):
    width = dim // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(c), width + 1), np.int64) for c in books]
        for b in batches:
            x = _matrix(b, dim)
            for lo in range(0, len(x), ROWS):
                for p, book in enumerate(books):
                    part = x[lo : lo + ROWS, p * width : (p + 1) * width]
                    code = nearest(part, book)[0]
                    order = np.argsort(code, kind="stable")
                    used, first = np.unique(code[order], return_index=True)
                    total[p][used, :width] += np.add.reduceat(part[order], first, axis=0)
                    total[p][used, width] += np.diff(first, append=len(order))
        units, blobs = [], []
        for p, t in enumerate(total):
            for e in range(0, len(t), BLOCK):
                if t[e : e + BLOCK, width].any():
                    units.append(p << 32 | e)
                    blobs.append(t[e : e + BLOCK].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(blobs, pa.binary())], names=["unit", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sums in the order of their unit, one for each unit."""
    now, total = None, None
    out: list[tuple[int, bytes]] = []
    for b in batches:
        for unit, blob in zip(b.column("unit").to_pylist(), b.column("sums"), strict=True):
            one = np.frombuffer(blob.as_buffer(), np.int64)
            if unit != now:
                if now is not None:
                    out.append((now, total.tobytes()))
                now, total = unit, one.copy()
            else:
                total += one
    if now is not None:
        out.append((now, total.tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([s for _, s in out], pa.binary())], names=["unit", "sums"])


def _codes(books: list[np.ndarray], dim: int):
    width = dim // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, dim)
            code, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
            for lo in range(0, len(x), ROWS):
                for p, book in enumerate(books):
                    some, far, _ = nearest(x[lo : lo + ROWS, p * width : (p + 1) * width], book)
                    code[lo : lo + ROWS, p] = some
                    error[lo : lo + ROWS] += far
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def fit_codebooks(ints: DataFrame, dim: int, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part, fitted on all rows of ints(vec_id, label, ints)."""
    width = dim // parts
    first = ints.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    x = np.frombuffer(b"".join(bytes(r.ints) for r in first), np.int32).reshape(len(first), dim).astype(np.int64)
    books = [x[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    units = parts * -(-entries // BLOCK)
    for _ in range(rounds):
        sums = ints.select("ints").mapInArrow(tidy(_sums(books, dim)), "unit long, sums binary")
        for row in sums.repartition(units, "unit").sortWithinPartitions("unit").mapInArrow(tidy(_added), "unit long, sums binary").collect():  # parts * entries / BLOCK rows
            p, e = row.unit >> 32, row.unit & 0xFFFFFFFF
            t = np.frombuffer(bytes(row.sums), np.int64).reshape(-1, width + 1)
            used = t[:, width] > 0
            books[p][e : e + BLOCK][used] = t[used, :width] // t[used, width:]  # rounds down, below zero too
    return books


def compress(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every vector that is kept, and the codebooks.

    A vector is kept if it and its components are not null, all are finite, and its length is that of the
    kept vector of the smallest id and a multiple of ``parts``; components above :func:`largest` in size, whose
    squares leave int64, count as not finite, and empty vectors as null. Repeated rows are vectors of their own;
    equal ids stand by their components, a null id comes last. Fewer vectors than ``entries`` give as many
    entries. Other columns are not looked at; no vectors give no rows and no codebook.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("a code has one byte for each part")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    kinds = [rows.select(c).schema[0].dataType.simpleString() for c in ("vec_id", "label")]
    schema = f"vec_id {kinds[0]}, label {kinds[1]}"
    ints = rows.mapInArrow(tidy(_integers(scale)), f"{schema}, ints binary").where(f"ints is not null and octet_length(ints) % {4 * parts} = 0")
    ints = stored(ints, "vector-ints")
    least = ints.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select(F.octet_length("ints").alias("n")).first()
    if least is None:
        return ints.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    dim = least.n // 4
    ints = ints.where(F.octet_length("ints") == 4 * dim)
    books = fit_codebooks(ints, dim, parts=parts, entries=entries, rounds=rounds)
    return ints.mapInArrow(tidy(_codes(books, dim)), f"{schema}, code string, error long"), books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimal numbers by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compression_digest(embeddings: DataFrame) -> DataFrame:
    """Codes and errors of all vectors, with the sum of the errors by label."""
    codes, books = compress(embeddings)
    codes = stored(codes, "vector-codes")
    by = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    return joined(codes, by, "label").select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
