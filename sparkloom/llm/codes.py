"""Operator 11: vectors compressed to codes, with part distances looked up in dictionaries of values."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Stage

#: Vectors of a block: it has a dictionary of its own in every dimension, so codes of 16 bits always do.
BLOCK = 4096
#: Components from 2^20 on have squared distances that no long holds.
REACH = 1 << 20


def whole(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    double = F.transform(vector, lambda x: x.cast("double"))
    return F.coalesce(~F.exists(double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def _blocks(batches, dims: int, scale: int):
    """Ids, labels, the distinct integers of every dimension, and the vectors as places in these dictionaries."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            ids, labels, vectors = (c.slice(at, BLOCK) for c in batch.columns)
            x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dims)
            x = np.floor(x * scale).astype(np.int64)
            found = [np.unique(x[:, d], return_inverse=True) for d in range(dims)]
            ends = np.cumsum([0, *(len(kinds) for kinds, _ in found)])
            places = np.array([place for _, place in found], np.uint16).reshape(dims, len(vectors))
            one = pa.array([0, len(vectors)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, labels),
                    pa.array([ends], pa.list_(pa.int32())),
                    pa.array([np.concatenate([np.zeros(0, np.int64), *(kinds for kinds, _ in found)])], pa.list_(pa.int64())),
                    pa.array([places.tobytes()], pa.binary()),
                ],
                names=["ids", "labels", "ends", "kinds", "places"],
            )


def _read(block: dict) -> tuple[list[np.ndarray], np.ndarray]:
    """The dictionaries of a block and the places of its vectors, by dimension."""
    ends, kinds = block["ends"].values.to_numpy(), block["kinds"].values.to_numpy()
    places = np.frombuffer(block["places"].as_py(), np.uint16).reshape(len(ends) - 1, -1)
    return [kinds[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], places


def part_distances(kinds: list[np.ndarray], places: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (vector, entry) of one part.

    For each dimension the differences of every distinct integer to every entry are squared once; a vector's distance
    is a sum of rows of these tables. They hold 32 bits where all sums fit, else 64.
    """
    total = np.zeros((places.shape[1], len(entries)), np.int64)
    spans = [np.abs(k).max(initial=0) + np.abs(entries[:, d]).max(initial=0) for d, k in enumerate(kinds)]
    if sum(int(s) ** 2 for s in spans) < 1 << 31:
        total = total.astype(np.int32)
    for d, (k, place) in enumerate(zip(kinds, places, strict=True)):
        table = ((k[:, None] - entries[None, :, d]) ** 2).astype(total.dtype)
        total += table[place]
    return total


def _nearest(block: dict, books: np.ndarray):
    """Part by part: its number, dictionaries, places, the nearest entry of each vector (ties to the first) and how far."""
    kinds, places = _read(block)
    width = books.shape[2]
    for part in range(len(books)):
        own = slice(part * width, (part + 1) * width)
        away = part_distances(kinds[own], places[own], books[part])
        near = away.argmin(axis=1)
        yield part, kinds[own], places[own], near, away[np.arange(len(near)), near].astype(np.int64)


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}


def _tally(batches, books: np.ndarray):
    """What a task has assigned to each entry: one row each, whatever the number of blocks."""
    parts, entries, width = books.shape
    counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
    for block in _rows(batches):
        for part, kinds, places, near, _ in _nearest(block, books):
            counts[part] += np.bincount(near, minlength=entries)
            for d, (k, place) in enumerate(zip(kinds, places, strict=True)):
                # sums of a block stay far below 2^53, so doubles hold them
                sums[part, :, d] += np.bincount(near, weights=k[place].astype(np.float64), minlength=entries).astype(np.int64)
    part, entry = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
        names=["part", "entry", "n", "sums"],
    )


def _encoded(batches, books: np.ndarray):
    for block in _rows(batches):
        codes, error = [], 0
        for _, _, _, near, away in _nearest(block, books):
            codes.append(near.astype(np.uint8))
            error = error + away
        digits = np.ascontiguousarray(np.array(codes).T).tobytes().hex()
        wide = 2 * len(books)
        code = pa.array([digits[i : i + wide] for i in range(0, len(digits), wide)], pa.string())
        yield pa.RecordBatch.from_arrays([block["ids"].values, block["labels"].values, code, pa.array(error)], names=["id", "label", "code", "error"])


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimals with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(
    spark: SparkSession, df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
) -> tuple[DataFrame, np.ndarray]:
    """(rows ``id_col, label_col, code, error, label_error``; the codebooks as an array by part, entry and position).

    A component x is the integer floor(scale * x). The codebooks start from the ``entries`` smallest ids and are
    refined ``rounds`` times over all vectors. The vectors are written once, as blocks with a dictionary of the
    distinct integers of each dimension; every round reads these blocks, and each task returns at most one row an
    entry, so the driver gets parts * entries sums and no vectors.

    Vectors that are null or hold null or non-finite components are left out. The vectors that count have the most
    frequent length (ties: the least) among the multiples of ``parts``, and components below 2^20 in size; others are
    returned with null ``code`` and ``error`` and shape no codebook. Null ids come after all others, equal ids are
    ordered by their vectors and keep a row each. Null labels are one label; a sum beyond a long is null. Fewer than
    ``entries`` vectors give fewer entries; an empty table gives no rows. Other columns are not looked at. A vector of
    any length is a row; a block has ``BLOCK`` of them.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte, so entries must be 1 to 256")
    stage = Stage(spark, "codes")
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(whole(F.col("v")))
    near_zero = F.forall("v", lambda x: F.abs(x.cast("double")) < REACH)
    length = rows.where(near_zero & (F.size("v") > 0) & (F.size("v") % parts == 0)).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dims = length[0].n if length else 0
    fits = near_zero & (F.size("v") == dims) & F.lit(dims > 0)
    first = rows.where(fits).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([[int(np.floor(float(x) * scale)) for x in r.v] for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    kinds = {c: rows.schema[c].dataType for c in ("id", "label")}
    schema = T.StructType(
        [T.StructField("ids", T.ArrayType(kinds["id"])), T.StructField("labels", T.ArrayType(kinds["label"])), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("kinds", T.ArrayType(T.LongType())), T.StructField("places", T.BinaryType())]
    )
    blocks = stage.save(rows.where(fits).mapInArrow(lambda batches: _blocks(batches, dims, scale), schema))
    for _ in range(rounds if len(first) else 0):
        now = books
        tallies = blocks.mapInArrow(lambda batches, now=now: _tally(batches, now), "part int, entry int, n long, sums array<long>")
        exact = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(books.shape[2])]
        books = now.copy()
        for r in tallies.groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact).collect():
            books[r.part, r.entry] = [int(s) // r.n for s in r[3:]]
    coded = blocks.mapInArrow(lambda batches: _encoded(batches, books), T.StructType([T.StructField("id", kinds["id"]), T.StructField("label", kinds["label"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))
    rest = rows.where(~fits).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = stage.save(coded.unionByName(rest))
    stage.drop(blocks)
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_of")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_of")), "left")
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"), books
