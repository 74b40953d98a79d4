"""Near-duplicate vectors by Euclidean p-stable hashing, checked by the exact cosine.

Vectors are scaled to length 1, projected on random directions, shifted and cut into steps; the steps of `bits`
directions name a bucket, and there are several tables of buckets. Unit vectors of cosine c are sqrt(2 - 2c) apart,
so the chance to share a step is known: directions are as many as make unrelated vectors meet rarely at the given
number of rows, tables as many as miss one pair in a thousand at the threshold and fewer above it. Vectors that share
a bucket are compared in blocks of a bounded size, in double precision. A pair that meets in several tables counts in
the first one.

Equal vectors are one class and are compared once; each is linked with all its copies. A block gives, for each of
its vectors, the number of links and one link towards each linked group, never all pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing. Vectors of each length (number of
components) are compared among themselves; very large and very small components are scaled first. Each row is counted by itself, also among rows of one id; null ids come last when a smallest id
is sought. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.llm.graph import components
from anchorline.llm.near_dedup import mix
from anchorline.llm.vectors import groups, lengths, matrix, unit, usable
from anchorline.session import stable

STEP = 2.0
BLOCK = 256
MISSED = 1e-3


def share(distance: float) -> float:
    """Chance that two points so far apart fall into one step of a random projection."""
    r = STEP / distance
    below = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def layout(rows: int, least: float) -> tuple[int, int]:
    """Directions of a bucket, and tables, for so many rows."""
    bits = math.ceil(math.log(max(rows, 2)) / -math.log(share(math.sqrt(2)))) + 3
    return bits, math.ceil(math.log(MISSED) / math.log(1 - share(math.sqrt(2 - 2 * least)) ** bits))


def _local_links(
    rows: np.ndarray, keys: np.ndarray, no: np.ndarray, copies: np.ndarray, own: np.ndarray, table: int, within: bool,
    least: float,
) -> tuple[np.ndarray, np.ndarray]:
    """For each vector of a block: links that are counted here, and the smallest number it is linked with."""
    linked = rows @ rows.T >= least
    linked &= ~np.eye(len(no), dtype=bool) if within else own[:, None] != own[None, :]
    a, b = np.nonzero(linked)
    first = ~(keys[a, :table] == keys[b, :table]).any(axis=1)
    count = np.bincount(a[first], copies[b[first]], len(no)).astype(np.int64)
    root = no.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        if (root == before).all():
            return count, root


def link_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row for each row of `df`: (id, n_links, component_id, kept)."""
    given = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    good = given.where(usable("vector"))
    parts = [_linked(good.where(F.size("vector") == size), size, least) for size in lengths(good, "vector")]
    if not parts:
        parts = [good.select("vector", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))]
    told = reduce(DataFrame.unionAll, parts)
    same = given.join(told.withColumnRenamed("vector", "__v"), F.col("vector") == F.col("__v"), "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component"))
    return same.select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _linked(good: DataFrame, size: int, least: float) -> DataFrame:
    """(vector, n_links, component) of the different vectors of one length."""
    classes = stable(
        good.groupBy("vector")
        .agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
        .withColumn("no", F.monotonically_increasing_id())
    )
    bits, tables = layout(classes.count(), least)
    random = np.random.default_rng(20)
    directions = random.normal(size=(max(size, 1), bits * tables))
    shifts = random.uniform(0, STEP, size=bits * tables)
    seeds = mix(np.arange(1, tables + 1, dtype=np.uint64))

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            steps = np.floor((unit(matrix(part["vector"])) @ directions + shifts) / STEP).astype(np.int64).view(np.uint64)
            keys = np.broadcast_to(seeds, (len(steps), tables)).copy()
            for bit in range(bits):
                keys = mix(keys + steps[:, bit::bits])
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.view(np.int64).ravel())
            )
            yield pa.RecordBatch.from_pydict({"no": part["no"], "keys": lists})

    keys = stable(classes.select("no", "vector").mapInArrow(hashed, "no long, keys array<long>"))
    met = keys.select("no", F.posexplode("keys").alias("place", "key"))
    crowds = met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    pairs = (
        met.join(crowds, "key").withColumn("own", F.pmod(F.xxhash64("no"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
        .select(F.xxhash64("key", "low", "high").alias("block"), "place", (F.col("low") == F.col("high")).alias("within"),
                "own", "no")
        .join(keys, "no").join(classes.select("no", "vector", "copies"), "no")
        .repartition("block").sortWithinPartitions("block")
    )

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(parts, "block"):
            column = lambda name: part[name].to_numpy(zero_copy_only=False)  # noqa: B023, E731
            count, root = _local_links(
                unit(matrix(part["vector"])), matrix_of_keys(part["keys"]), column("no"), column("copies"), column("own"),
                part["place"][0].as_py(), part["within"][0].as_py(), least,
            )
            some = np.nonzero((count > 0) | (root != column("no")))[0]
            if len(some):
                yield pa.RecordBatch.from_pydict({"no": column("no")[some], "n": count[some], "root": root[some]})

    found = stable(pairs.mapInArrow(compare, "no long, n long, root long"))
    roots = components(found.select(F.col("no").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("no").agg(F.sum("n").alias("n"))
    told = classes.join(counts, "no", "left").join(roots, classes["no"] == roots["node"], "left").select(
        "vector", "first_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("root", "no").alias("root"),
    )
    names = told.groupBy("root").agg(F.min("first_id").alias("component"))
    return told.join(names, "root").select("vector", "n_links", "component")


def matrix_of_keys(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
