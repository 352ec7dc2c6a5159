"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are scaled to length one, where a cosine of at least 0.9 is a distance of at most 0.447. In
each of ``TABLES`` tables, ``HASHES`` projections on Gaussian directions, shifted and quantised to
steps of ``STEP``, name a bucket; vectors of one bucket are compared exactly in double precision.
Two vectors at the bound share some bucket with probability 0.94, at cosine 0.95 with 0.999, and
unrelated ones (cosine 0) share a given bucket with probability 2e-6; for many more rows raise
``HASHES`` by one for each doubling and the tables by a fifth.

Equal vectors are one class with a count. Buckets above ``BLOCK`` classes are dealt into blocks,
and each pair of blocks is one piece of work, so that no task holds a whole bucket. A piece returns
a row per linked vector, never a row per pair: its new links, counted only in the first table in
which the two meet, and the smallest vector it is connected to within the piece.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components are linked
with nothing; vectors of different lengths are never compared; repeated rows are linked with each
other; repeated ids keep their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.llm.graph import components
from labelwright.llm.store import save

COSINE, TABLES, HASHES, STEP = 0.9, 96, 18, 2.0
BLOCK = 512


def _directions(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([size, 17])
    a = rng.standard_normal((size, TABLES * HASHES))
    b = rng.uniform(0, STEP, TABLES * HASHES)
    return a, b, rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def buckets(unit: np.ndarray, made: dict) -> np.ndarray:
    """The bucket (32 bits) of each row in each table."""
    size = unit.shape[1]
    if size not in made:
        made[size] = _directions(size)
    a, b, mix = made[size]
    cells = np.floor((unit @ a + b) / STEP).astype(np.int64).view(np.uint64).reshape(len(unit), TABLES, HASHES)
    with np.errstate(over="ignore"):
        h = (cells * mix).sum(axis=2, dtype=np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def unit_rows(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    made: dict = {}
    for batch in batches:
        out: list = [None] * len(batch)
        sizes = np.array([len(v) for v in batch], dtype=np.int64)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            for k in range(0, len(at), 256):
                part = at[k : k + 256]
                for i, row in zip(part, buckets(unit_rows([batch.iloc[j] for j in part]), made), strict=True):
                    out[i] = row
        yield pd.Series(out, dtype=object)


def _compared(rows: pd.DataFrame) -> pd.DataFrame | None:
    """Links within one piece of work: new ones by row, and the smallest row each is connected to."""
    unit = unit_rows(list(rows["vector"]))
    rid, copies = rows["rid"].to_numpy(), rows["copies"].to_numpy()
    table, block = int(rows["table"].iloc[0]), rows["block"].to_numpy()
    linked = unit @ unit.T >= COSINE
    np.fill_diagonal(linked, False)
    if rows["left"].iloc[0] != rows["right"].iloc[0]:
        linked &= block[:, None] != block
    at = np.flatnonzero(linked.any(axis=1))
    if not len(at):
        return None
    linked, rid, copies = linked[np.ix_(at, at)], rid[at], copies[at]
    sign = np.array([rows["sign"].iloc[i][:table] for i in at], dtype=np.int32).reshape(len(at), table)
    new = linked.copy()
    for t in range(table):
        new &= sign[:, t][:, None] != sign[:, t]
    low = rid.copy()
    while True:
        nearer = np.minimum(low, np.where(linked, low, np.iinfo(np.int64).max).min(axis=1))
        if (nearer == low).all():
            break
        low = nearer
    return pd.DataFrame({"rid": rid, "links": new @ copies, "low": low})


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cuts the sorted rows of a partition at each new piece; a piece is at most two blocks."""
    names = ["table", "key", "left", "right"]
    held: pd.DataFrame | None = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        k = batch[names].to_numpy()
        starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
        out = [_compared(batch.iloc[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True) if b - a > 1]
        held = batch.iloc[starts[-1] :]
        found = [x for x in out if x is not None]
        if found:
            yield pd.concat(found)
    if held is not None and len(held) > 1:
        last = _compared(held)
        if last is not None:
            yield last


def near_duplicates(rows: DataFrame, carry: list[str], vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """The carried columns as ``row`` with n_links, component_id (smallest id) and kept."""
    good = (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)
    numbered = rows.select(
        F.struct(*carry).alias("row"), F.col(id_).cast("long").alias("id"), F.monotonically_increasing_id().alias("rid"),
        F.when(F.coalesce(good, F.lit(False)), F.col(vector).cast("array<double>")).alias("vector"),
    )
    staged = save(numbered, "vectors")
    full = staged.where("vector IS NOT NULL")
    classes = save(full.groupBy("vector").agg(F.min("rid").alias("rid"), F.count("*").alias("copies")), "classes")
    signed = save(classes.select("*", F.pandas_udf("array<int>")(_hashed)("vector").alias("sign")), "signed")
    index = signed.select("rid", F.size("vector").alias("length"), F.posexplode("sign").alias("table", "key"))
    # the length parts vectors that cannot be compared
    index = index.select("rid", "table", ((F.col("key").cast("long") * 65536) + F.col("length") % 65536).alias("key"))
    sizes = index.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = index.join(sizes, ["table", "key"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    shared = shared.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("left"), F.greatest(o, "block").alias("right")))
    dealt = shared.select("rid", "table", "key", "block", F.explode(pairs).alias("p")).select("rid", "table", "key", "block", "p.*")
    work = dealt.join(signed, "rid").repartition(F.col("table"), F.col("key"), F.col("left"), F.col("right"))
    work = work.sortWithinPartitions("table", "key", "left", "right").select("rid", "table", "key", "left", "right", "block", "copies", "vector", "sign")
    found = save(work.mapInPandas(_pieces, "rid long, links long, low long"), "links")
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rid").alias("a"), F.col("low").alias("b")))
    heads = classes.join(counts, "rid", "left").join(groups.withColumnRenamed("node", "rid"), "rid", "left")
    heads = heads.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rid").alias("group"))
    member = save(full.select("rid", "id", "vector").join(heads, "vector").select("rid", "id", "n_links", "group"), "members")
    least = member.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("rid").alias("rid"))).alias("head"))
    named = member.join(least, "group").select("rid", "n_links", F.col("head.id").alias("component_id"), (F.col("rid") == F.col("head.rid")).alias("kept"))
    out = staged.select("row", "rid", "id").join(named, "rid", "left")
    return out.select(
        "row",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("kept").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("kept", F.lit(True)).alias("kept"),
    )
