"""Variable-capacity best-fit packing of documents into training sequences.

A document's tokens are its words and one separator; documents longer than the largest permitted
length are cut into pieces of it. The pieces are dealt evenly into shards of about
``SHARD_TOKENS`` tokens, small enough for a task and large enough that their last bins do not matter,
and each shard is packed by itself: longest piece first, into the open bin with the least room that
fits it, else into a new bin. The permitted lengths are optimised jointly: the shard is packed once
for every rule of which size to open (the size of least cost for the tokens it is expected to take,
or a given size), every bin is downsized to the smallest length that holds its contents, and the
packing of the least total cost is kept.

Defined cases: a null or empty text is one separator; nothing is dropped, every token of every row
is in exactly one bin; ties are broken by row and piece, so that results repeat; repeated rows are
packed each; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.llm.store import save
from labelwright.llm.words import words

SIZES = (512, 1024, 2048, 4096)
SHARD_TOKENS = 1 << 18


def cost(size: int) -> float:
    """Of one training sequence: linear work, attention growing with the square, and a fixed part."""
    return size + size * size / 16384 + 32


def best_fit(lengths: list[int], sizes: tuple[int, ...], opening: int | None) -> tuple[list[int], list[int]]:
    """The bin of each length (given longest first) and the contents of each bin.

    ``opening``: the size to open where it fits; None: the size whose cost for what it is expected
    to hold is least, given the tokens still to come.
    """
    bins: list[int] = []  # bin of each piece
    full: list[int] = []  # tokens in each bin
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    left = sum(lengths)
    for n in lengths:
        left -= n
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            fits = [c for c in sizes if c >= n]
            if opening in fits:
                room = opening
            elif opening is not None:
                room = fits[0]
            else:
                room = min(fits, key=lambda c: cost(c) / (n + min(c - n, left)))
            b = len(full)
            full.append(0)
        bins.append(b)
        full[b] += n
        if room > n:
            insort(rooms, (room - n, b))
    return bins, full


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES) -> tuple[list[int], list[int]]:
    """The bin of each length and the downsized size of each bin, of the opening rule that costs least."""
    best: tuple[float, list[int], list[int]] | None = None
    for opening in (None, *sizes):
        bins, full = best_fit(lengths, sizes, opening)
        fitted = [next(c for c in sizes if c >= x) for x in full]
        total = sum(map(cost, fitted))
        if best is None or total < best[0]:
            best = (total, bins, fitted)
    return best[1], best[2]


def _packed(sizes: tuple[int, ...]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["n_tokens", "rid", "piece"], ascending=[False, True, True], ignore_index=True)
        bins, fitted = pack(shard["n_tokens"].to_list(), sizes)
        shard["bin"] = np.array(bins, dtype=np.int64)
        shard["capacity"] = np.array(fitted, dtype=np.int64)[shard["bin"]]
        shard["offset"] = shard.groupby("bin")["n_tokens"].cumsum() - shard["n_tokens"]
        return shard[["rid", "piece", "start", "n_tokens", "shard", "bin", "offset", "capacity"]]

    return run


def packed(docs: DataFrame, carry: list[str], sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """One row per piece: the document's carried columns as ``row``, the piece's number, first token and
    length, and its shard, bin, offset in the bin and the bin's capacity."""
    sizes = tuple(sorted(sizes))
    tokens = F.size(words(F.col("text"))).cast("long") + 1
    rows = save(docs.select(F.struct(*carry).alias("row"), F.monotonically_increasing_id().alias("rid"), tokens.alias("n")), "lengths")
    shards = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // SHARD_TOKENS))
    largest = sizes[-1]
    pieces = rows.select("rid", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / largest))).alias("piece"))
    start = F.col("piece") * largest
    pieces = pieces.select(
        "rid", "piece", start.alias("start"), F.least(F.lit(largest), F.col("n") - start).cast("long").alias("n_tokens"), F.pmod(F.xxhash64("rid", "piece"), F.lit(shards)).alias("shard")
    )
    schema = "rid long, piece long, start long, n_tokens long, shard long, bin long, offset long, capacity long"
    done = pieces.groupBy("shard").applyInPandas(_packed(sizes), schema)
    return rows.select("rid", "row").join(done, "rid").drop("rid")
