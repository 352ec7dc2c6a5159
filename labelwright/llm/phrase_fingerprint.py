"""Document fingerprints by locally consistent parsing.

A text is a sequence of symbols, at first its code points. Each level of the parse

1. names every run of equal symbols by symbol and length, so that neighbours differ,
2. reduces the names to small labels by two rounds of deterministic coin tossing: a symbol's label
   is the lowest bit in which it differs from its left neighbour, and that bit's value, which again
   leaves neighbours different (two rounds give labels below 14),
3. starts a phrase at every symbol whose label exceeds both neighbours' (thus at least once in 26
   symbols and never at two in a row), and names each phrase by a 64-bit hash of its symbols.

The phrases are the symbols of the next level, until one is left, whose name stands for the whole
text. Whether a phrase starts somewhere depends on three symbols before it and one after it, at any
offset: equal substrings are cut into equal phrases but for a few at their ends. Phrases hold some
3, 9 and 27 characters on the first levels.

A fingerprint is the text's own name and, for the first ``LEVELS`` levels, the ``KEEP`` smallest
hashed names of phrases, of all the text's. Two fingerprints are compared on the coarsest level that
has ``ENOUGH`` names in both: the names among the smallest of both together that both have estimate
the texts' resemblance J, and 2 J / (1 + J) the share of their phrases in common.

A task parses texts together, a bounded number of code points at a time; all work of a level is on
arrays. Names of levels above the third are made only to name the text.

Defined cases: a null or empty text has the name zero and no phrases; two such texts have likeness
1, one of them and another text 0; equal texts have equal fingerprints wherever they stand; a single
row is its own next one; rows of equal id and equal text are alike. Ids are taken to be few times
repeated: rows of one id stay together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS, KEEP, ENOUGH = 3, 40, 8
#: Code points parsed at once, unless one text holds more; bytes of text a task holds parsed.
TOGETHER, PART = 1 << 16, 1 << 21
#: A text's name and the smallest names of its phrases on the first levels.
Print = tuple[int, list[np.ndarray]]
_U = np.uint64
#: Longest phrase and a multiplier for each place in it.
LONGEST = 32
WEIGHTS = np.random.default_rng(29).integers(0, 2**63, LONGEST, dtype=np.uint64) * _U(2) + _U(1)
RUN, SEED = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x *= SEED
    x ^= x >> _U(29)
    x *= RUN
    x ^= x >> _U(32)
    return x


def _tossed(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Label of each symbol against its left neighbour; the ``first`` of a text against itself with the lowest bit flipped."""
    diff = np.empty_like(x)
    diff[0] = 1
    np.bitwise_xor(x[1:], x[:-1], out=diff[1:])
    diff[first] = 1
    low = np.bitwise_count(~diff & (diff - x.dtype.type(1)))  # zeros below the lowest set bit
    return (low << np.uint8(1)) | ((x >> low.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)


def level(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of several texts at once; ``starts``: where each text begins, none is empty."""
    new = np.empty(len(x), dtype=bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new[starts] = True
    at = np.flatnonzero(new)
    if len(at) < len(x):
        size = np.diff(np.r_[at, len(x)])
        x = x[at]
        long = size > 1
        x[long] = mixed(x[long] + RUN * size[long].astype(np.uint64))
        starts = np.searchsorted(at, starts)
    label = _tossed(_tossed(x, starts), starts)
    cut = np.zeros(len(x), dtype=bool)
    cut[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    cut[starts] = True
    ends = np.r_[starts[1:], len(x)] - 1
    cut[ends[ends > starts]] = False  # a text's last symbol starts no phrase
    at = np.flatnonzero(cut)
    size = np.diff(np.r_[at, len(x)])
    place = np.arange(len(x)) - np.repeat(at, size)
    return mixed(np.add.reduceat(x * WEIGHTS[place], at) + size.astype(np.uint64)), np.searchsorted(at, starts)


def smallest(names: np.ndarray) -> np.ndarray:
    """The ``KEEP`` smallest of the distinct names, by their upper halves."""
    names = (names >> _U(32)).astype(np.uint32)
    if len(names) > 16 * KEEP:  # names are spread evenly: a part of them holds the smallest, unless most repeat
        few = np.unique(names[names < np.uint32((4 * KEEP << 32) // len(names))])
        if len(few) >= KEEP:
            return few[:KEEP]
    return np.unique(names)[:KEEP]


def parse(codes: list[np.ndarray]) -> list[Print]:
    """The fingerprint of each text, given its code points."""
    out: list[Print] = [(0, [])] * len(codes)
    live = np.array([i for i, c in enumerate(codes) if len(c)], dtype=np.int64)
    if not len(live):
        return out
    sizes = np.array([len(codes[i]) for i in live])
    x = np.concatenate([codes[i] for i in live]).astype(np.uint64)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    kept: dict[int, list[np.ndarray]] = {int(i): [] for i in live}
    depth = 0
    while len(live):
        x, starts = level(x, starts)
        ends = np.r_[starts[1:], len(x)]
        if depth < LEVELS:
            for i, a, b in zip(live.tolist(), starts.tolist(), ends.tolist(), strict=True):
                kept[i].append(smallest(x[a:b]))
        depth += 1
        done = ends - starts == 1
        if done.any():
            for i, a in zip(live[done].tolist(), starts[done].tolist(), strict=True):
                out[i] = (int(x[a]), kept[i])
            x = x[np.repeat(~done, ends - starts)]
            sizes = (ends - starts)[~done]
            live, starts = live[~done], np.cumsum(sizes) - sizes
    return out


def written(own: Print) -> str:
    """The name in hex, then each level's smallest names in hex."""
    name, levels = own
    return "-".join([f"{name:016x}", *(names.astype(">u4").tobytes().hex() for names in levels)])


def likeness(a: Print, b: Print) -> float:
    """Estimated share of phrases in common, from 0 to 1."""
    if a[0] == b[0]:
        return 1.0
    both = min(len(a[1]), len(b[1]))
    if not both:
        return 0.0
    at = next((k for k in range(both - 1, 0, -1) if min(len(a[1][k]), len(b[1][k])) >= ENOUGH), 0)
    x, y = a[1][at], b[1][at]
    low = np.union1d(x, y)
    if max(len(x), len(y)) == KEEP:  # only the smallest are known of both
        low = low[:KEEP]
    j = len(np.intersect1d(np.intersect1d(x, y), low)) / len(low)
    return 2 * j / (1 + j)


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "replace"), dtype=np.uint32)


def prints(texts: list[np.ndarray]) -> list[Print]:
    """Fingerprints of any number of texts, about ``TOGETHER`` code points at a time."""
    out: list[Print] = []
    held: list[np.ndarray] = []
    for t in texts:
        held.append(t)
        if sum(map(len, held)) >= TOGETHER:
            out += parse(held)
            held = []
    return out + parse(held)


def edit(own: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The last half of a text replaced by as much of the beginning of the next one."""
    half = len(own) // 2
    return np.concatenate([own[: len(own) - half], after[:half]])


def _pairs(rows: pa.Table) -> pa.RecordBatch:
    """Every row that has its successor behind it, compared with it."""
    place, foreign = rows["place"].to_numpy(), rows["foreign"].to_numpy()
    at = np.flatnonzero((place[1:] == place[:-1]) & ~foreign[:-1])
    texts = [code_points(t) for t in rows["text"].to_pylist()]
    edited = [edit(texts[k], texts[k + 1]) for k in at]
    own, changed = prints(texts), prints(edited)
    sha = [hashlib.sha256(e.tobytes().decode("utf-32-le").encode()).hexdigest() for e in edited]
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays(rows["row"].chunks).take(pa.array(at)), pa.array([len(texts[k]) for k in at], pa.int64()), pa.array(sha, pa.string()),
         pa.array([written(own[k]) for k in at], pa.string()), pa.array([written(c) for c in changed], pa.string()),
         pa.array([likeness(own[k], c) for k, c in zip(at, changed, strict=True)], pa.float64()), pa.array([likeness(own[k], own[k + 1]) for k in at], pa.float64())],
        ["row", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts sorted rows into parts of bounded text; the last row of a part is the first of the next."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        filled = np.cumsum(pc.fill_null(pc.binary_length(rows["text"]), 0).to_numpy()) // PART
        a = 0
        for b in [*np.flatnonzero(np.diff(filled)).tolist(), rows.num_rows - 1]:
            if b > a:
                yield _pairs(rows.slice(a, b - a + 1))
                a = b
        held = rows.slice(a)


def fingerprints(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns as ``row`` with each text's fingerprint, its edited text's, and their likeness.

    The next text is that of the next smaller doc_id; null ids come last, equal ids by a hash of the
    text, and after the last row the first. Rows are dealt by ranges of doc_id; the first row of a
    range, of which there is one for each range, also goes to the range before it.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.struct(*carry).alias("row"), F.col("doc_id").cast("long").alias("id"), "text", F.xxhash64("text").alias("tie"))
    asked = F.percentile_approx(F.col("doc_id").cast("long"), [k / ranges for k in range(1, ranges)], 20 * ranges)
    inner = sorted({float(x) for x in docs.agg(asked).first()[0] or [0]})  # any one will do if there is no id
    splits = [float("-inf"), *inner, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_id", outputCol="_range", handleInvalid="keep")
    keyed = cut.transform(keyed.withColumn("_id", F.coalesce(F.col("id").cast("double"), F.lit(float("nan")))))
    # places ascend as ids descend; rows without an id are dealt by the hash
    place = F.when(F.col("id").isNotNull(), len(splits) - F.col("_range")).otherwise(len(splits) + 512 + F.shiftright("tie", 54)).cast("int")
    keyed = keyed.select("row", "id", "text", "tie", place.alias("place"))
    first = keyed.groupBy("place").agg(F.max(F.struct("id", (-1 - F.col("tie")).alias("not_tie"))).alias("f")).orderBy("place").collect()  # a row per range
    heads = [(r.place, r.f.id, -1 - r.f.not_tie, first[k - 1].place) for k, r in enumerate(first)]
    table = spark.createDataFrame(heads, "p int, i long, t long, target int")
    on = (F.col("place") == F.col("p")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t"))
    here = F.struct("place", F.lit(False).alias("foreign"))
    there = F.struct(F.col("target").alias("place"), F.lit(True).alias("foreign"))
    rows = keyed.join(F.broadcast(table), on, "left").select(
        "row", "id", "text", "tie", F.explode(F.when(F.col("target").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("at")
    )
    rows = rows.select("row", "id", "text", "tie", "at.*").repartition("place").sortWithinPartitions("place", "foreign", F.desc_nulls_last("id"), "tie")
    kind = f"row {keyed.schema['row'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("row", "text", "place", "foreign").mapInArrow(_compared, kind)
