"""Near-duplicate documents by an LSH forest of MinHash signatures.

A document is the set of its distinct shingles of ``width`` words (``WIDTH`` unless given). Equal sets are one class. Of each class,
``TREES`` signatures of ``DEPTH`` min-hashes are sorted, each tree in its own order; neighbours in a
tree, which are those of the longest common prefix, are candidates. The depth that counts so adapts
to every region: where many signatures share a prefix, neighbours agree much deeper. Candidates
whose sketches agree far too little are left out; the others are confirmed on the full sets.

Every class has at most 2 * ``NEAR`` * ``TREES`` such candidates, so no group is ever compared pairwise,
and long chains of neighbours keep large groups together. First each class's most similar candidate
is confirmed; of the rest only pairs that those links do not connect already.

Buckets of more classes than a tree's window reaches (``PREFIX`` equal hashes) hold pairs that were not
met. Where such a bucket is not of one group yet, all its classes meet the one with the most links, from
which the others may be copied. What is still apart then is settled by shared shingles: of two similar
sets the smaller has one of its rarest shingles (a ninth of them) among the rarest fifth of the other's,
so only classes of different groups with such a shingle in common are confirmed.

Defined cases: null, empty and wordless texts have no shingles and are linked with nothing; equal
texts are linked; repeated ids keep their rows, the smallest id of a group names it; null ids are
never the smallest unless alone, where the component is null and the row kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelwright.llm.graph import components
from labelwright.llm.shingles import Shingler
from labelwright.llm.sieve import sifted
from labelwright.llm.store import drop, save

WIDTH, PERCENT = 4, 80
TREES, DEPTH, NEAR, HASHES = 10, 8, 4, 128
#: Equal hashes of a bucket: similar sets share one in some tree with probability 0.999 at similarity 0.8.
PREFIX = 3
#: Pairs of one class that are confirmed in one task, and shingles that a task holds at once.
DEALT, HELD = 1000, 500_000
#: Sketch bits that must agree: 128 bits agree in 115 on average at similarity 0.8, five deviations lower in 98.
AGREE = 98
_RNG = np.random.default_rng(20240501)
_A = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2)
_CHUNK = 4096


def signature(s: np.ndarray) -> np.ndarray:
    """The min-hashes (32 bits each) of a set of hashes, in chunks of bounded size."""
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(s), _CHUNK):
            part = s[k : k + _CHUNK]
            low = np.minimum(low, ((_A[:, None] * part + _B[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32))
    return low


def _signed(batches: Iterator[pd.Series], width: int = WIDTH) -> Iterator[pd.DataFrame]:
    shingles = Shingler(width)
    for batch in batches:
        rows = []
        for text in batch:
            s = shingles(text)
            if not len(s):
                rows.append((0, 0, 0, None, None))
                continue
            with np.errstate(over="ignore"):
                a = int(s.sum(dtype=np.uint64).view(np.int64))
                b = int((s * s ^ s >> np.uint64(29)).sum(dtype=np.uint64).view(np.int64))
            low = signature(s)
            keys = low[: TREES * DEPTH].astype(">u4").tobytes()
            rows.append((len(s), a, b, keys, np.packbits((low & 1).astype(np.uint8)).tobytes()))
        yield pd.DataFrame(rows, columns=["n", "set_a", "set_b", "keys", "sketch"])


def _near(tree: np.ndarray, key: np.ndarray, rid: np.ndarray, sketch: np.ndarray, side: np.ndarray | None = None) -> list[tuple[np.ndarray, ...]]:
    """Pairs of rows at most NEAR places apart in one tree that share a prefix and enough of the sketch.

    With ``side``, only pairs across its two values.
    """
    out = []
    for d in range(1, NEAR + 1):
        if len(rid) <= d:
            break
        ok = (tree[d:] == tree[:-d]) & (key[d:] == key[:-d])
        if side is not None:
            ok &= side[d:] != side[:-d]
        i = np.flatnonzero(ok)
        agree = HASHES - np.bitwise_count(sketch[i] ^ sketch[i + d]).sum(axis=1, dtype=np.int64)
        i, agree = i[agree >= AGREE], agree[agree >= AGREE]
        if len(i):
            out.append((np.minimum(rid[i], rid[i + d]), np.maximum(rid[i], rid[i + d]), agree))
    return out


_PAIR = "a long, b long, agree long, cut int, side int, tree int, key binary, rid long, sketch binary"


def _columns(frame: pd.DataFrame) -> tuple[np.ndarray, ...]:
    first = np.array([k[:4] for k in frame["key"]], dtype="S4") if len(frame) else np.array([], dtype="S4")
    words = np.frombuffer(b"".join(frame["sketch"]), dtype=np.uint64).reshape(len(frame), HASHES // 64)
    return frame["tree"].to_numpy(), first, frame["rid"].to_numpy(), words


def _pairs(found: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    a, b, agree = (np.concatenate([x[k] for x in found]) if found else np.array([], dtype=np.int64) for k in range(3))
    out = pd.DataFrame({"a": a, "b": b, "agree": agree}).drop_duplicates()
    return out.reindex(columns=["a", "b", "agree", "cut", "side", "tree", "key", "rid", "sketch"])


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates of one sorted partition, and its first and last rows for the cuts between partitions."""
    part = TaskContext.get().partitionId()
    tail: pd.DataFrame | None = None
    head: pd.DataFrame | None = None
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if tail is None else pd.concat([tail, batch], ignore_index=True)
        yield _pairs(_near(*_columns(rows)))
        head = rows.head(NEAR) if head is None or len(head) < NEAR else head
        tail = rows.tail(NEAR)
    for frame, cut, side in ((head, part - 1, 1), (tail, part, 0)):
        if frame is not None:
            yield frame.assign(cut=cut, side=side).reindex(columns=["a", "b", "agree", "cut", "side", "tree", "key", "rid", "sketch"])


def _across(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["side", "tree", "key", "rid"], ignore_index=True)
    return _pairs(_near(*_columns(rows), rows["side"].to_numpy()))[["a", "b", "agree"]]


def candidates(forest: DataFrame) -> DataFrame:
    """(a, b, agree) of classes that are neighbours in some tree; ``forest`` has rid, keys, sketch."""
    spark = forest.sparkSession
    size = DEPTH * 4
    rows = forest.select("rid", "sketch", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "keys")
    rows = rows.select("tree", F.expr(f"substring(keys, tree * {size} + 1, {size})").alias("key"), "rid", "sketch")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the row id makes every sort key distinct, so that ranges are even however many signatures agree
    ordered = rows.repartitionByRange(parts, "tree", "key", "rid").sortWithinPartitions("tree", "key", "rid")
    found = save(ordered.mapInPandas(_neighbours, _PAIR), "neighbours")
    cuts = found.where("cut IS NOT NULL").groupBy("cut").applyInPandas(_across, "a long, b long, agree long")
    pairs = found.where("a IS NOT NULL").select("a", "b", "agree").unionByName(cuts).groupBy("a", "b").agg(F.max("agree").alias("agree"))
    pairs = save(pairs, "candidates")
    drop(found)
    return pairs


def _confirmed(batches: Iterator[pd.DataFrame], width: int = WIDTH) -> Iterator[pd.DataFrame]:
    shingles = Shingler(width)
    for batch in batches:
        ok = np.zeros(len(batch), dtype=bool)
        last, left = None, None
        for k, (a, one, other) in enumerate(zip(batch["a"], batch["text_a"], batch["text_b"], strict=True)):
            if a != last:
                last, left = a, shingles(one)
            right = shingles(other)
            both = len(np.intersect1d(left, right, assume_unique=True))
            ok[k] = 100 * both >= PERCENT * (len(left) + len(right) - both)
        yield batch.loc[ok, ["a", "b"]]


def confirm(pairs: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ``texts`` has rid and text.

    A class has few candidates by construction, so no join key is hot.
    """
    a = texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInPandas(lambda batches: _confirmed(batches, width), "a long, b long")


def _agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bits = lambda c: np.frombuffer(b"".join(c), dtype=np.uint64).reshape(len(c), HASHES // 64)
    for batch in batches:
        agree = HASHES - np.bitwise_count(bits(batch["sketch_a"]) ^ bits(batch["sketch_b"])).sum(axis=1, dtype=np.int64)
        yield batch.loc[agree >= AGREE, ["a", "b"]]


def agreeing(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) of which enough sketch bits agree; ``sketches`` has rid and sketch."""
    side = lambda x: sketches.select(F.col("rid").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sketch_a", "sketch_b").mapInPandas(_agreeing, "a long, b long")


def confirm_dealt(pairs: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """Like ``confirm``, for pairs of which many may have the same ``a``: its text is sent to each ``DEALT`` of them."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("parts"))
    left = texts.join(parts, F.col("rid") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("text").alias("text_a"))
    right = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    right = right.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(left, ["a", "part"]).select("a", "b", "text_a", "text_b")
    return both.mapInPandas(lambda batches: _confirmed(batches, width), "a long, b long")


def _grouping(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (rid) with the ``group`` of each, as far as known."""
    named = groups.select(F.col("node").alias("rid"), "component")
    return rows.join(named, "rid", "left").withColumn("group", F.coalesce("component", "rid")).drop("component")


def _mixed(members: DataFrame) -> DataFrame:
    """The members (bucket, rid, group) of buckets that are not of one group."""
    mixed = members.groupBy("bucket").agg((F.min("group") != F.max("group")).alias("mixed")).where("mixed").select("bucket")
    return members.join(mixed, "bucket")


def crowds(forest: DataFrame) -> DataFrame:
    """(bucket, rid) of the classes in buckets of more than a tree's window reaches."""
    rows = forest.select("rid", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "keys")
    index = save(rows.select(F.xxhash64("tree", F.expr(f"substring(keys, tree * {DEPTH * 4} + 1, {PREFIX * 4})")).alias("bucket"), "rid"), "index")
    large = save(index.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > NEAR + 1).select("bucket"), "large")
    found = save(sifted(index, large, "bucket").where("maybe").select("bucket", "rid").join(large, "bucket"), "crowds")
    drop(index, large)
    return found


def _shingled(batches: Iterator[pd.DataFrame], width: int = WIDTH) -> Iterator[pd.DataFrame]:
    shingles = Shingler(width)

    def frame(held: list[tuple[int, int, np.ndarray]]) -> pd.DataFrame:
        size = [len(s) for _, _, s in held]
        every = lambda values: np.repeat(np.array(values, dtype=np.int64), size)
        return pd.DataFrame({"rid": every([r for r, _, _ in held]), "group": every([g for _, g, _ in held]), "n": every(size), "shingle": np.concatenate([s for _, _, s in held]).view(np.int64)})

    for batch in batches:
        held, count = [], 0
        for rid, group, text in zip(batch["rid"], batch["group"], batch["text"], strict=True):
            held.append((rid, group, shingles(text)))
            count += len(held[-1][2])
            if count > HELD:
                yield frame(held)
                held, count = [], 0
        if held:
            yield frame(held)


def rarest(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """All pairs (a, b) of different groups that may be similar; ``texts`` has rid, group and text.

    Shingles are put in order of their frequency. A shingle of one text only meets nothing; such are counted,
    not sorted.
    """
    rows = save(texts.select("rid", "group", "text").mapInPandas(lambda batches: _shingled(batches, width), "rid long, group long, n long, shingle long"), "shingles")
    shared = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    mine = W.partitionBy("rid")  # the shingles of one text
    ranked = rows.join(shared, "shingle").select("*", F.row_number().over(mine.orderBy("df", "shingle")).alias("rank"), F.count("*").over(mine).alias("shared"))
    place, n = F.col("n") - F.col("shared") + F.col("rank"), F.col("n")
    least = F.ceil(PERCENT * n / 100)  # in common with any similar set
    larger = F.ceil(2 * PERCENT * n / (100 + PERCENT))  # in common with a similar set that is not smaller
    prefix = save(ranked.where(place <= n - least + 1).select("shingle", "rid", "group", "n", (n - place + 1).alias("rest"), (place <= n - larger + 1).alias("first")), "prefix")
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("group", "n", "rest")]
    small = prefix.where("first").select("shingle", F.col("rid").alias("a"), *side("a"))
    large = prefix.select("shingle", F.col("rid").alias("b"), *side("b"))
    fit = ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))) & (100 * F.col("n_a") >= PERCENT * F.col("n_b"))
    # what follows the first shingle in common is all that two texts can share
    fit &= (100 + PERCENT) * F.least("rest_a", "rest_b") >= PERCENT * (F.col("n_a") + F.col("n_b"))
    pairs = save(small.join(large, "shingle").where(fit & (F.col("group_a") != F.col("group_b"))).select("a", "b").distinct(), "rare")
    drop(rows, prefix)
    return pairs


def crowded_links(staged: DataFrame, forest: DataFrame, found: DataFrame, width: int = WIDTH) -> DataFrame:
    """``found`` and the links of large buckets that connect what these leave apart."""
    members = crowds(forest)
    known = save(_mixed(_grouping(members, components(found))), "known")
    drop(members)
    if known.isEmpty():
        return found
    own = known.select("rid").distinct()
    likely = sifted(staged.select("rid", text_of(staged).alias("text")), own, "rid").where("maybe").drop("maybe")
    texts = save(likely.join(own, "rid", "left_semi"), "texts")
    sketches = save(forest.select("rid", "sketch").join(own, "rid", "left_semi"), "sketches")
    degree = found.select(F.explode(F.array("a", "b")).alias("rid")).groupBy("rid").agg(F.count("*").alias("degree"))
    linked = known.join(degree, "rid", "left").select("bucket", F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "rid", "group").alias("pivot"))
    most = linked.groupBy("bucket").agg(F.max("pivot").alias("pivot"))
    met = known.join(most, "bucket").where(F.col("group") != F.col("pivot.group")).select(F.col("pivot.rid").alias("a"), F.col("rid").alias("b")).distinct()
    met = save(agreeing(met, sketches), "met")
    first = save(found.unionByName(confirm_dealt(met, texts, width)), "links")
    left = save(_mixed(_grouping(known.select("bucket", "rid"), components(first))).select("rid", "group").distinct(), "apart")
    rare = rarest(texts.join(left, "rid"), width)
    close = save(agreeing(rare, sketches), "met")
    every = save(first.unionByName(confirm_dealt(close, texts, width)), "links")
    drop(known, texts, sketches, met, first, left, rare, close)
    return every


def text_of(staged: DataFrame) -> Column:
    """The text stands in the row itself if that carries it."""
    return F.col("row.text") if "text" in staged.schema["row"].dataType.names else F.col("text")


def links(staged: DataFrame, forest: DataFrame, width: int = WIDTH) -> DataFrame:
    """Confirmed links between classes, enough of them to connect all that any candidate connects."""
    pairs = candidates(forest)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    likely = sifted(staged.select("rid", text_of(staged).alias("text")), ends, "rid").where("maybe").drop("maybe")
    texts = save(likely.join(ends, "rid", "left_semi"), "texts")
    # each class's most similar candidate
    both = pairs.select("a", "b", "agree", F.explode(F.array("a", "b")).alias("rid"))
    best = both.groupBy("rid").agg(F.max(F.struct("agree", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    first = save(confirm(best, texts, width), "confirmed")
    groups = components(first)
    left = groups.select(F.col("node").alias("a"), F.col("component").alias("group_a"))
    right = groups.select(F.col("node").alias("b"), F.col("component").alias("group_b"))
    apart = pairs.join(left, "a", "left").join(right, "b", "left")
    apart = apart.where(F.coalesce("group_a", "a") != F.coalesce("group_b", "b")).join(best, ["a", "b"], "left_anti")
    second = confirm(apart, texts, width)
    both = save(first.unionByName(second), "links")
    drop(pairs, texts, first)
    return crowded_links(staged, forest, both, width)


def grouped(docs: DataFrame, carry: list[str], width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The staged rows (row, doc, rid, n) and, for those with shingles, rid, component_id and kept."""

    @F.pandas_udf("n long, set_a long, set_b long, keys binary, sketch binary")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return _signed(batches, width)

    text = [] if "text" in carry else ["text"]
    numbered = docs.select(F.struct(*carry).alias("row"), F.col("doc_id").alias("doc"), *text, F.monotonically_increasing_id().alias("rid"))
    staged = numbered.withColumn("s", sign(text_of(numbered))).select("row", "doc", *text, "rid", "s.*")
    staged = save(staged, "signed")
    full = staged.where("n > 0")
    classes = full.groupBy("n", "set_a", "set_b").agg(F.min("rid").alias("class"))
    member = save(full.select("rid", "n", "set_a", "set_b", "doc").join(classes, ["n", "set_a", "set_b"]).select("rid", "doc", "class"), "members")
    heads = classes.select(F.col("class").alias("rid"))
    found = links(staged, full.select("rid", "keys", "sketch").join(heads, "rid"), width)
    groups = components(found).select(F.col("node").alias("class"), "component")
    group = save(member.join(groups, "class", "left").select("rid", "doc", F.coalesce("component", "class").alias("group")), "grouped")
    drop(member, found)
    least = group.groupBy("group").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("doc"), F.col("rid").alias("rid"))).alias("head"))
    named = group.join(least, "group").select("rid", F.col("head.doc").alias("component_id"), (F.col("rid") == F.col("head.rid")).alias("kept"))
    return staged, named


def near_duplicates(docs: DataFrame, carry: list[str], width: int = WIDTH) -> DataFrame:
    """The carried columns as ``row`` with n_shingles, component_id (smallest doc_id) and kept.

    Exactly one row of each component is kept, also if ids repeat.
    """
    staged, named = grouped(docs, carry, width)
    out = staged.select("row", "rid", "doc", "n").join(named, "rid", "left")
    return out.select(
        "row",
        F.col("n").alias("n_shingles"),
        F.when(F.col("kept").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("kept", F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without all but one of each group of near duplicates.

    Only documents that may have to go are shuffled.
    """
    staged, named = grouped(docs, docs.columns, width)
    copies = save(named.where("NOT kept").select("rid"), "copies")
    marked = sifted(staged.select("row", "rid"), copies, "rid")
    stay = marked.where("maybe").join(copies, "rid", "left_anti").select("row")
    return stay.unionByName(marked.where("NOT maybe").select("row")).select("row.*")
