"""Ranked lexical search over a length-stratified index.

A document's score depends on its length only through the normaliser m, so documents of equal m
form a stratum, cut into segments of bounded size. A segment lists, per term, its documents by
frequency tf; the impact of a term depends on tf and m alone and is computed once per tf of the
segment, not per posting. The largest tf of each term in a segment bounds what any of its documents
can score for a query. A task visits segments in the order of these bounds and stops where the
bound falls below the tenth best score so far.

Queries come in blocks of about ``BLOCK`` terms; a block's terms, the only thing sent to every task,
hold that many entries or those of a single item. A first pass visits the best segment of each task
only, which gives every query a score that its tenth document has at least; the second pass starts
from there. Documents of a bound equal to that score are visited too, so ties are exact.

The index holds the terms that some query contains. Which these are reaches the tokenising tasks as
a bit table of fixed size, so that a few others may pass; they are joined with nothing.

Defined cases: a null or empty text has no terms and is no document of the collection; items without
terms, or whose terms no document holds, return nothing; repeated documents are documents each,
ordered by doc_id (null last) and then by content and position; repeated items are ranked each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelwright.llm.store import drop, save

TOP = 10
#: Postings of a segment, terms of a block of queries, segments whose visits a task orders at once.
SEGMENT, BLOCK, HELD = 200_000, 1_000_000, 48
#: Bits of the table of queried terms (1 MB).
SIEVE = 1 << 23
#: Separators become a space, A to Z become lower case; all bytes of other characters stay.
_TABLE = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)
#: The same in DuckDB's SQL.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def _bit(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term) % SIEVE


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


# --- queries


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        no, word, times = [], [], []
        for i, text in zip(batch["no"].to_pylist(), batch["text"].to_pylist(), strict=True):
            for t, n in Counter(terms(text)).items():
                no.append(i), word.append(t.decode()), times.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(word, pa.string()), pa.array(times, pa.int64())], ["no", "term", "times"])


class Queries:
    """A block of items: for each, its terms and their weights times repeats."""

    def __init__(self, rows: list):
        """``rows``: (item number, term, w * times), sorted by item number."""
        self.items = np.unique(np.array([r[0] for r in rows], dtype=np.int64))
        words = sorted({r[1] for r in rows})
        self.ids = {w: k for k, w in enumerate(words)}
        self.item = np.searchsorted(self.items, np.array([r[0] for r in rows], dtype=np.int64))
        self.term = np.array([self.ids[r[1]] for r in rows], dtype=np.int64)
        self.weight = np.array([r[2] for r in rows], dtype=np.int64)
        self.starts = np.searchsorted(self.item, np.arange(len(self.items) + 1))


# --- index


def _tokenised(bits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per document its number of terms, and those queried with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, dtype=np.uint8)
        known: dict[bytes, str | None] = {}
        for batch in batches:
            n, starts, words, tfs = [], [0], [], []
            for text in batch["text"].to_pylist():
                found = terms(text)
                n.append(len(found))
                for t, tf in Counter(found).items():
                    if t not in known:
                        b = _bit(t)
                        known[t] = t.decode() if table[b >> 3] >> (b & 7) & 1 else None
                    if known[t] is not None:
                        words.append(known[t]), tfs.append(tf)
                starts.append(len(words))
                if len(known) > 300_000:
                    known.clear()
            at = pa.array(starts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["tie"], pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(words, pa.string())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))],
                ["doc_id", "tie", "n", "terms", "tfs"],
            )

    return run


_SEGMENT = "m long, doc_id array<long>, tie array<long>, terms array<string>, groups array<int>, tf array<int>, sizes array<int>, docs array<int>"


def _segment(m: int, held: list[tuple]) -> pa.RecordBatch:
    """Documents of equal m: terms in order, each with its tfs from the largest, each with its documents."""
    words = np.concatenate([h[2] for h in held])
    names, term = np.unique(words.astype(str), return_inverse=True)
    doc = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
    tf = np.concatenate([h[3] for h in held]).astype(np.int64)
    order = np.lexsort((doc, -tf, term))
    term, tf, doc = term[order], tf[order], doc[order]
    new = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(tf) != 0)])
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [pa.array([m], pa.int64()), one([h[0] for h in held], pa.int64()), one([h[1] for h in held], pa.int64()), one(names.tolist(), pa.string()),
         one(np.bincount(term[new], minlength=len(names)), pa.int32()), one(tf[new], pa.int32()), one(np.diff(np.r_[new, len(term)]), pa.int32()), one(doc, pa.int32())],
        ["m", "doc_id", "tie", "terms", "groups", "tf", "sizes", "docs"],
    )


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts sorted documents where m changes or a segment is full."""
    held, m, size = [], None, 0
    for batch in batches:
        words, tfs = batch["terms"], batch["tfs"]
        at = words.offsets.to_numpy()
        word, tf = words.values.to_numpy(zero_copy_only=False), tfs.values.to_numpy(zero_copy_only=False)
        for k, (own, doc_id, tie) in enumerate(zip(batch["m"].to_pylist(), batch["doc_id"].to_pylist(), batch["tie"].to_pylist(), strict=True)):
            if held and (own != m or size >= SEGMENT):
                yield _segment(m, held)
                held, size = [], 0
            m = own
            held.append((doc_id, tie, word[at[k] : at[k + 1]], tf[at[k] : at[k + 1]]))
            size += at[k + 1] - at[k]
    if held:
        yield _segment(m, held)


def normaliser(total_docs: int, total_terms: int) -> Column:
    """m of a document with ``n`` terms."""
    return F.expr(f"25L + (75L * n * {total_docs}L) div {max(total_terms, 1)}L")


def index(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Segments, document frequencies of the terms in ``wanted`` (term), and the number of documents."""
    spark = docs.sparkSession
    hashed = wanted.select("term").distinct().mapInArrow(_bits, "bit long")
    cells = hashed.groupBy(F.shiftright("bit", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(bit, 64) as int))")).alias("bits"))
    table = np.zeros(SIEVE // 64, dtype=np.int64)
    for cell, bits in cells.toLocalIterator():  # at most SIEVE / 64 rows
        table[cell] = bits
    shared = spark.sparkContext.broadcast(table.tobytes())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    tokens = save(rows.mapInArrow(_tokenised(shared), "doc_id long, tie long, n long, terms array<string>, tfs array<int>"), "terms")
    whole = tokens.where("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = tokens.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    placed = tokens.where(F.size("terms") > 0).withColumn("m", normaliser(whole.docs, whole.terms))
    # sorted by m over all tasks; a stratum of many documents is dealt over several by the tie
    parts = placed.repartitionByRange("m", "tie", "doc_id").sortWithinPartitions("m", "tie", "doc_id")
    segments = save(parts.select("m", "doc_id", "tie", "terms", "tfs").mapInArrow(_segments, _SEGMENT), "segments")
    df = save(df, "df")
    drop(tokens)
    return segments, df, whole.docs


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_bit(t.encode()) for t in batch["term"].to_pylist()], pa.int64())], ["bit"])


# --- visits


class _Segment:
    """A segment as a task holds it: only the terms of the block, impacts per (term, tf)."""

    def __init__(self, batch: pa.RecordBatch, row: int, q: Queries):
        arrays = {name: batch[name].slice(row, 1).flatten() for name in ("doc_id", "tie", "terms", "groups", "tf", "sizes", "docs")}
        self.m = batch["m"][row].as_py()
        self.doc_id, self.tie = arrays["doc_id"], arrays["tie"].to_numpy()
        ids = np.array([q.ids.get(t, -1) for t in arrays["terms"].to_pylist()], dtype=np.int64)
        groups, sizes = arrays["groups"].to_numpy().astype(np.int64), arrays["sizes"].to_numpy().astype(np.int64)
        ends = np.cumsum(groups)
        at, until = ends - groups, np.r_[0, np.cumsum(sizes)]
        self.impact = impact(arrays["tf"].to_numpy().astype(np.int64), self.m)
        self.sizes, self.docs, self.from_ = sizes, arrays["docs"].to_numpy(), until
        here = ids >= 0
        self.first, self.last = np.zeros(len(q.ids), dtype=np.int64), np.zeros(len(q.ids), dtype=np.int64)
        self.first[ids[here]], self.last[ids[here]] = at[here], ends[here]
        top = np.zeros(len(q.ids), dtype=np.int64)
        top[ids[here]] = self.impact[at[here]]  # a term's largest tf comes first
        self.bound = np.add.reduceat(q.weight * top[q.term], q.starts[:-1])

    def scores(self, q: Queries, item: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents scoring at least ``least`` (and above 0) for an item."""
        part = slice(q.starts[item], q.starts[item + 1])
        total = np.zeros(len(self.tie), dtype=np.int64)
        for t, w in zip(q.term[part], q.weight[part], strict=True):
            a, b = self.first[t], self.last[t]
            if a < b and w:
                total[self.docs[self.from_[a] : self.from_[b]]] += np.repeat(w * self.impact[a:b], self.sizes[a:b])
        at = np.flatnonzero(total >= max(least, 1))
        return at, total[at]


class _Best:
    """The best documents of each item a task has seen."""

    def __init__(self, q: Queries, least: np.ndarray):
        self.q, self.least, self.rows = q, least.copy(), [[] for _ in q.items]

    def add(self, segment: _Segment, item: int) -> None:
        at, score = segment.scores(self.q, item, self.least[item])
        if not len(at):
            return
        if len(at) > TOP:  # ties of the last place stay
            keep = score >= np.partition(score, -TOP)[-TOP]
            at, score = at[keep], score[keep]
        ids, ties = segment.doc_id.take(pa.array(at)).to_pylist(), segment.tie[at].tolist()
        new = [(-s, i is None, i or 0, t) for s, i, t in zip(score.tolist(), ids, ties, strict=True)]
        self.rows[item] = sorted(self.rows[item] + new)[:TOP]
        if len(self.rows[item]) == TOP:
            self.least[item] = max(self.least[item], -self.rows[item][-1][0])

    def batch(self) -> pa.RecordBatch:
        rows = [(int(no), None if x[1] else x[2], x[3], -x[0]) for no, found in zip(self.q.items, self.rows, strict=True) for x in found]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["no", "doc_id", "tie", "score"])


def _visits(shared, everything: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All segments that can matter in the order of their bounds; else only each item's best one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, least = shared.value
        best = _Best(q, least)
        ahead = np.zeros(len(q.items), dtype=np.int64)
        held: list[_Segment] = []

        def visit() -> None:
            bound = np.stack([s.bound for s in held])
            for item in range(len(q.items)):
                order = np.argsort(-bound[:, item], kind="stable")
                for k in order if everything else order[:1]:
                    b = bound[k, item]
                    if b <= 0 or b < best.least[item] or (not everything and b <= ahead[item]):
                        break
                    ahead[item] = max(ahead[item], b)
                    best.add(held[k], item)
            held.clear()

        for batch in batches:
            for row in range(batch.num_rows):
                held.append(_Segment(batch, row, q))
                if len(held) == HELD:
                    visit()
        if held:
            visit()
        yield best.batch()

    return run


def _ranked(found: DataFrame) -> DataFrame:
    order = W.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "tie")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def search(docs: DataFrame, items: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns of each item as ``row`` with rank, doc_id and score of its best documents."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    asked = save(items.select(F.struct(*carry).alias("row"), F.monotonically_increasing_id().alias("no"), "text"), "items")
    wanted = save(asked.select("no", "text").mapInArrow(_item_terms, "no long, term string, times long"), "wanted")
    segments, df, total = index(docs, wanted)
    w = F.floor(1000 * F.log((F.lit(2.0) * total + 2) / (2 * F.col("df") + 1)))
    weighted = save(wanted.join(df, "term").select("no", "term", (w * F.col("times")).alias("weight")), "weights")
    blocks = max(1, -(-weighted.count() // BLOCK))
    shape = "no long, doc_id long, tie long, score long"
    found = []
    for block in range(blocks):
        rows = weighted.where(F.pmod(F.xxhash64("no"), F.lit(blocks)) == block).orderBy("no", "term").collect()  # about BLOCK rows
        if not rows:
            continue
        q = Queries(rows)
        nothing = np.zeros(len(q.items), dtype=np.int64)
        first = _ranked(segments.mapInArrow(_visits(sc.broadcast((q, nothing)), False), shape)).where(F.col("rank") == TOP)
        least = nothing
        for r in first.select("no", "score").collect():  # a row per item of the block
            least[np.searchsorted(q.items, r.no)] = r.score
        found.append(save(_ranked(segments.mapInArrow(_visits(sc.broadcast((q, least)), True), shape)), "found"))
    drop(segments, df, wanted, weighted)
    if not found:
        return asked.select("row", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return asked.join(whole, "no").select("row", "rank", "doc_id", "score")


SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS ts
  FROM documents
), n AS (SELECT doc_id, len(ts) AS n, ts FROM d WHERE len(ts) > 0),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
p AS MATERIALIZED (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM n) GROUP BY doc_id, term, n),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS MATERIALIZED (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark
  ) GROUP BY item_id, term
), s AS (
  SELECT q.item_id, p.doc_id,
    CAST(sum(q.times * CAST(floor(1000 * ln((2.0 * w.docs + 2) / (2 * df.df + 1))) AS BIGINT)
      * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * p.n * w.docs) // w.total)))) AS BIGINT) AS score
  FROM q JOIN df ON q.term = df.term JOIN p ON q.term = p.term CROSS JOIN whole w
  GROUP BY q.item_id, p.doc_id
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
) WHERE rank <= {TOP}
"""
