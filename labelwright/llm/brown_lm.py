"""Class-based bigram language model with exchange clustering.

log P(text) = sum over tokens of log P(class | class before) + log P(word | class). Tokens are a
text's words and one end. The words frequent enough to have evidence (at most ``WORDS``, at least
``LEAST`` occurrences) are clustered into ``CLASSES`` classes by exchange: each word moves to the
class that raises the likelihood of the class bigrams most. All rarer words form a class of their
own, which also gives unknown words their share, and so does the end. Counts are of all training
tokens; the clustered vocabulary, its classes and the class bigrams are bounded by the parameters
and are all that is sent to every task. Counts of the other words stay a table and are joined.

Exchange in parallel: the words' neighbour lists are a table; a round tallies the class bigrams in
one pass over it, and in a second one lets a part of the words choose against that tally. The
classes of the best round are kept.

Defined cases: a null or empty text is a single end token; a null doc_id has the remainder of the
empty text's checksum (0: held out); repeated rows count and are scored like any other; without
training tokens every token is unknown.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.llm.store import save
from labelwright.llm.words import byte_words

WORDS, LEAST, CLASSES = 65_536, 3, 64
#: Parts of the vocabulary that move in turn, and rounds.
PARTS, ROUNDS = 3, 6
#: Smoothing of transitions: pseudo-tokens dealt by the classes' overall shares.
PRIOR = 50.0
#: Distinct words or tokens a task holds before it hands its counts on.
HOLD = 400_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Word counts of training texts, and the number of ends under the empty word."""
    held: Counter = Counter()

    def give() -> pd.DataFrame:
        out = pd.DataFrame({"word": [w.decode("utf-8", "replace") for w in held], "c": list(held.values())})
        held.clear()
        return out

    for batch in batches:
        for text in batch["text"]:
            held.update(byte_words(text))
            held[b""] += 1
            if len(held) > HOLD:
                yield give()
    if held:  # a frame without rows has no text column type
        yield give()


class Vocabulary:
    """The clustered words with their counts, in order of frequency; then the end, then all others."""

    def __init__(self, words: list[str], counts: list[int], ends: int):
        self.ids = {w.encode(): i for i, w in enumerate(words)}
        self.end, self.rare = len(words), len(words) + 1
        self.counts = np.array([*counts, ends, 0], dtype=np.int64)

    def sequence(self, text: str | None) -> tuple[np.ndarray, list[bytes]]:
        """Ids from the end before the text to the end after it, and the text's words."""
        words, get, rare = byte_words(text), self.ids.get, self.rare
        out = np.full(len(words) + 2, self.end, dtype=np.int64)
        out[1:-1] = np.fromiter((get(w, rare) for w in words), dtype=np.int64, count=len(words))
        return out, words


def _bigrams(vocab) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocab.value
        size = v.rare + 1
        held: list[np.ndarray] = []
        n = 0

        def give() -> pd.DataFrame:
            code, times = np.unique(np.concatenate(held) if held else np.array([], dtype=np.int64), return_counts=True)
            held.clear()
            return pd.DataFrame({"i": code // size, "j": code % size, "n": times})

        for batch in batches:
            for text in batch["text"]:
                s, _ = v.sequence(text)
                held.append(s[:-1] * size + s[1:])
                n += len(s)
                if n > 4 * HOLD:
                    n = 0
                    yield give()
        yield give()

    return run


def _tally(batch: pd.DataFrame, cls: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Per word of the batch, how often each class follows and precedes it."""
    n = len(batch)
    out = []
    for ids, times in (("succ_id", "succ_n"), ("pred_id", "pred_n")):
        sizes = np.fromiter(map(len, batch[ids]), dtype=np.int64, count=n)
        who = np.repeat(np.arange(n), sizes)
        flat = np.concatenate(batch[ids].to_list()) if sizes.sum() else np.array([], dtype=np.int64)
        w = np.concatenate(batch[times].to_list()) if sizes.sum() else np.array([], dtype=np.int64)
        out.append(np.bincount(who * kinds + cls[flat.astype(np.int64)], weights=w, minlength=n * kinds).reshape(n, kinds))
    return out[0], out[1]


def _class_bigrams(state) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cls, kinds = state.value
        total = np.zeros((kinds, kinds))
        for batch in batches:
            after, before = _tally(batch, cls, kinds)
            own = cls[batch["i"].to_numpy()]
            np.add.at(total, own, after)
            for fixed in (kinds - 2, kinds - 1):  # end and others have no row of their own here
                np.add.at(total[fixed], own, before[:, fixed])
        a, b = np.nonzero(total)
        yield pd.DataFrame({"a": a, "b": b, "n": total[a, b]})

    return run


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def best_class(own: int, after: np.ndarray, before: np.ndarray, twin: float, big: np.ndarray, classes: int) -> int:
    """The class in which the word gives the class bigrams the highest likelihood, its present one on ties.

    ``after`` and ``before`` count the classes around the word, ``twin`` how often it follows itself.
    """
    at = np.flatnonzero((after > 0) | (before > 0))
    rest = big.copy()
    rest[own, :] -= after
    rest[:, own] -= before
    rest[own, own] += twin
    after, before = after.copy(), before.copy()
    after[own] -= twin
    before[own] -= twin
    k = np.arange(classes)
    row, col = rest[:classes][:, at], rest[at][:, :classes].T
    gain = (_phi(row + after[at]) - _phi(row)).sum(axis=1) + (_phi(col + before[at]) - _phi(col)).sum(axis=1)
    # the cell of a class with itself gets both sides and the word's own pairs at once
    diag = rest[k, k]
    gain += _phi(diag + after[k] + before[k] + twin) - _phi(diag + after[k]) - _phi(diag + before[k]) + _phi(diag)
    # words of a class, of its present one without this word; pairs into the word stay with their class
    weight = after.sum() + twin
    size = big.sum(axis=1)[:classes]
    size[own] -= weight
    gain -= 2 * (_phi(size + weight) - _phi(size))
    best = int(gain.argmax())
    return own if gain[own] >= gain[best] - 1e-9 else best


def _moved(state, part: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cls, kinds, big = state.value
        for batch in batches:
            batch = batch[batch["i"] % PARTS == part]
            after, before = _tally(batch, cls, kinds)
            own = cls[batch["i"].to_numpy()]
            new = [best_class(int(c), after[k], before[k], float(t), big, kinds - 2) for k, (c, t) in enumerate(zip(own, batch["twin"], strict=True))]
            yield pd.DataFrame({"i": batch["i"].to_numpy(), "c": np.array(new, dtype=np.int64)})[np.array(new, dtype=np.int64) != own]

    return run


def likelihood(big: np.ndarray) -> float:
    return float(_phi(big).sum() - 2 * _phi(big.sum(axis=1)).sum())


def exchange(bigrams: DataFrame, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the clustered words, the end and the others, and the class bigram counts.

    ``bigrams`` has i, j, n. A word's neighbour list holds at most ``WORDS`` + 2 entries.
    """
    sc = bigrams.sparkSession.sparkContext
    m, kinds = vocab.end, CLASSES + 2
    cls = np.r_[np.arange(m) % CLASSES, CLASSES, CLASSES + 1].astype(np.int64)
    listed = lambda me, other, name: (
        bigrams.where(F.col(me) < m).groupBy(F.col(me).alias("i")).agg(F.collect_list(F.struct(other, "n")).alias(name))
    )
    twin = F.coalesce(F.get(F.filter("s", lambda x: x["j"] == F.col("i")), 0)["n"], F.lit(0)) if m else F.lit(0)
    lists = listed("i", "j", "s").join(listed("j", F.col("i").alias("k"), "p"), "i")
    words = save(
        lists.select(
            "i", F.col("s.j").alias("succ_id"), F.col("s.n").alias("succ_n"), F.col("p.k").alias("pred_id"), F.col("p.n").alias("pred_n"), twin.alias("twin")
        ),
        "neighbours",
    )
    fixed = {(int(r.i), int(r.j)): int(r.n) for r in bigrams.where((F.col("i") >= m) & (F.col("j") >= m)).collect()}  # at most four rows

    def tallied() -> np.ndarray:
        state = sc.broadcast((cls, kinds))
        got = words.mapInPandas(_class_bigrams(state), "a int, b int, n double").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
        big = np.zeros((kinds, kinds))
        for a, b, n in got:
            big[a, b] = n
        for (i, j), n in fixed.items():
            big[cls[i], cls[j]] += n
        return big

    big = tallied()
    best = (likelihood(big), cls, big)
    for r in range(ROUNDS if m else 0):
        state = sc.broadcast((cls, kinds, big))
        cls = cls.copy()
        for i, c in words.mapInPandas(_moved(state, r % PARTS), "i long, c long").collect():  # at most WORDS rows
            cls[i] = c
        big = tallied()
        now = likelihood(big)
        if now > best[0]:
            best = (now, cls, big)
        else:
            cls, big = best[1:]
    return best[1], best[2]


class Model:
    """What every task needs to score: the clustered vocabulary and log10 tables."""

    def __init__(self, vocab: Vocabulary, cls: np.ndarray, big: np.ndarray, tokens: int, kinds: int, rare_tokens: int, rare_words: int, discount: float):
        self.vocab, self.cls, self.tokens = vocab, cls, tokens
        self.whole = tokens + 0.1 * (kinds + 1)
        size = np.bincount(cls, weights=vocab.counts, minlength=len(big))
        size[-1] = rare_tokens
        share = (size + 0.1) / (size.sum() + 0.1 * len(size))
        self.step = np.log10((big + PRIOR * share) / (big.sum(axis=1, keepdims=True) + PRIOR))
        known = np.maximum(vocab.counts, 1)
        self.emit = np.log10(known / np.maximum(size[cls], 1))
        self.emit[vocab.rare] = 0.0  # joined later
        self.base = np.log10((vocab.counts + 0.1) / self.whole)
        self.base[vocab.rare] = 0.0
        if not vocab.counts[vocab.end]:
            self.emit[vocab.end] = 0.0
        self.rare_tokens, self.rare_words, self.discount = rare_tokens, rare_words, discount

    def rare_emit(self, c: Column) -> Column:
        """log10 P(word | others) of a word with c training tokens; null: unknown."""
        if not self.rare_tokens:
            return F.lit(0.0)
        unknown = self.discount * self.rare_words / self.rare_tokens
        return F.log10(F.when(c.isNull(), F.lit(unknown)).otherwise((c - self.discount) / self.rare_tokens))


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the training texts and the table (word, c) of all their words."""
    sc = docs.sparkSession.sparkContext
    texts = docs.where(~held_out(F.col("doc_id"))).select("text")
    counts = save(texts.mapInPandas(_counted, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")
    words = counts.where("word <> ''")
    ends = sum(r.c for r in counts.where("word = ''").collect())
    # sixteen steps an octave: a bounded table from which the threshold is read
    step = F.floor(F.log2("c") * 16)
    rows = words.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2"))
    steps = sorted(((r.step, r.n, r.c, r.n1, r.n2) for r in rows.collect()), reverse=True)
    least, taken = None, 0
    for s, n, *_ in steps:
        if taken + n > WORDS or 2 ** ((s + 1) / 16) <= LEAST:
            break
        least, taken = s, taken + n
    top = [] if least is None else words.where((step >= least) & (F.col("c") >= LEAST)).collect()  # at most WORDS rows
    top.sort(key=lambda r: (-r.c, r.word))
    vocab = Vocabulary([r.word for r in top], [r.c for r in top], ends)
    tokens, kinds = sum(s[2] for s in steps) + ends, sum(s[1] for s in steps) + (ends > 0)
    rare_tokens = tokens - ends - int(vocab.counts[: vocab.end].sum())
    rare_words = sum(s[1] for s in steps) - len(top)
    n1, n2 = sum(s[3] for s in steps), sum(s[4] for s in steps)
    discount = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.05), 0.95)
    bigrams = texts.mapInPandas(_bigrams(sc.broadcast(vocab)), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    cls, big = exchange(save(bigrams, "bigrams"), vocab)
    return Model(vocab, cls, big, tokens, kinds, rare_tokens, rare_words, discount), words


def _scored(model) -> Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model.value
        v = m.vocab
        for batch in batches:
            rows = []
            for text in batch:
                s, words = v.sequence(text)
                own, c = s[1:], m.cls[s]
                rare = Counter(words[k] for k in np.flatnonzero(own == v.rare))
                known = len(own) - sum(rare.values()) - (v.counts[v.end] == 0)
                rows.append(
                    (
                        len(own),
                        int(known),
                        float(m.base[own].sum()),
                        float(m.step[c[:-1], c[1:]].sum() + m.emit[own].sum()),
                        [{"word": w.decode("utf-8", "replace"), "times": t} for w, t in rare.items()],
                    )
                )
            yield pd.DataFrame(rows, columns=["n_tokens", "n_known", "base_score", "score", "rare"])

    return run


def score(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns as ``row`` with the scores of every text by a model of the training texts."""
    model, words = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "n_tokens long, n_known long, base_score double, score double, rare array<struct<word:string,times:long>>"

    first = docs.select(
        F.struct(*carry).alias("row"), held_out(F.col("doc_id")).alias("held_out"), F.monotonically_increasing_id().alias("rid"), F.pandas_udf(_scored(shared), kind)("text").alias("s")
    )
    first = save(first.select("row", "held_out", "rid", "s.*"), "scored")
    # the other words: one row per document and distinct word, joined to its count
    rare = first.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.times").join(words, "word", "left")
    c, times = F.col("c"), F.col("times")
    sums = rare.groupBy("rid").agg(
        F.sum(F.when(c.isNotNull(), times).otherwise(0)).alias("known"),
        F.sum(times * F.log10((F.coalesce(c, F.lit(0)) + 0.1) / model.whole)).alias("base"),
        F.sum(times * model.rare_emit(c)).alias("emit"),
    )
    out = first.drop("rare").join(sums, "rid", "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return out.select(
        "row",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("known")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("base")).alias("base_score"),
        (F.col("score") + zero("emit")).alias("score"),
    )
