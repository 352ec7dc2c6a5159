"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

The merges of a rank table are compiled into a transducer that reads a piece byte by byte. Its state
is the last token that is certain and the bytes after it; the tokens of those bytes are still open,
because a longer token of the vocabulary may yet cover them. States and transitions are found when
they are first needed and kept, and a transition emits the tokens that no continuation can change:
a boundary is certain once every token that could still be growing starts at or after it. So the
lookahead never exceeds the longest token.

Which token ends a prefix is decided locally: a sequence of tokens is the encoding of its bytes if
and only if each neighbouring pair is the encoding of its own bytes. For every prefix of the open
bytes exactly one last token satisfies this with the encoding of the rest.

Decoding joins token bytes and turns them into text with an incremental UTF-8 state machine, which
holds an unfinished character until its next bytes arrive.

Defined cases: a null or empty text has no tokens; special-token strings are ordinary text; decoding
unknown ids is an error; malformed UTF-8 becomes U+FFFD at the end of each longest valid prefix.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from bisect import insort
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries a task keeps of states and pair tests, and of coded pieces, before it starts afresh.
KEEP, CODED = 600_000, 600_000
_BYTES = [bytes((b,)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """The transducer of one rank table, states and transitions made on demand."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.starts = {token[:n] for token in ranks for n in range(1, len(token))}
        self.longest = max(map(len, ranks), default=0)
        #: of a token, its parts at the edge with the rank at which each is merged away
        self.right_edge: dict[bytes, list[tuple[bytes, int]]] = {}
        self.left_edge: dict[bytes, list[tuple[bytes, int]]] = {}
        self.clear()

    def clear(self) -> None:
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[tuple[bytes, bytes], int] = {}
        #: per state: open bytes, last token of each of their prefixes, places where a token that is still growing may start
        self.states: list[tuple[bytes, list[bytes | None], list[int]]] = []
        #: by state * 256 + byte: next state and emitted ids; by state: the ids left at the end of a piece
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}
        self._state(b"", [b""], [0])

    def _state(self, open_: bytes, lasts: list[bytes | None], alive: list[int]) -> int:
        key = (lasts[0] or b"", open_)
        to = self.known.get(key)
        if to is None:
            to = self.known[key] = len(self.states)
            self.states.append((open_, lasts, alive))
        return to

    def _halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts of a token's last merge, by applying merges in rank order."""
        parts = [token[i : i + 1] for i in range(len(token))]
        ranks, none = self.ranks, len(self.ranks) + 1
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1))
            if best == none:
                raise ValueError(f"token {token!r} cannot be merged")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def _edge(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """The token and its parts at one edge, each with the rank of the merge that ends it."""
        edges = self.right_edge if right else self.left_edge
        got = edges.get(token)
        if got is None:
            got, part, end = [], token, len(self.ranks) + 1
            while True:
                got.append((part, end))
                if len(part) == 1:
                    break
                end = self.ranks[part]
                part = self._halves(part)[right]
            edges[token] = got
        return got

    def _pair(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens stay two tokens: no merge across their border comes first.

        A part has a lower rank than what it is merged into, so merging runs through the ranks in
        order and a part lives from its own rank to that of the merge that ends it. A merge across
        the border happens if its rank is below both ends; at equal ranks the left one is first.
        """
        if not left:
            return True
        key = (left, right)
        ok = self.fits.get(key)
        if ok is None:
            rank, ok = self.ranks.get, True
            for a, end_a in self._edge(left, True):
                for b, end_b in self._edge(right, False):
                    t = rank(a + b)
                    if t is not None and t < end_a and t <= end_b:
                        ok = False
                        break
                if not ok:
                    break
            self.fits[key] = ok
        return ok

    def _ids(self, lasts: list[bytes | None], end: int) -> tuple[int, ...]:
        out = []
        while end:
            token = lasts[end]
            out.append(self.ranks[token])
            end -= len(token)
        return tuple(reversed(out))

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        open_, lasts, alive = self.states[state]
        open_ += _BYTES[byte]
        n, ranks, starts = len(open_), self.ranks, self.starts
        # the last token of the open bytes; None: their encoding has no boundary where they begin.
        # No later token can start at such a place, or that boundary would not have become certain
        last, still = None, []
        for s in alive:
            token = open_[s:]
            if last is None and token in ranks:
                left = lasts[s]
                if left is not None and self._pair(left, token):
                    last = token
            # a token that covers the next byte starts here, or where a vocabulary prefix runs up to here
            if token in starts:
                still.append(s)
        still.append(n)
        lasts = [*lasts, last]
        # the boundaries that all of these share are certain: walk the latest back until they meet
        meet = [s for s in still if lasts[s] is not None]
        while len(meet) > 1:
            late = meet.pop()
            before = late - len(lasts[late])
            if before not in meet:
                insort(meet, before)
        cut = meet[0]
        if cut:
            out = self._ids(lasts, cut)
            to = self._state(open_[cut:], lasts[cut:], [s - cut for s in still if s >= cut])
        else:
            out = ()
            to = self._state(open_, lasts, still)
        self.moves[state << 8 | byte] = got = (to, out)
        return got

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        if len(self.moves) + len(self.fits) > KEEP:
            self.clear()
        state, out, moves = 0, [], self.moves
        for byte in piece:
            got = moves.get(state << 8 | byte)
            if got is None:
                got = self._move(state, byte)
            state = got[0]
            if got[1]:
                out += got[1]
        left = self.ends.get(state)
        if left is None:
            open_, lasts, _ = self.states[state]
            left = self.ends[state] = self._ids(lasts, len(open_))
        out += left
        return out


class Utf8Stream:
    """Bytes in any portions to text: the state is the character begun and the bytes it still needs."""

    def __init__(self) -> None:
        self.held = b""

    def _need(self) -> tuple[int, int, int]:
        """Length of the character begun, and the range of its second byte."""
        lead = self.held[0]
        if lead < 0xE0:
            return 2, 0x80, 0xBF
        if lead < 0xF0:
            return 3, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
        return 4, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        i, n = 0, len(data)
        while i < n:
            if not self.held:
                # whole runs of complete characters go the fast way, up to a possibly unfinished tail
                tail = n
                for back in range(1, min(4, n - i) + 1):
                    b = data[n - back]
                    if b >= 0xC0:
                        tail = n - back
                        break
                    if b < 0x80:
                        break
                try:
                    out.append(data[i:tail].decode())
                    i = tail
                    if i == n:
                        break
                except UnicodeDecodeError as e:
                    out.append(data[i : i + e.start].decode())
                    i += e.start
                b = data[i]
                i += 1
                if b < 0x80:
                    out.append(chr(b))
                elif 0xC2 <= b <= 0xF4:
                    self.held = bytes((b,))
                else:
                    out.append("�")
                continue
            length, low, high = self._need()
            b = data[i]
            if (low if len(self.held) == 1 else 0x80) <= b <= (high if len(self.held) == 1 else 0xBF):
                self.held += bytes((b,))
                i += 1
                if len(self.held) == length:
                    out.append(self.held.decode())
                    self.held = b""
            else:
                out.append("�")
                self.held = b""
        return "".join(out)

    def close(self) -> str:
        left, self.held = self.held, b""
        return "�" if left else ""


#: Ids of a piece, their number, as text, and the bytes they stand for.
Coded = tuple[tuple[int, ...], int, str, bytes]
#: Pieces whose bytes the decoder is fed at once.
PORTION = 65_536


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.fst = Transducer(ranks)
        self.pieces = regex.compile(pattern)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.written = {i: str(i) for i in ranks.values()}
        self.coded: dict[str, Coded] = {}

    def _coded(self, piece: str) -> Coded:
        """A piece's ids, their number, as text, and the bytes they stand for."""
        ids = tuple(self.fst.encode(piece.encode("utf-8", "surrogatepass")))
        got = (ids, len(ids), " ".join(map(self.written.__getitem__, ids)), self.decode_bytes(ids))
        if len(piece) <= 64:
            if len(self.coded) > CODED:
                self.coded.clear()
            self.coded[piece] = got
        return got

    def parts(self, text: str) -> list[Coded]:
        """The pieces of a text; those seen before are not run through the transducer again."""
        pieces = self.pieces.findall(text)
        found = list(map(self.coded.get, pieces))
        if None in found:
            get = self.coded.get
            found = [f or get(p) or self._coded(p) for f, p in zip(found, pieces, strict=True)]
        return found

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        return list(chain.from_iterable(map(itemgetter(0), self.parts(text))))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: Iterable[int], portion: int = 1024) -> Iterator[str]:
        """The text in portions as ids arrive."""
        stream, held = Utf8Stream(), []
        for i in ids:
            held.append(i)
            if len(held) == portion:
                yield stream.feed(self.decode_bytes(held))
                held = []
        yield stream.feed(self.decode_bytes(held)) + stream.close()


@contextmanager
def uncollected() -> Iterator[None]:
    """Holds Python's search for reference cycles: the tables have none and are searched in vain each time they grow."""
    gc.disable()
    try:
        yield
    finally:
        gc.freeze()
        gc.enable()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker: the table is read there, from the path that all machines have."""
    return Codec(load_ranks(path), pattern)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The documents' own columns as ``row`` and the token ids of each text as ``ids``."""

    @F.pandas_udf("array<int>")
    def ids_of(text: pd.Series) -> pd.Series:
        with uncollected():
            c = codec(path, pattern)
            return pd.Series([c.encode(t or "") for t in text], dtype=object)

    return docs.select(F.struct("*").alias("row"), ids_of("text").alias("ids"))


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``."""

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        return pd.Series(["".join(c.decode(() if i is None else i)) for i in ids], dtype=object)

    return rows.withColumn("decoded", text_of("ids"))


def _digests(c: Codec, text: str) -> tuple[int, str, str]:
    parts = c.parts(text)
    stream, sha = Utf8Stream(), hashlib.sha256()
    for k in range(0, len(parts), PORTION):
        sha.update(stream.feed(b"".join(map(itemgetter(3), parts[k : k + PORTION]))).encode("utf-8"))
    sha.update(stream.close().encode("utf-8"))
    written = " ".join(map(itemgetter(2), parts))
    return sum(map(itemgetter(1), parts)), hashlib.sha256(written.encode()).hexdigest(), sha.hexdigest()


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The documents' columns but the text as ``row`` with the number of ids and the digests of ids and decoded text.

    Encoding and decoding of a text happen in one pass, so that ids never leave the task.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(text: pd.Series) -> pd.DataFrame:
        with uncollected():
            c = codec(path, pattern)
            return pd.DataFrame([_digests(c, t or "") for t in text], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    # only columns other than the text are carried beside it
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("row"), digest("text").alias("d")).select("row", "d.*")
