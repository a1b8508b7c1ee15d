"""Byte-level BPE as a tree reduction over a monoid.

An element is the token list of some bytes; joining two lists gives the token list of the joined bytes. A
piece of text (one match of the pattern) is halved until parts are small, the parts are encoded by
plain merging, and neighbours are joined on the way up. Only tokens near the border can change: a window of
k tokens on either side is encoded anew, and k doubles until the tokens outside provably stay.

What proves it: a token list is the encoding of its bytes exactly if each of its tokens and each
pair of neighbours is encoded as itself. Pairs outside the window hold already, pairs inside it hold as it is
an encoding, so only the two pairs at the window's edges have to be checked.

Decoding joins bytes up the same tree. Pieces repeat, so each task keeps a bounded table of pieces.

Ranks are the lines of a rank file; its path is a parameter, read once on the driver and broadcast (a
vocabulary's size doesn't grow with the data). Defined results: a null text is empty and has no tokens; special
tokens are ordinary text; rows, ties and other columns pass through (those named n_tokens, ids or decoded, in any case,
are replaced); an empty table gives no rows.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm._frames import give_back

#: Pieces of up to so many bytes are merged directly.
LEAF = 24
#: Above all ranks.
NONE = 1 << 62
#: Pieces in each of the two tables that a worker keeps, also between tasks (some 180 bytes each).
KEPT = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.odd: set[str] = set()

    def merge(self, data: bytes) -> list[int]:
        """Plain encoding: join the neighbours of the lowest rank, the leftmost first, until none has a rank."""
        get = self.ranks.get
        if (whole := get(data)) is not None:
            return [whole]
        bounds = list(range(len(data) + 1))
        joint = [get(data[i : i + 2], NONE) for i in bounds[:-2]]
        while joint and (best := min(joint)) != NONE:
            at = joint.index(best)
            del bounds[at + 1], joint[at]
            if at < len(joint):
                joint[at] = get(data[bounds[at] : bounds[at + 2]], NONE)
            if at:
                joint[at - 1] = get(data[bounds[at - 1] : bounds[at + 1]], NONE)
        ranks = self.ranks
        return [ranks[data[i:j]] for i, j in itertools.pairwise(bounds)]

    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens side by side are encoded as themselves."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > KEPT:
                self.pairs.clear()
            joined = self.tokens[a] + self.tokens[b]
            found = self.pairs[a, b] = joined not in self.ranks and self.merge(joined) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both lists, each an encoding."""
        if not left or not right:
            return left or right
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            data = self.decode(left[a:]) + self.decode(right[:b])
            window = self.merge(data) if len(data) <= 2 * LEAF else self._window(data)
            if (a == 0 or self.stable(left[a - 1], window[0])) and (b == len(right) or self.stable(window[-1], right[b])):
                return left[:a] + window + right[b:]
            k *= 2

    def _window(self, data: bytes) -> list[int]:
        """Plain merging in n log n, for windows that have grown."""
        import heapq

        get, n = self.ranks.get, len(data)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop or get(data[i:stop]) != r:
                continue
            j = end[i]
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (s := get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (s, i, end[stop]))
            if (p := before[i]) >= 0 and (s := get(data[p:stop])) is not None:
                heapq.heappush(heap, (s, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        """Halve, encode, join; level by level, so that the depth of the stack doesn't grow with the text."""
        if len(data) <= LEAF:
            return self.merge(data)
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        row = [self.merge(data[i : i + LEAF]) for i in range(0, len(data), LEAF)]
        while len(row) > 1:
            row = [self.join(row[i], row[i + 1]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
        return row[0]

    def decode(self, ids: Iterable[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.split(text) for i in self.encode_piece(piece.encode())]

    def texts(self, text: str) -> tuple[str, int, bytes]:
        """Decimal ids joined by a space, their number, and the bytes they decode to."""
        parts = self.split(text)
        joined = " ".join([self.known.get(piece) or self._remembered(piece) for piece in parts])
        same = not self.odd or self.odd.isdisjoint(parts)
        data = "".join(parts).encode() if same else self.decode(map(int, joined.split()))
        return joined, joined.count(" ") + 1 if joined else 0, data

    def _remembered(self, piece: str) -> str:
        row = self.older.get(piece)
        if row is None:
            data = piece.encode()
            ids = self.encode_piece(data)
            row = " ".join(map(str, ids))
            if self.decode(ids) != data:  # two tokens of one rank
                self.odd.add(piece)
        if len(piece) <= 64:
            if len(self.known) >= KEPT:  # what is met again comes back from the older table
                self.known, self.older = {}, self.known
            self.known[piece] = row
        return row


def _shared(spark: SparkSession, path: str, pattern: str) -> Callable[[], Codec]:
    """Sends the ranks; the function returned gives each Python worker its one codec."""
    sent = spark.sparkContext.broadcast(load_ranks(path))

    def codec() -> Codec:
        key = (sent._jbroadcast.id() if getattr(sent, "_jbroadcast", None) else id(sent.value), pattern)
        if key not in _codecs:
            _codecs.clear()
            _codecs[key] = Codec(sent.value, pattern)
        return _codecs[key]

    return codec


_codecs: dict = {}


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with n_tokens long, ids string (decimal, joined by a space) and decoded binary (from the ids)."""
    codec = _shared(docs.sparkSession, path, pattern)
    kept = docs.select([c for c in docs.columns if c.lower() not in ("n_tokens", "ids", "decoded")])
    schema = T.StructType(kept.schema.fields[:]).add("n_tokens", "long").add("ids", "string").add("decoded", "binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec()
        for batch in batches:
            text, low, size, rows = batch.column(batch.schema.get_field_index("text")).to_pylist(), 0, 0, []
            for high, t in enumerate(text, 1):
                rows.append(one.texts(t or ""))
                size += len(t or "")
                if size > 1 << 21 or high == len(text):
                    part = batch.slice(low, high - low)
                    ids, n, data = zip(*rows, strict=True)
                    made = [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, "n_tokens", "ids", "decoded"])
                    low, size, rows = high, 0, []
        give_back()

    return kept.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)
