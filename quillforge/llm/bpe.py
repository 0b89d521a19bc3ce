"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming inverse.

Method: the merges of a rank table define, for every prefix of a piece, exactly one last token: the
one that fits the last token before it, where two tokens fit when their bytes together merge back
into just these two. A nondeterministic transducer that guesses tokens and checks neighbours thus has
one valid path. ``Transducer`` determinises it as texts ask for it: a state is the run of
bytes that may still grow into a token, with what each of its positions has not yet emitted; tokens
that all positions agree on are emitted at once, so lookahead is bounded by the longest token.
Decoding feeds token bytes to an incremental UTF-8 state machine.

Memory: states, fitting pairs and finished pieces are kept per worker up to STATES, PAIRS and PIECES
entries and then built anew; results never depend on them.

Cases: null is the empty text, with no ids; very long texts are taken whole, and very long pieces run in
time proportional to their length; repeated rows repeat their result; a null doc_id stays null; empty tables
give no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import bisect
import marshal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm import kernels as K
from quillforge.llm.shared import bound_arrow, kept

STATES = 300_000
PAIRS = 300_000
PIECES = 100_000
#: Pieces of more characters are not kept.
PIECE_CHARS = 40


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """Ids of ``piece`` by merging the lowest-ranked neighbours first, the leftmost on ties."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Encodes pieces of bytes; states and transitions are made when first asked for.

    Two neighbours fit unless, while both grow, a right part of the left one merges with a left part
    of the right one: ``spine`` gives a token's successive right (left) parts, each with the
    rank at which the part is swallowed by the next larger one. What a token forbids on its right
    is thus a set of (part, how many of the merges that begin with the part come early enough);
    tokens of equal sets are one class, and states tell classes apart, not tokens.
    """

    def __init__(self, ranks: dict[bytes, int], states: int | None = None) -> None:
        self.ranks = ranks
        self.most = states or STATES
        self.size = max(ranks.values(), default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.growing = {token[:i] for token in ranks for i in range(len(token))}
        #: Ranks of the merges that begin with a part, sorted.
        self.begins: dict[bytes, list[int]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for i in range(1, len(token)):
                if token[i:] in ranks and token[:i] in ranks:
                    self.begins.setdefault(token[:i], []).append(rank)
        self.halves: dict[bytes, bytes] = {}
        self.classes: dict[tuple, int] = {}
        self.class_of: dict[int, int] = {}
        self.left_spine: list[list[tuple[bytes, int]]] = []
        self.right_spine: dict[int, list[tuple[bytes, int]]] = {}
        self.whole: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        # States are kept packed, at a quarter of the memory; only a new arc needs one unpacked.
        start = marshal.dumps((b"", ((-1, ()),)), 2)
        self.index = {start: 0}
        self.states = [start]
        self.arcs: list[dict[int, tuple[int, bytes]]] = [{}]
        self.final = [b""]

    def _stands(self, token: bytes, rank: int) -> bool:
        """Whether the token's own bytes merge into it."""
        known = self.whole.get(rank)
        if known is None:
            known = self.whole[rank] = merge(self.ranks, token) == [rank]
        return known

    def _spine(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """The token and its successive right (or left) parts, each with the rank of what swallows it."""
        limit, out = self.size, []
        while True:
            out.append((token, limit))
            if len(token) == 1:
                return out
            left = self.halves.get(token)
            if left is None:
                # The last merge: all others have happened without it.
                rank = self.ranks.pop(token)
                left = self.halves[token] = self.bytes_of[merge(self.ranks, token)[0]]
                self.ranks[token] = rank
            limit = self.ranks[token]
            token = token[len(left) :] if right else left

    def _class(self, rank: int) -> int:
        known = self.class_of.get(rank)
        if known is None:
            parts = [(part, limit, bisect.bisect_left(self.begins.get(part, ()), limit)) for part, limit in self._spine(self.bytes_of[rank], True)]
            key = tuple((part, n) for part, _, n in parts if n)
            known = self.classes.get(key)
            if known is None:
                known = self.classes[key] = len(self.left_spine)
                self.left_spine.append([(part, limit) for part, limit, n in parts if n])
            self.class_of[rank] = known
        return known

    def _fits(self, left: int, right: int) -> bool:
        """Whether a token of class ``left`` and the token ``right`` stay apart."""
        key = left * self.size + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            spine = self.right_spine.get(right)
            if spine is None:
                spine = self.right_spine[right] = self._spine(self.bytes_of[right], False)
            ranks, none = self.ranks, self.size
            known = self.pairs[key] = not any((m := ranks.get(a + b, none)) < la and m <= lb and m < none for a, la in self.left_spine[left] for b, lb in spine)
        return known

    def _arc(self, state: int, byte: int) -> tuple[int, bytes]:
        run, ends = marshal.loads(self.states[state])
        run += bytes((byte,))
        ranks = self.ranks
        for j in range(len(run)):
            rank = ranks.get(run[j:])
            if rank is not None and self._stands(run[j:], rank):
                last, pending = ends[j]
                if last < 0 or self._fits(last, rank):
                    break
        else:
            raise ValueError(f"no token of the rank table ends {run!r}")
        cut, growing = 0, self.growing
        while run[cut:] not in growing:
            cut += 1
        ends = (*ends[cut:], (self._class(rank), (*pending, rank)))
        first, agreed = ends[0][1], 0
        # The first position's tokens begin what all others hold, or they differ somewhere.
        for agreed in range(len(first) + 1):
            if agreed == len(first) or any(len(p) <= agreed or p[agreed] != first[agreed] for _, p in ends):
                break
        out = b""
        if agreed:
            out = b"".join(x.to_bytes(4, "little") for x in first[:agreed])
            ends = tuple((last, p[agreed:]) for last, p in ends)
        arc = self.arcs[state][byte] = (self._number((run[cut:], ends)), out)
        return arc

    def _number(self, made: tuple) -> int:
        """The state's number; a new one if it isn't there yet."""
        packed = marshal.dumps(made, 2)
        to = self.index.get(packed)
        if to is None:
            to = self.index[packed] = len(self.states)
            self.states.append(packed)
            self.arcs.append({})
            self.final.append(b"".join(x.to_bytes(4, "little") for x in made[1][-1][1]))
        return to

    def encode(self, piece: bytes) -> bytes:
        """Ids of one piece as little-endian 32-bit integers."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return rank.to_bytes(4, "little")
        arcs, state, out = self.arcs, 0, []
        for byte in piece:
            arc = arcs[state].get(byte)
            if arc is None:
                if len(self.states) >= self.most:
                    # Built anew from where the piece stands, so that one long piece keeps the bound too.
                    here = marshal.loads(self.states[state])
                    self.reset()
                    arcs, state = self.arcs, self._number(here)
                arc = self._arc(state, byte)
            state, ids = arc
            if ids:
                out.append(ids)
        out.append(self.final[state])
        return b"".join(out)


class _Pieces(dict):
    """Ids of the pieces seen, filled by the transducer; when it is full, pieces that come again stay."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.transducer = transducer
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.transducer.encode(piece.encode("utf-8", "replace"))
        if len(piece) <= PIECE_CHARS:
            if len(self) >= PIECES:
                self.before = self.copy()
                self.clear()
            self[piece] = ids
        return ids


class Utf8Machine:
    """Takes bytes in any portions and gives the characters that are complete.

    The state is the unfinished character: its bytes so far, how many are missing and the range
    that the next one must be in. Bytes that can't be UTF-8 become U+FFFD.
    """

    def __init__(self) -> None:
        self.open = b""

    @staticmethod
    def missing(tail: bytes) -> int:
        """How many bytes the character that begins ``tail`` lacks; 0 if it is complete or broken."""
        lead = tail[0]
        need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
        for byte in tail[1:need]:
            if not low <= byte <= high:
                return 0
            low, high = 0x80, 0xBF
        return max(0, need - len(tail))

    def feed(self, data: bytes) -> str:
        data = self.open + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                if self.missing(data[-back:]):
                    cut = len(data) - back
                break
            if byte < 0x80:
                break
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Text to ids and back for one rank file and pattern."""

    def __init__(self, path: str, pattern: str, states: int | None = None) -> None:
        self.transducer = Transducer(load_ranks(path), states)
        self.pieces = _Pieces(self.transducer)
        # White space by Unicode's property, as in the library's engine.
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: np.ndarray, portion: int = 1 << 16) -> str:
        machine, out, of = Utf8Machine(), [], self.transducer.bytes_of
        for i in range(0, len(ids), portion):
            out.append(machine.feed(b"".join(map(of.__getitem__, ids[i : i + portion].tolist()))))
        out.append(machine.close())
        return "".join(out)


def codec(path: str, pattern: str, states: int | None = None) -> Codec:
    """One a worker process and rank file, until another operator needs the memory."""
    return kept(("bpe", path, pattern, states), lambda: Codec(path, pattern, states))


def _round_trip(path: str, pattern: str, states: int | None):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, states)
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            for first, last, part, at in K.chunks(data, offsets, 1 << 21):
                raw = part.tobytes()
                ids = [own.encode(raw[at[r] : at[r + 1]].decode("utf-8", "replace")) for r in range(last - first)]
                texts = [own.decode(np.frombuffer(x, "<u4")) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first).cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def round_trip(docs: DataFrame, path: str, pattern: str, states: int | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and decoded text of each row of ``docs``.

    states: how many a worker keeps, STATES by default; fewer take less memory and more time, results are the same.
    """
    bound_arrow(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_round_trip(path, pattern, states), "doc_id long, ids binary, decoded string")


def digest(coded: DataFrame) -> DataFrame:
    """The contract's columns of ``round_trip``."""
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
