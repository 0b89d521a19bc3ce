"""Benchmark decontamination with a generalised suffix automaton over item words.

Method: normalised item words become integers; one suffix automaton holds every substring of every
item. Training words stream through it: the state and its longest matching length after each word
say whether a whole window (WINDOW consecutive item words, or a shorter item whole) ends there. Words
under any window are hit; spans and documents beyond the length and coverage limits are removed.

Scale: one automaton holds BLOCK_WORDS item words at most and is kept by each worker; with so few
items the documents are read once and never shuffled. More items are several automata: then one
pass over all documents tells by a Bloom filter of all items' window hashes (FILTER_BITS at
most; further windows only let more documents through) which documents may be hit, and only these stream
through the automata. Hits of all blocks are united per document before any limit is applied, so the size of
blocks never changes a result. Words that no item has reset the automaton, so only runs of known words
as long as the shortest window stream through it. The driver holds one block of items at a time.

Cases: null and empty texts have no words and stay; very long texts are taken whole; items without words
match nothing; items without an item_id hit like others but are not named; repeated rows each get
their own result; equal items all count; empty tables give no rows, or rows without hits; other columns
pass through untouched, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.llm import kernels as K
from quillforge.llm.shared import bound_arrow, kept, stage

WINDOW = 10
#: Item words of one automaton.
BLOCK_WORDS = 200_000
#: Bits of the filter of window hashes at most, bits for each window, and probes.
FILTER_BITS, BITS_PER_WINDOW, PROBES = 1 << 27, 16, 3
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


class SuffixAutomaton:
    """All substrings of several word sequences, with the windows that end in each state."""

    def __init__(self, items: Iterable[tuple[str | None, list[int]]], window: int) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        by_length = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        #: Per state of ``window`` words or more: the state of its last ``window`` words.
        self.base = [0] * len(self.link)
        for state in by_length:
            if self.length[state] >= window:
                above = self.link[state]
                self.base[state] = state if self.length[above] < window else self.base[above]
        #: Items of which a window of exactly ``window`` words belongs to the state.
        self.of: dict[int, set[str | None]] = {}
        #: Items shorter than a window, by state: all of one state are equally long.
        self.short: dict[int, set[str | None]] = {}
        self.size_of: dict[int, int] = {}
        self.shortest = min((min(len(w), window) for _, w in items), default=window)
        for name, words in items:
            state = length = 0
            for word in words:
                state, length = self.step(state, length, word)
                if length >= window:
                    self.of.setdefault(self.base[state], set()).add(name)
            if len(words) < window:
                self.short.setdefault(state, set()).add(name)
                self.size_of[state] = len(words)
        #: Per state: itself, or the nearest state on its links, with a short item; 0 without one.
        self.near = [0] * len(self.link)
        for state in by_length:
            self.near[state] = state if state in self.short else self.near[self.link[state]]

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            q = nxt[last][word]
            if length[q] == length[last] + 1:
                return q
            return self._split(last, word, q)
        made = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = made
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[made] = q if length[q] == length[p] + 1 else self._split(p, word, q)
        return made

    def _split(self, p: int, word: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The state and longest matching length after one more word."""
        nxt = self.next
        while word not in nxt[state]:
            if state == 0:
                return 0, 0
            state = self.link[state]
            length = self.length[state]
        return nxt[state][word], length + 1

    def hits(self, words: list[int]) -> Iterator[tuple[int, int, set[str | None]]]:
        """(first word, end word, items) of each window that occurs in ``words``."""
        nxt, link, lengths, window, base, near = self.next, self.link, self.length, self.window, self.base, self.near
        state = length = 0
        for i, word in enumerate(words):
            while word not in nxt[state]:
                if state == 0:
                    break
                state = link[state]
                length = lengths[state]
            else:
                state = nxt[state][word]
                length += 1
                if length >= window:
                    yield i - window + 1, i + 1, self.of[base[state]]
                at = near[state]
                while at:
                    n = self.size_of[at]
                    if n <= length:
                        yield i - n + 1, i + 1, self.short[at]
                    at = near[link[at]]


Block = tuple[str, list[tuple[str | None, str | None]]]


class Matcher:
    """One block of items, ready to find its windows in batches of texts."""

    @classmethod
    def of(cls, block: Block, window: int) -> Matcher:
        """The block's matcher, which a worker builds once and keeps until it sees another block."""
        return kept(("matcher", block[0], window), lambda: cls(block[1], window))

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        split = [(name, _WORD.findall((text or "").encode().lower())) for name, text in items]
        ids: dict[bytes, int] = {}
        self.automaton = SuffixAutomaton([(name, [ids.setdefault(w, len(ids)) for w in words]) for name, words in split], window)
        vocabulary = list(ids)
        lengths = np.array([len(w) for w in vocabulary], np.int64)
        data = np.frombuffer(b"".join(vocabulary), np.uint8)
        ends = np.cumsum(lengths)
        hashes = K.word_hashes(data, ends - lengths, ends)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        # A small table by the hash's last bits first: most unknown words end there.
        self.low = np.zeros(1 << 20, bool)
        self.low[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids, -1 for words that no item has."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.hashes):
            maybe = np.flatnonzero(self.low[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            same = self.hashes[at] == hashes[maybe]
            out[maybe[same]] = self.ids[at[same]]
        return out

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | None, set[str], list[tuple[int, int]]]]:
        """(row, words, hit words or None, items, byte spans of hit runs) of each text."""
        starts, ends, pointers = K.word_spans(data, offsets, K.NOT_ALNUM)
        known = self.known(K.word_hashes(data, starts, ends))
        counts = np.diff(pointers)
        row_of = np.repeat(np.arange(len(counts)), counts)
        inside = known >= 0
        first = inside.copy()
        first[1:] &= ~inside[:-1] | (row_of[1:] != row_of[:-1])
        run_starts = np.flatnonzero(first)
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | (row_of[1:] != row_of[:-1])
        run_ends = np.flatnonzero(stop) + 1
        long = run_ends - run_starts >= self.automaton.shortest
        found: dict[int, tuple[np.ndarray, set[str | None]]] = {}
        for a, b in zip(run_starts[long].tolist(), run_ends[long].tolist(), strict=True):
            hit = last = None
            for i, j, names in self.automaton.hits(known[a:b].tolist()):
                if hit is None:
                    r = int(row_of[a])
                    hit, items = found.setdefault(r, (np.zeros(int(counts[r]), bool), set()))
                    shift = a - int(pointers[r])
                hit[shift + i : shift + j] = True
                if names is not last:
                    items.update(names)
                    last = names
        for r in range(len(counts)):
            if r not in found:
                yield r, int(counts[r]), None, set(), []
                continue
            hit, items = found[r]
            p, q = int(pointers[r]), int(pointers[r + 1])
            yield r, int(counts[r]), hit, items - {None}, _runs(hit, starts[p:q] - int(offsets[r]), ends[p:q] - int(offsets[r]))


def _runs(hit: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of the runs of hit words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).reshape(-1, 2)
    return [(int(starts[i]), int(ends[j - 1])) for i, j in edge]


def _blocks(benchmark: DataFrame, words: int) -> Iterator[Block]:
    """Items in blocks of about ``words`` words, each with a name of its own; one is on the driver at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        block.append((row.i, row.t))
        size += len((row.t or "").split()) + 1
        if size >= words:
            yield uuid.uuid4().hex, block
            block, size = [], 0
    if block:
        yield uuid.uuid4().hex, block


def _window_hashes(batch: pa.RecordBatch, widths: list[int]) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, words of each row, (hashes, row pointers) of each width) of the batch's texts."""
    data, offsets = K.buffers(batch.column("text"))
    for first, _, part, at in K.chunks(data, offsets):
        starts, ends, pointers = K.word_spans(part, at, K.NOT_ALNUM)
        words = K.word_hashes(part, starts, ends)
        yield first, np.diff(pointers), [K.windows(words, pointers, n) for n in widths]


def _slots(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(PROBES):
        yield (K.mix(hashes + np.uint64(k + 1)) & np.uint64(bits - 1)).astype(np.int64)


class WindowFilter:
    """A Bloom filter of all items' windows, built by the cluster."""

    def __init__(self, benchmark: DataFrame, window: int) -> None:
        texts = benchmark.select(F.col("text").cast("string").alias("text"))
        sizes = texts.mapInArrow(self._sizes(window), "width long, n long").groupBy("width").agg(F.sum("n").alias("n")).collect()
        #: How many words windows have: ``window``, and each length of the shorter items.
        self.widths = sorted(r.width for r in sizes)
        wanted = max(64, sum(r.n for r in sizes) * BITS_PER_WINDOW)
        self.bits = min(FILTER_BITS, 1 << int(wanted - 1).bit_length())
        self.words = np.zeros(self.bits // 64, np.int64)
        set_ = texts.mapInArrow(self._set(window, self.bits), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
        self.words[set_.column("at").to_numpy()] = set_.column("bits").to_numpy()

    @staticmethod
    def _sizes(window: int):  # noqa: ANN205
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, counts, _ in _window_hashes(batch, []):
                    full = counts[counts > 0]
                    widths, at = np.unique(np.minimum(full, window), return_inverse=True)
                    n = np.bincount(at, np.maximum(full - window + 1, 1), minlength=len(widths)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(widths), pa.array(n)], names=["width", "n"])

        return run

    @staticmethod
    def _set(window: int, bits: int):  # noqa: ANN205
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, [(hashes, _)] in _window_hashes(batch, [window]):
                    slots = np.unique(np.concatenate([*_slots(hashes, bits), np.zeros(0, np.int64)]))
                    at, starts = np.unique(slots >> 6, return_index=True)
                    own = np.bitwise_or.reduceat(np.uint64(1) << (slots & 63).astype(np.uint64), starts) if len(slots) else np.zeros(0, np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.view(np.int64))], names=["at", "bits"])

        return run

    def sift(self, words: np.ndarray):  # noqa: ANN201
        """Adds how many words a text has and whether a window of it may be an item's."""
        widths, bits = self.widths, self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = words.view(np.uint64)
            for batch in batches:
                counts, suspect = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
                for _, n, found in _window_hashes(batch, widths):
                    own = np.zeros(len(n), bool)
                    for hashes, pointers in found:
                        maybe = np.ones(len(hashes), bool)
                        for at in _slots(hashes, bits):
                            maybe &= ((table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)) != 0
                        sums = np.concatenate([[0], np.cumsum(maybe)])[pointers]
                        own |= sums[1:] > sums[:-1]
                    counts.append(n)
                    suspect.append(own)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(counts)), pa.array(np.concatenate(suspect))], names=[*batch.schema.names, "n_words", "suspect"])

        return run


HITS = "n_words long, n_hit long, items array<string>, starts array<int>, ends array<int>"
_KINDS = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()))


def _with_hits(batch: pa.RecordBatch, kept: list[str], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in _KINDS)
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True))], names=[*kept, "n_words", "n_hit", "items", "starts", "ends"])


def _match(block: Block, window: int, kept: list[str]):  # noqa: ANN202
    """Hits of one block, behind the columns ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher.of(block, window)
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            rows = []
            for _, _, part, at in K.chunks(data, offsets):
                for _, n, hit, names, spans in matcher.rows(part, at):
                    rows.append((n, 0 if hit is None else int(hit.sum()), sorted(names), [s for s, _ in spans], [e for _, e in spans]))
            yield _with_hits(batch, kept, rows)

    return run


def _unite(kept: list[str]):  # noqa: ANN202
    """Hits of all blocks (lists of lists items, starts, ends) as those of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column("text"))
            starts, ends, pointers = K.word_spans(data, offsets, K.NOT_ALNUM)
            lists = {c: batch.column(c).to_pylist() for c in ("items", "starts", "ends")}
            rows = []
            for r in range(batch.num_rows):
                own_s, own_e = starts[pointers[r] : pointers[r + 1]] - offsets[r], ends[pointers[r] : pointers[r + 1]] - offsets[r]
                turns = np.zeros(len(own_s) + 1, np.int64)
                for s, e in zip(sum(lists["starts"][r] or [], []), sum(lists["ends"][r] or [], []), strict=True):
                    turns[np.searchsorted(own_s, s)] += 1
                    turns[np.searchsorted(own_e, e, side="right")] -= 1
                under = np.cumsum(turns)[:-1] > 0
                spans = _runs(under, own_s, own_e)
                rows.append((len(own_s), int(under.sum()), sorted(set(sum(lists["items"][r] or [], []))), [s for s, _ in spans], [e for _, e in spans]))
            yield _with_hits(batch, kept, rows)

    return run


def _sifted(own: DataFrame, first: Block, rest: Iterator[Block], window: int, windows: WindowFilter) -> tuple[DataFrame, DataFrame]:
    """(documents that can't be hit, the others with their hits) for several blocks of items."""
    kind = own.schema.simpleString()[len("struct<") : -1]
    passed = stage(own.withColumn("at", F.monotonically_increasing_id()).mapInArrow(windows.sift(windows.words), f"{kind},at:bigint,n_words:bigint,suspect:boolean"), "sifted")
    suspects = stage(passed.where("suspect").select("at", "text"), "suspects")
    parts = []
    while (block := first) is not None:
        parts.append(stage(suspects.mapInArrow(_match(block, window, ["at"]), f"at long, {HITS}").where("n_hit > 0"), "hits"))
        first = next(rest, None)
    hits = reduce(DataFrame.unionByName, parts).groupBy("at").agg(*(F.collect_list(c).alias(c) for c in ("items", "starts", "ends")))
    united = suspects.join(hits, "at", "left").mapInArrow(_unite(["at"]), f"at long, {HITS}")
    return passed.where("not suspect").drop("suspect"), passed.where("suspect").drop("suspect", "n_words").join(united, "at")


def _found(own: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    """``own`` (row, text) with its hits."""
    bound_arrow(own.sparkSession)
    blocks = _blocks(benchmark, block_words)
    first, second = next(blocks, (uuid.uuid4().hex, [])), next(blocks, None)
    kind = own.schema.simpleString()[len("struct<") : -1]
    if second is None:
        return own.mapInArrow(_match(first, window, ["row", "text"]), f"{kind}, {HITS}")
    more = (block for part in ([second], blocks) for block in part)
    clean, hit = _sifted(own, first, more, window, WindowFilter(benchmark, window))
    none = [F.lit(0).cast("long").alias("n_hit"), *(F.expr(f"cast(array() as array<{t}>)").alias(c) for c, t in (("items", "string"), ("starts", "int"), ("ends", "int")))]
    return clean.select("row", "text", "n_words", *none).unionByName(hit.select("row", "text", "n_words", "n_hit", "items", "starts", "ends"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted), starts and ends (byte spans of runs of hit words) of each row."""
    own = docs.select(F.col("doc_id").cast("long").alias("row"), F.col("text").cast("string").alias("text"))
    return _found(own, benchmark, window, block_words).select(F.col("row").alias("doc_id"), "n_words", "n_hit", "items", "starts", "ends")


def _cut(span_words: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends")), strict=True):
                raw, out, done = (text or "").encode("utf-8", "replace"), [], 0
                for s, e in zip(starts, ends, strict=True):
                    if len(_WORD.findall(raw[s:e].lower())) > span_words:
                        out.append(raw[done:s])
                        done = e
                texts.append(b"".join([*out, raw[done:]]).decode("utf-8", "replace") if done else text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, span_words: int = 0, coverage: float = 0.2, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without documents of which more than ``coverage`` of the words are hit; in the others,
    hit spans of more than ``span_words`` words are cut out of the text. Columns stay as they are.
    """
    others = [c for c in docs.columns if c != "text"]
    own = docs.select((F.struct(*(f"`{c}`" for c in others)) if others else F.lit(0)).alias("row"), F.col("text").cast("string").alias("text"))
    kind = own.schema.simpleString()[len("struct<") : -1]
    kept = _found(own, benchmark, window, block_words).where(F.col("n_hit") <= coverage * F.col("n_words"))
    cut = kept.select("row", "text", "starts", "ends").mapInArrow(_cut(span_words), kind)

    def column(name: str) -> Column:
        return F.col("text").cast(docs.schema["text"].dataType) if name == "text" else F.col(f"row.`{name}`")

    return cut.select(*(column(c).alias(c) for c in docs.columns))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``contamination``."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


#: The contract in SQL, over all windows of whole texts.
ORACLE = r"""
with recursive dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
iw as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
iwin as (select distinct item_id, least(len(ws), 10) as n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') as win
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as i from iw where len(ws) > 0)),
sizes as (select distinct n from iwin),
dwin as (select doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') as win
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from dw, sizes where len(ws) >= n)),
hits as (select doc_id, d.n, i, item_id from dwin d join iwin w on w.n = d.n and w.win = d.win),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by 1),
named as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as names from hits group by 1)
select dw.doc_id, len(ws)::BIGINT as n_words, coalesce(n_hit, 0)::BIGINT as n_hit, coalesce(n_items, 0)::BIGINT as n_items, sha256(coalesce(names, '')) as items_sha256, n_hit is not null as contaminated
from dw left join covered using (doc_id) left join named using (doc_id)
"""
