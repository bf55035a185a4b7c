"""Operator 9: substring dedup by suffix automata of bounded reference shards.

A word goes if a run of ``length`` consecutive words that covers it also stands in a
document with a smaller id.  The reference is every stretch of words that may repeat;
it is dealt to shards, each shard becomes a suffix automaton whose states know the least
id of their occurrences, and the shard's stretches stream through it: the matching
statistics tell for each run whether the automaton holds it under a smaller id.
Such runs are joined into maximal spans and removed.

What keeps this from being every document against every shard:

* documents with equal word sequences count once, under their least id; the others
  lose everything (or, below ``length`` words, nothing);
* a run belongs to its anchor, the leftmost least-hashed ``GRAM``-word gram in it, so equal
  runs have equal anchors, and a run can only repeat where its anchor stands in two different
  texts.  Anchors travel packed by the ten thousand and sorted by value; what repeats
  within a task is settled there, so a very common anchor sends one entry a task;
* the stretch of an anchor is the words of the runs it owns.  Of equal stretches all but those
  of the least id go whole; a task settles that for ``GROUP_STRETCHES`` at a time before the
  exchange, so a very common stretch sends one row for so many;
* stretches are exchanged once, by shard, the shard being that of their anchor.  An anchor with
  more than ``HOT`` stretches left is dealt run by run, settled likewise.

A shard has about ``SHARD_ROWS`` stretches, whatever the size of the table. An automaton that would pass ``PART_WORDS``
is cut into parts, and a task holds automata of about ``GROUP_BYTES`` side by side, so the bounds hold on any data. All
work is one round of linear stages; there are no passes of the driver.

Null text has no words.  A null id comes after all ids: its runs are removed where
any document with an id holds them, and it removes nothing.  Texts are told apart by their word
sequence (two 64-bit digests) and not by id, so several null ids, or an id with several texts,
don't mix: each text of an id is judged by itself against smaller ids.  Rows that repeat an
id with the same text are judged alike; windows are judged on the input.  Other columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import drop, release, stash, table

GRAM = 7
#: Anchors that a task packs at once, and that one bucket of the exchange holds on average.
PACK, BUCKET = 1 << 18, 1 << 18
#: Bytes of automata side by side in a task, and words of reference text in one automaton at most.
GROUP_BYTES, PART_WORDS = 24 << 20, 1 << 16
#: Stretches that a task settles at once, stretches of a shard on average, and shards at least.
GROUP_STRETCHES, SHARD_ROWS, SHARDS = 1 << 16, 256, 32
#: Stretches of an anchor, after the tasks have settled theirs, above which its runs are dealt one by one.
HOT = 512
_LAST = 2**63 - 1
_KNOWN = 0xFFFFFFFF


def _lean(mapper):
    """The mapper; at its end the Python worker gives unused memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from mapper(batches)
        finally:
            for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
                pool.release_unused()

    return run


def _digest(h: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        odd = K.mix64(np.arange(1, len(h) + 1, dtype=np.uint64) * K.U64(K._BASE)) | K.U64(1)
        return tuple(int(K.signed(K.mix64(np.array([np.sum(K.mix64(h ^ K.U64(s)) * odd) + K.U64(len(h))], np.uint64)))[0]) for s in (11, 23))


def _overview(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, t1, t2, n_words, d1, d2 (of the word sequence), kept_sha256 of the whole text."""
    for batch in batches:
        raw, off = K.utf8(batch.column(1))
        view = memoryview(raw)
        n, d1, d2, sha = [], [], [], []
        for a, b in K.slices(off):
            h, first = K.words(raw, off[a : b + 1], False)
            for i in range(b - a):
                x, y = _digest(h[first[i] : first[i + 1]])
                n.append(int(first[i + 1] - first[i]))
                d1.append(x)
                d2.append(y)
                sha.append(hashlib.sha256(b" ".join(bytes(view[off[a + i] : off[a + i + 1]]).split())).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "t1", "t2", "n_words", "d1", "d2", "sha"])


def owners(h: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor hash, anchor position, first and last run) of each anchor; positions count from h[0]."""
    m = len(h) - length + 1
    none = np.zeros(0, np.int64)
    if m <= 0:
        return none, np.zeros(0, np.uint64), none, np.zeros((0, 2), np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    run = np.flatnonzero(row[:m] == row[length - 1 :])
    if not len(run):
        return none, np.zeros(0, np.uint64), none, np.zeros((0, 2), np.int64)
    g = K.windows(h, GRAM)
    span, width = length - GRAM + 1, 1
    at = np.arange(len(g))
    while width < span:  # leftmost least position of each width by doubling
        step = min(width, span - width)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(g[b] < g[a], b, a)
        width += step
    at = at[run]
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    return row[at[new]], g[at[new]], at[new], np.stack([run[new], run[last]], 1)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of the values, byte place by byte place, which compresses better."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


PACKED = "bucket int, texts binary, anchors binary, own binary, pos binary"


def _pack(batches: Iterator[pa.RecordBatch], length: int, buckets: int, pack: int) -> Iterator[pa.RecordBatch]:
    """Anchors of the texts, sorted and packed by bucket.

    Rows of a bucket hold 48-bit anchors, the text of each (an index in ``texts``) and its position.
    An anchor that stands in two texts here is settled: its places go out without anchors, in
    buckets below zero, and its own bucket is told once that it repeats.
    """
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("texts", "anchors", "own", "pos"))])
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        anchor, own, pos = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((pos, own, anchor))
        anchor, own, pos = anchor[order], own[order], pos[order]
        fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1]) | (pos[1:] != pos[:-1])])
        anchor, own, pos = anchor[fresh], own[fresh], pos[fresh]
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        begin = np.flatnonzero(new)
        two = (np.minimum.reduceat(own, begin) != np.maximum.reduceat(own, begin))[np.cumsum(new) - 1]
        texts, index = np.unique(own, return_inverse=True)
        index = index.astype(np.uint64)
        rows = []
        settled = np.flatnonzero(two)
        for a in range(0, len(settled), pack // 16):
            mine = settled[a : a + pack // 16]
            used, at = np.unique(index[mine], return_inverse=True)
            rows.append((-1 - int(anchor[mine[0]] % np.uint64(1 << 30)), texts[used.astype(np.int64)].tobytes(), None, _planes(at.astype(np.uint64), 4), _planes(pos[mine].astype(np.uint64), 4)))
        keep = new | ~two
        told, anchor, index, pos = two[keep], anchor[keep], index[keep], pos[keep]
        bucket = ((anchor >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for a, b in zip(edge[:-1], edge[1:]):
            used, at = np.unique(index[a:b], return_inverse=True)
            at = np.where(told[a:b], np.uint64(_KNOWN), at.astype(np.uint64))
            rows.append((int(bucket[a]), texts[used.astype(np.int64)].tobytes(), _planes(anchor[a:b], 6), _planes(at, 4), _planes(pos[a:b].astype(np.uint64), 4)))
        for a in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[a : a + 64]), schema)], schema=schema)

    size = 0
    for batch in batches:
        raw, off = K.utf8(batch.column(0))
        for a, b in K.slices(off):
            h, first = K.words(raw, off[a : b + 1], False)
            row, g, at, _ = owners(h, first, length)
            if len(g):
                own = np.zeros(b - a, np.int64)
                for i in np.unique(row):
                    own[i] = _digest(h[first[i] : first[i + 1]])[0]
                held.append((g >> np.uint64(16), own[row], at - first[row]))
                size += len(g)
            if size >= pack:
                yield from flush()
                size = 0
    if held:
        yield from flush()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """class (of the text) and place of the anchors that stand in two texts; rows come sorted by bucket."""
    now, held = None, []

    def places(own: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(pos.astype(np.int32))], ["class", "place"])

    def done() -> Iterator[pa.RecordBatch]:
        anchor, own, pos, told = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(anchor, kind="stable")
        anchor, own, pos, told = anchor[order], own[order], pos[order], told[order]
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        begin = np.flatnonzero(new)
        several = np.maximum.reduceat(told, begin) | (np.minimum.reduceat(own, begin) != np.maximum.reduceat(own, begin))
        keep = several[np.cumsum(new) - 1] & ~told
        yield from places(own[keep], pos[keep])

    for batch in batches:
        for r in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
            texts, at, pos = np.frombuffer(r["texts"], np.int64), _unplanes(r["own"], 4), _unplanes(r["pos"], 4)
            told = at == _KNOWN
            own = texts[np.where(told, 0, at).astype(np.int64)]
            if r["anchors"] is None:
                yield from places(own, pos)
                continue
            if r["bucket"] != now:
                if held:
                    yield from done()
                now, held = r["bucket"], []
            held.append((_unplanes(r["anchors"], 6), own, pos, told))
    if held:
        yield from done()


class Stretches(NamedTuple):
    """Stretches of texts: key of the text, its doc_id, first word and anchor; words[offset[i]:offset[i + 1]] are its word hashes."""

    key: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    anchor: np.ndarray
    words: np.ndarray
    offset: np.ndarray

    @staticmethod
    def read(batch: pa.RecordBatch) -> Stretches:
        """Rows key, doc_id, start, anchor, words."""
        raw, off = K.utf8(batch.column("words"))
        words = np.frombuffer(raw[int(off[0]) : int(off[-1])].tobytes(), np.uint64)
        return Stretches(*(batch.column(c).to_numpy() for c in ("key", "doc_id", "start", "anchor")), words, (off - off[0]) // 8)

    @staticmethod
    def join(parts: list[Stretches]) -> Stretches:
        size = np.concatenate([np.diff(p.offset) for p in parts])
        return Stretches(*(np.concatenate([p[i] for p in parts]) for i in range(5)), np.concatenate([[0], np.cumsum(size)]))

    def take(self, at: np.ndarray) -> Stretches:
        lo, size = self.offset[at], self.offset[at + 1] - self.offset[at]
        offset = np.concatenate([[0], np.cumsum(size)])
        return Stretches(self.key[at], self.doc[at], self.start[at], self.anchor[at], self.words[np.repeat(lo - offset[:-1], size) + np.arange(offset[-1])], offset)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two digests of each stretch's words, some thousand stretches at a time to keep scratch arrays small."""
        out = np.empty((2, len(self.key)), np.uint64)
        odd = K.constants(int(np.diff(self.offset).max(initial=1)), 303)
        for a in range(0, len(self.key), 4096):
            edge = self.offset[a : a + 4097]
            lo, size, w = edge[:-1] - edge[0], np.diff(edge), self.words[edge[0] : edge[-1]]
            factor = odd[np.arange(len(w)) - np.repeat(lo, size)]
            with np.errstate(over="ignore"):
                for i, t in enumerate((11, 23)):
                    out[i, a : a + 4096] = K.mix64(np.add.reduceat(K.mix64(w ^ K.U64(t)) * factor, lo) + size.astype(np.uint64))
        return out[0], out[1]

    def settled(self) -> tuple[np.ndarray, np.ndarray]:
        """Which stretches have the least id of their equals here, and which a greater one, both in order."""
        c, d = self.digests()
        order = np.lexsort((self.doc, d, c))
        c, d, doc = c[order], d[order], self.doc[order]
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
        more = doc > doc[np.flatnonzero(new)[np.cumsum(new) - 1]]
        return np.sort(order[~more]), np.sort(order[more])


def _spans(key: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(keys, maximal spans of each) of ranges of words, whose ends grow with their begins."""
    order = np.lexsort((begin, key))
    key, begin, end = key[order], begin[order], end[order]
    head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (begin[1:] > end[:-1])]))
    tail = np.concatenate([head[1:], [len(key)]]) - 1
    spans = np.stack([begin[head], end[tail]], 1).astype(np.int32).ravel()
    owner = key[head]
    edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
    return owner[edge[:-1]], pa.ListArray.from_arrays(pa.array((2 * edge).astype(np.int32)), pa.array(spans))


STRETCHES = "shard long, key long, doc_id long, start int, anchor long, words binary, spans array<int>"
_ROWS = pa.schema([*((c, pa.int64()) for c in ("shard", "key", "doc_id")), ("start", pa.int32()), ("anchor", pa.int64()), ("words", pa.binary()), ("spans", pa.list_(pa.int32()))])


def _settle(x: Stretches, shard) -> Iterator[pa.RecordBatch]:
    """Rows of the stretches that are to be matched, each with its shard, and of the spans of those that go whole."""
    least, more = x.settled()
    gone, x = x.take(more), x.take(least)
    if len(gone.key):
        key, spans = _spans(gone.key, gone.start.astype(np.int64), gone.start + np.diff(gone.offset))
        none = [pa.nulls(len(key), f.type) for f in _ROWS]
        none[0], none[1], none[6] = pa.array(K.signed(K.mix64(key.view(np.uint64)))), pa.array(key), spans
        yield pa.RecordBatch.from_arrays(none, schema=_ROWS)
    words = pa.Array.from_buffers(pa.binary(), len(x.key), [None, pa.py_buffer((x.offset * 8).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(x.words).tobytes())])
    columns = [pa.array(shard(x)), pa.array(x.key), pa.array(x.doc), pa.array(x.start.astype(np.int32)), pa.array(x.anchor), words, pa.nulls(len(x.key), _ROWS[6].type)]
    whole = pa.RecordBatch.from_arrays(columns, schema=_ROWS)
    for at in range(0, whole.num_rows, 8192):
        yield whole.slice(at, 8192)


def _settle_all(parts: Iterator[Stretches], shard) -> Iterator[pa.RecordBatch]:
    """_settle for GROUP_STRETCHES of the parts' stretches at a time."""
    held, n = [], 0
    for x in parts:
        held.append(x)
        n += len(x.key)
        if n >= GROUP_STRETCHES:
            yield from _settle(Stretches.join(held), shard)
            held, n = [], 0
    if held:
        yield from _settle(Stretches.join(held), shard)


def _stretches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[Stretches]:
    """The stretch of each listed anchor; columns are doc_id, text, key, places."""
    for batch in batches:
        raw, off = K.utf8(batch.column(1))
        doc, key, listed = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
        for a, b in K.slices(off):
            h, first = K.words(raw, off[a : b + 1], False)
            row, g, at, run = owners(h, first, length)
            mine = listed.slice(a, b - a)
            want = mine.flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(b - a), np.diff(mine.offsets.to_numpy()))
            hot = np.isin(row * (1 << 40) + at - first[row], owner * (1 << 40) + want)
            row, g, lo, size = row[hot], g[hot], run[hot, 0], run[hot, 1] - run[hot, 0] + length
            if len(row):
                offset = np.concatenate([[0], np.cumsum(size)])
                yield Stretches(key[row + a], doc[row + a], lo - first[row], K.signed(g), h[np.repeat(lo - offset[:-1], size) + np.arange(offset[-1])], offset)


def _runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[Stretches]:
    """Stretches run by run."""
    for batch in batches:
        whole = Stretches.read(batch)
        step = max(1, GROUP_STRETCHES // 32)
        for a in range(0, len(whole.key), step):
            x = whole.take(np.arange(a, min(a + step, len(whole.key))))
            n = np.diff(x.offset) - length + 1
            at = np.repeat(np.arange(len(n)), n)
            begin = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            lo = x.offset[:-1][at] + begin
            yield Stretches(x.key[at], x.doc[at], x.start[at] + begin, x.anchor[at], x.words[(lo[:, None] + np.arange(length)).ravel()], np.arange(len(at) + 1) * length)


class Automaton(NamedTuple):
    """A suffix automaton over word hashes in flat arrays; state 0 is its root.

    word and to are a state's first transition (to is -1 without one), the fan holds the others;
    least is the least id of a state's occurrences.
    """

    word: np.ndarray
    to: np.ndarray
    link: np.ndarray
    length: np.ndarray
    least: np.ndarray
    fan_state: np.ndarray
    fan_word: np.ndarray
    fan_to: np.ndarray

    @staticmethod
    def build(texts: list[np.ndarray], ids: list[int]) -> Automaton:
        vocabulary, coded = np.unique(np.concatenate(texts), return_inverse=True)
        sym, to, link, length, least = [-1], [-1], [-1], [0], [_LAST]
        fan: dict[int, dict[int, int]] = {}

        def clone(p: int, c: int, q: int) -> int:
            new = len(to)
            sym.append(sym[q])
            to.append(to[q])
            if q in fan:
                fan[new] = dict(fan[q])
            link.append(link[q])
            length.append(length[p] + 1)
            least.append(_LAST)
            link[q] = new
            while p != -1:
                if sym[p] == c:
                    if to[p] != q:
                        break
                    to[p] = new
                else:
                    f = fan.get(p)
                    if f is None or f.get(c) != q:
                        break
                    f[c] = new
                p = link[p]
            return new

        at = 0
        for text, doc in zip(texts, ids):
            last = 0
            for c in coded[at : at + len(text)].tolist():
                f = fan.get(last)
                q = to[last] if sym[last] == c else f.get(c, -1) if f else -1
                if q >= 0:
                    last = q if length[q] == length[last] + 1 else clone(last, c, q)
                    if doc < least[last]:
                        least[last] = doc
                    continue
                cur, p = len(to), last
                sym.append(-1)
                to.append(-1)
                link.append(0)
                length.append(length[last] + 1)
                least.append(doc)
                while p != -1:
                    if sym[p] == c:
                        q = to[p]
                        break
                    f = fan.get(p)
                    if f is not None and c in f:
                        q = f[c]
                        break
                    if sym[p] < 0:
                        sym[p], to[p] = c, cur
                    elif f is None:
                        fan[p] = {c: cur}
                    else:
                        f[c] = cur
                    p = link[p]
                if p != -1:
                    link[cur] = q if length[q] == length[p] + 1 else clone(p, c, q)
                last = cur
            at += len(text)
        depth, up, low = np.array(length, np.int32), np.array(link, np.int32), np.array(least, np.int64)
        order = np.argsort(-depth, kind="stable")
        for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
            if depth[level[0]]:
                np.minimum.at(low, up[level], low[level])
        code = np.array(sym, np.int64)
        edges = [(s, c, t) for s, f in fan.items() for c, t in f.items()]
        fan_state, fan_code, fan_to = (np.array(x, np.int32) for x in zip(*edges)) if edges else (np.zeros(0, np.int32),) * 3
        return Automaton(vocabulary[np.maximum(code, 0)], np.array(to, np.int32), up, depth, low, fan_state, vocabulary[fan_code], fan_to)


def _edge(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return K.mix64(word ^ K.mix64(state.astype(np.uint64) + K.U64(K._BASE)))


class Shards:
    """Automata side by side in one space of states, through which many texts stream at once."""

    def __init__(self, parts: list[Automaton]):
        size = np.array([len(p.to) for p in parts])
        self.roots = np.concatenate([[0], np.cumsum(size)])[:-1]
        moved = lambda field: np.concatenate([np.where(getattr(p, field) < 0, -1, getattr(p, field) + r).astype(np.int32) for p, r in zip(parts, self.roots)])
        self.word, self.length, self.least = (np.concatenate([getattr(p, c) for p in parts]) for c in ("word", "length", "least"))
        self.to, self.link = moved("to"), moved("link")
        state = np.concatenate([p.fan_state + r for p, r in zip(parts, self.roots)])
        key, target = _edge(state, np.concatenate([p.fan_word for p in parts])), moved("fan_to")
        order = np.argsort(key)
        self.key, self.target = key[order], target[order]

    def _step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.where(self.word[state] == word, self.to[state], -1)
        miss = np.flatnonzero(out < 0)
        if len(miss) and len(self.key):
            key = _edge(state[miss], word[miss])
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            out[miss] = np.where(self.key[at] == key, self.target[at], -1)
        return out

    def holders(self, root: np.ndarray, words: np.ndarray, offset: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(least id that holds each run, or _LAST; first run of each text), text i streaming from root[i].

        Matching statistics: after each word the longest suffix that the automaton holds; states
        are kept at the shortest one of at least length words, which is all a later run needs.
        """
        size = np.diff(offset)
        first = np.concatenate([[0], np.cumsum(np.maximum(0, size - length + 1))])
        out = np.full(first[-1], _LAST, np.int64)
        state, match = root.astype(np.int64), np.zeros(len(root), np.int64)
        for i in range(int(size.max(initial=0))):
            live = np.flatnonzero(size > i)
            c, s, m = words[offset[live] + i], state[live], match[live]
            todo = np.arange(len(live))
            while len(todo):
                t = self._step(s[todo], c[todo])
                ok = t >= 0
                s[todo[ok]] = t[ok]
                m[todo[ok]] += 1
                todo = todo[~ok]
                up = self.link[s[todo]]
                m[todo] = np.where(up < 0, 0, self.length[up])
                todo, up = todo[up >= 0], up[up >= 0]
                s[todo] = up
            while True:
                up = self.link[s]
                high = (up >= 0) & (self.length[up] >= length)
                if not high.any():
                    break
                s = np.where(high, up, s)
                m = np.where(high, self.length[s], m)
            state[live], match[live] = s, m
            if i + 1 >= length:
                out[first[live] + i + 1 - length] = np.where(m >= length, self.least[s], _LAST)
        return out, first


def _automata(shard: np.ndarray, x: Stretches) -> tuple[np.ndarray, list[Automaton]]:
    """(shard, automaton) of each part of at most PART_WORDS words; x comes sorted by shard."""
    of, parts, texts, ids, n = [], [], [], [], 0
    c, d = x.digests()
    seen: set[tuple[int, int]] = set()
    for i, equal in enumerate(zip(c.tolist(), d.tolist())):
        new = i == 0 or shard[i] != shard[i - 1]
        size = int(x.offset[i + 1] - x.offset[i])
        if texts and (new or n + size > PART_WORDS):
            of.append(shard[i - 1])
            parts.append(Automaton.build(texts, ids))
            texts, ids, n = [], [], 0
        seen = set() if new else seen
        if equal not in seen:
            seen.add(equal)
            texts.append(x.words[x.offset[i] : x.offset[i + 1]])
            ids.append(int(x.doc[i]))
            n += size
    if texts:
        of.append(shard[-1])
        parts.append(Automaton.build(texts, ids))
    return np.array(of, np.int64), parts


def _rounds(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of the automata, in order, whose bytes stay within GROUP_BYTES; one alone may pass it."""
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if i > at and total + size > GROUP_BYTES:
            yield at, i
            at, total = i, 0
        total += size
    if len(sizes) > at:
        yield at, len(sizes)


def _stream(shard: np.ndarray, x: Stretches, length: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Keys and spans of the runs that the automata of the stretches' shards hold under a smaller id than theirs."""
    of, parts = _automata(shard, x)
    for a, b in _rounds([sum(f.nbytes for f in p) for p in parts]):
        shards, mine = Shards(parts[a:b]), of[a:b]
        nth = np.arange(len(mine)) - np.searchsorted(mine, mine)
        for k in range(int(nth.max()) + 1):  # the k-th part of each shard
            root = shards.roots[nth == k]
            had = mine[nth == k]
            i = np.minimum(np.searchsorted(had, shard), len(had) - 1)
            at = np.flatnonzero(had[i] == shard)
            y = x.take(at)
            hold, first = shards.holders(root[i[at]], y.words, y.offset, length)
            own = np.repeat(np.arange(len(at)), np.diff(first))
            begin = y.start[own].astype(np.int64) + np.arange(first[-1]) - first[own]
            gone = hold < y.doc[own]
            if gone.any():
                yield _spans(y.key[own[gone]], begin[gone], begin[gone] + length)


def _match(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """key and spans to remove, of rows as of _settle, which come sorted by shard."""
    schema = pa.schema([_ROWS.field("key"), _ROWS.field("spans")])
    held: list[tuple[np.ndarray, Stretches]] = []
    n = least = 0

    def settle() -> Iterator[pa.RecordBatch]:
        """Keep of the held shards' equal stretches those of the least id."""
        shard, x = np.concatenate([h[0] for h in held]), Stretches.join([h[1] for h in held])
        held.clear()
        rest, more = x.settled()
        held.append((shard[rest], x.take(rest)))
        more = x.take(more)
        if len(more.key):
            yield pa.RecordBatch.from_arrays(list(_spans(more.key, more.start.astype(np.int64), more.start + np.diff(more.offset))), schema=schema)

    def done() -> Iterator[pa.RecordBatch]:
        yield from settle()
        shard, x = np.concatenate([h[0] for h in held]), Stretches.join([h[1] for h in held])
        held.clear()
        for key, spans in _stream(shard, x, length):
            yield pa.RecordBatch.from_arrays([pa.array(key), spans], schema=schema)

    for batch in batches:
        whole = batch.column("words").is_null()
        settled = batch.filter(whole)
        if settled.num_rows:
            yield settled.select(["key", "spans"])
        batch = batch.filter(pc.invert(whole))
        if not batch.num_rows:
            continue
        shard, x = batch.column("shard").to_numpy(), Stretches.read(batch)
        edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
        for a, b in zip(edge[:-1], edge[1:]):
            if held and held[-1][0][-1] != shard[a] and n >= GROUP_STRETCHES // 4:
                yield from done()
                n = least = 0
            held.append((shard[a:b], x.take(np.arange(a, b))))
            n += int(b - a)
            if n >= GROUP_STRETCHES + 2 * least:  # a shard of many copies
                yield from settle()
                n = least = sum(len(h[0]) for h in held)
    if held:
        yield from done()


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, number of removed words and digest of the kept ones, from text and spans (begin, end, begin, end ...)."""
    for batch in batches:
        n, sha = [], []
        for text, spans in zip(batch.column(1), batch.column(2)):
            words = (text.as_py() or "").encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            ends = spans.values.to_numpy()
            np.add.at(gone, ends[::2], 1)
            np.add.at(gone, ends[1::2], -1)
            keep = np.cumsum(gone)[:-1] == 0
            n.append(int(len(words) - keep.sum()))
            sha.append(hashlib.sha256(b" ".join(w for w, k in zip(words, keep) if k)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["key", "removed", "kept"])


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id (null last), text, t1, t2: the hashes tell apart the texts of one id."""
    return docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))


def _held(stretches: DataFrame, length: int) -> DataFrame:
    """key and spans to remove, of rows as of _settle."""
    spark = stretches.sparkSession
    todo = stretches.where("words is not null")
    rows = todo.count()
    shards = max(SHARDS, rows // SHARD_ROWS)
    hot = stash(todo.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(f"n > {HOT}").select("anchor"), "hot-anchors")
    columns = ["key", "doc_id", "start", "anchor", "words"]
    by_anchor = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    cold, some = todo, not hot.isEmpty()
    if some:
        cold = todo.join(hot, "anchor", "left_anti")
    dealt = cold.select(by_anchor, *columns, "spans")
    if some:
        by_run = lambda x: (x.digests()[0] % np.uint64(shards)).astype(np.int64)
        runs = todo.join(hot, "anchor", "left_semi").select(columns).mapInArrow(_lean(lambda it: _settle_all(_runs(it, length), by_run)), STRETCHES)
        dealt = dealt.unionByName(runs.select("shard", *columns, "spans"))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard")
    matched = dealt.mapInArrow(_lean(lambda it: _match(it, length)), "key long, spans array<int>")
    return matched.unionByName(stretches.where("words is null").select("key", "spans"))


def substring_spans(docs: DataFrame, length: int = 13) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(overview, reps, spans): overview of every row with key, of its word sequence, and rep, the least id of it;
    reps(doc_id, t1, t2, key): a text of each key under its least id;
    spans(key, spans): begin and end of each span of words of the key's text to remove."""
    spark, d = docs.sparkSession, _texts(docs)
    seen = stash(d.mapInArrow(_lean(_overview), "doc_id long, t1 long, t2 long, n_words long, d1 long, d2 long, sha string"), "overview")
    least = seen.where(f"n_words >= {length}").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("at"))
    reps = stash(least.select("d1", "d2", "at.*", F.monotonically_increasing_id().alias("key")), "reps")

    n_words = seen.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(8, -(-2 * n_words // ((length - GRAM + 2) * BUCKET)))
    pack = PACK
    packed = d.select("text").mapInArrow(_lean(lambda it: _pack(it, length, buckets, pack)), PACKED)
    places = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_lean(_repeated), "class long, place int")
    places = places.groupBy("class").agg(F.collect_list("place").alias("places"))
    spots = stash(places.join(reps.withColumnRenamed("d1", "class"), "class").select("doc_id", "t1", "t2", "key", "places"), "places")
    release(spark)

    near = d.join(spots, ["doc_id", "t1", "t2"]).select("doc_id", "text", "key", "places")
    by_key = lambda x: np.zeros(len(x.key), np.int64)
    stretches = stash(near.mapInArrow(_lean(lambda it: _settle_all(_stretches(it, length), by_key)), STRETCHES), "stretches")
    release(spark)
    found = stash(_held(stretches, length), "spans")
    drop(stretches)
    release(spark)
    found = found.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    overview = seen.drop("t1", "t2").join(reps.select("d1", "d2", "key", F.col("doc_id").alias("rep")), ["d1", "d2"], "left")
    return overview, reps.select("doc_id", "t1", "t2", "key"), found


def dedup_substrings(docs: DataFrame, length: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs."""
    seen, reps, spans = substring_spans(docs, length)
    cut = _texts(docs).join(spans.join(reps, "key"), ["doc_id", "t1", "t2"]).select("key", "text", "spans").mapInArrow(_lean(_removed), "key long, removed long, kept string")
    cut = cut.groupBy("key").agg(F.first("removed").alias("removed"), F.first("kept").alias("kept"))
    copy = F.col("rep").isNotNull() & (F.col("rep") != F.col("doc_id"))
    out = seen.join(cut, "key", "left")
    return out.select(
        F.when(F.col("doc_id") != _LAST, F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS r FROM g),
m AS (SELECT r, min(doc_id) AS least FROM x GROUP BY r),
s AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM x JOIN m USING (r) WHERE least < doc_id),
l AS (SELECT doc_id, list(p) AS p FROM s GROUP BY doc_id),
k AS (SELECT w.doc_id, len(w) AS n, CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(p, j)) END AS k FROM w LEFT JOIN l USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(k) AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM k
"""
