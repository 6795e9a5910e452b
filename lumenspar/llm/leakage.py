"""Evaluation passages that leak into a training corpus.

Latent semantic retrieval. Texts are read once into hashed words. Documents are cut into windows of 2 * run words every run
words, so any run of `run` words lies wholly in some window; test passages into windows of 1.5 * run words every run / 2.
Windows are TF-IDF vectors over hashed words, with document frequencies counted over the whole corpus. A distributed
randomised SVD gives the latent space: each partition adds its share of A'(A Omega) for a random Omega, the shares are
summed in Spark, and the orthonormal basis of the sum is the basis (one power step; both A Omega and the sum have vocabulary
x rank numbers, whatever the corpus).

Candidate search: the latent windows of the test passages are put into cells around centroids; a document window is
compared with the windows in the `probes` cells nearest to it, and pairs above a cosine are candidates. The test set is a
stated query set, worked in blocks of `block_items` items, so a block's index has a bounded size whatever the set.

Candidates are checked: for verbatim leaks that `run` words in a row are the same, for paraphrases the longest common
subsequence and whether the answer is there.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspar.operators.arrowgroups import map_groups
from lumenspar.session import cut

_BREAK = re.compile(r"</?(?:br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|hr|pre|blockquote)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_LINK = re.compile(r"\]\([^()\s]*\)")
_INLINE = re.compile(r"[*`~]+|(?<!\w)_+|_+(?!\w)")
_WORD = re.compile(r"[^\W_]+")
DIM = 1 << 13


class _Marks(dict):
    """Code point -> itself, or None for accents and invisible characters; filled as they come."""

    def __missing__(self, c: int) -> int | None:
        self[c] = c if c < 128 or unicodedata.category(chr(c)) not in ("Mn", "Me", "Cf", "Cc", "Cs", "Co") else None
        return self[c]


_SEEN = _Marks()


def words(text: str) -> list[str]:
    """Words of a text for comparison: letters and digits only; no case, accents, markup or invisible characters."""
    if "<" in text:
        text = _TAG.sub("", _BREAK.sub(" ", text))
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _LINK.sub("]", text)
    if "*" in text or "`" in text or "_" in text or "~" in text:
        text = _INLINE.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_SEEN)
    return _WORD.findall(text.casefold())


def spans(n: int, size: int, step: int) -> list[tuple[int, int]]:
    """Windows over n words: every `step`, the last one reaching the end."""
    return [(a, min(n, a + size)) for a in range(0, max(1, n - size + step), step)] if n else []


def hashed(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., w): the words of each text as 32-bit hashes, in order; texts without words are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, int] = {}
        for b in batches:
            if len(of) > 1_000_000:
                of.clear()
            flat, ends, rows = [], [0], []
            for i, x in enumerate(b.column(b.num_columns - 1).to_pylist()):
                got = words(x)
                for w in got:
                    h = of.get(w)
                    if h is None:
                        h = of[w] = zlib.crc32(w.encode()) - (1 << 31)
                    flat.append(h)
                if got:
                    rows.append(i)
                    ends.append(len(flat))
            at = pa.array(rows, pa.int64())
            w = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.record_batch([*(b.column(j).take(at) for j in range(len(keep))), w], names=[*keep, "w"])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, F.col(text).alias("x")).where("x is not null and x <> ''").mapInArrow(run, f"{schema}w array<int>")


def _lists(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first index of each list and the end of the last, all words)."""
    off = a.offsets.to_numpy()
    return off - off[0], a.values.to_numpy()[off[0] : off[-1]]


def _blocks(off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, list, number within the list) of the blocks of `size` words of each list; the last may be shorter."""
    many = -(-np.diff(off) // size)
    of = np.repeat(np.arange(len(many)), many)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    return off[of] + nth * size, of, nth


def _dims(w: np.ndarray) -> np.ndarray:
    return w & (DIM - 1)


def _sums(table: np.ndarray, dims: np.ndarray, first: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """Sum of table's rows over the words of each block, a bounded number of blocks at a time."""
    out = np.empty((len(first), table.shape[1]), np.float32)
    ends = np.append(first[1:], len(dims))
    for a in range(0, len(first), chunk):
        b = min(a + chunk, len(first))
        out[a:b] = np.add.reduceat(table[dims[first[a] : ends[b - 1]]], first[a:b] - first[a], axis=0)
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers (sorting beats np.unique's hashing at these sizes)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def frequencies(hashes: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Windows of `size` words that hold each hashed dimension, and the number of windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, c = 0, np.zeros(DIM, np.int64)
        for b in batches:
            off, w = _lists(b.column(0))
            if not len(w):
                continue
            first, _, _ = _blocks(off, size)
            n += len(first)
            row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w))))
            c += np.bincount(_distinct(row * DIM + _dims(w)) % DIM, minlength=DIM)
        at = np.flatnonzero(c)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(c[at], n))], names=["dim", "n"])

    count, total = np.zeros(DIM), 0
    for r in hashes.select("w").mapInArrow(run, "dim bigint, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).collect():  # at most DIM + 1 rows
        if r["dim"] < 0:
            total = r["n"]
        else:
            count[r["dim"]] = r["n"]
    return count, total


def covariance(hashes: DataFrame, idf: np.ndarray, omega: np.ndarray, size: int) -> np.ndarray:
    """A'(A omega) of the unit TF-IDF vectors A of all windows of `size` words."""
    rank = omega.shape[1]
    table = omega * idf[:, None]
    kind = "dim bigint, z array<float>"
    pack = lambda at, z: pa.record_batch([pa.array(at), pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), rank).cast(pa.list_(pa.float32()))], names=["dim", "z"])

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.zeros((DIM, rank), np.float32)
        for b in batches:
            off, w = _lists(b.column(0))
            if not len(w):
                continue
            dims = _dims(w)
            first, _, _ = _blocks(off, size)
            many = np.diff(np.append(first, len(w)))
            norm2 = np.maximum(np.add.reduceat(idf[dims] ** 2, first), 1e-12)
            y = _sums(table, dims, first) / norm2[:, None]  # once for the vector, once for its product
            order = np.argsort(dims.astype(np.int16), kind="stable")  # a radix sort
            row, ds = np.repeat(np.arange(len(first)), many)[order], dims[order]
            for a in range(0, len(ds), 100_000):  # words at a time
                d, r = ds[a : a + 100_000], row[a : a + 100_000]
                at = np.flatnonzero(np.diff(d, prepend=-1))
                z[d[at]] += np.add.reduceat(y[r], at, axis=0)
        z *= idf[:, None]
        at = np.flatnonzero(np.abs(z).sum(1))
        yield pack(at, z[at])

    def add(tab: pa.Table, start: np.ndarray) -> pa.RecordBatch:
        z = tab.column("z").combine_chunks()
        rows = (z.chunk(0) if isinstance(z, pa.ChunkedArray) else z).flatten().to_numpy().reshape(-1, rank)
        return pack(tab.column("dim").to_numpy()[start], np.add.reduceat(rows, start, axis=0) if len(start) else rows[:0])

    z = np.zeros((DIM, rank), np.float32)
    for r in map_groups(hashes.select("w").mapInArrow(share, kind), ["dim"], [], kind, add).toLocalIterator():  # at most DIM rows of rank numbers
        z[r["dim"]] = r["z"]
    return z


@dataclass
class ItemBlock:
    """The index of one block of test items: latent windows by cell, and the runs of words of each item."""

    ids: np.ndarray  # of each item
    off: np.ndarray  # first word of each item in `words`
    words: np.ndarray
    window: np.ndarray  # (item, first word, end) of each window, by cell
    vectors: np.ndarray
    cells: np.ndarray  # centroids
    bounds: np.ndarray  # first window of each cell and the end
    grams: np.ndarray  # sorted hashes of the runs of `run` words
    gram_at: np.ndarray  # (item, first word) of each
    answers: list[set[int] | None]

    @classmethod
    def build(cls, rows: list[tuple[int, np.ndarray, set[int] | None]], table: np.ndarray, run: int, rounds: int = 8) -> ItemBlock:
        rank = table.shape[1]
        ids = np.array([i for i, _, _ in rows], np.int64)
        off = np.concatenate([[0], np.cumsum([len(w) for _, w, _ in rows])]).astype(np.int64)
        flat = np.concatenate([w for _, w, _ in rows]) if rows else np.zeros(0, np.int32)
        win = np.array([(i, off[i] + a, off[i] + b) for i in range(len(rows)) for a, b in spans(int(off[i + 1] - off[i]), run * 3 // 2, max(1, run // 2))], np.int64).reshape(-1, 3)
        vec = _unit(np.stack([table[_dims(flat[a:b])].sum(0) for _, a, b in win])) if len(win) else np.zeros((0, rank), np.float32)
        many = max(1, len(win) // 48)
        cells = vec[np.linspace(0, len(vec) - 1, many).astype(int)] if len(vec) else np.zeros((1, rank), np.float32)
        near = np.zeros(len(vec), np.int64)
        for _ in range(rounds):  # spherical k-means
            near = np.argmax(vec @ cells.T, axis=1) if len(vec) else near
            sums = np.zeros_like(cells)
            np.add.at(sums, near, vec)
            cells = np.where(np.abs(sums).sum(1, keepdims=True) > 0, _unit(sums), cells).astype(np.float32)
        order = np.argsort(near, kind="stable")
        start = np.concatenate([off[i] + np.arange(max(0, off[i + 1] - off[i] - run + 1)) for i in range(len(rows))]) if rows else np.zeros(0, np.int64)
        item = np.repeat(np.arange(len(rows)), np.maximum(0, np.diff(off) - run + 1))
        h = rolling(flat, run)[start.astype(np.int64)] if len(start) else np.zeros(0, np.uint64)
        by = np.argsort(h, kind="stable")
        return cls(ids, off, flat, win[order], vec[order], cells, np.searchsorted(near[order], np.arange(many + 1)), h[by], np.stack([item, start], 1)[by].astype(np.int64), [a for _, _, a in rows])


def rolling(w: np.ndarray, run: int) -> np.ndarray:
    """A 64-bit hash of the `run` words from each position on (those that reach past the end are of no use)."""
    x = np.concatenate([w, np.zeros(run, w.dtype)]).astype(np.int64).view(np.uint64)
    h = np.zeros(len(w), np.uint64)
    for j in range(run):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[j : j + len(w)]
    return h


@dataclass
class LeakFinder:
    """A fitted latent space and the indexes of the test items, block by block."""

    table: np.ndarray  # latent vector of each hashed dimension, weighted by its idf
    blocks: list[ItemBlock]
    run: int
    cosine: float
    probes: int

    @classmethod
    def fit(cls, hashes: DataFrame, items: DataFrame, item_id: str = "item_id", passage: str = "passage", answer: str = "answer", run: int = 12, rank: int = 48, cosine: float = 0.5, probes: int = 8, block_items: int = 2000, seed: int = 7) -> LeakFinder:
        """hashes: hashed() documents, of any number. items: the stated query set; null passages are no items, and one id
        may have several passages."""
        iw = cut(hashed(items.where(F.col(item_id).isNotNull()).select(item_id, answer, passage).distinct(), passage, item_id, answer), "items")
        count, total = frequencies(hashes, 2 * run)
        idf = np.log((total + 1) / (count + 1)).clip(0.1, 6).astype(np.float32)
        omega = np.random.default_rng(seed).standard_normal((DIM, rank)).astype(np.float32)
        z, zi = covariance(hashes, idf, omega, 2 * run), covariance(iw, idf, omega, run * 3 // 2)
        # the items weigh as much as the corpus, so their words are never lost among it
        z += zi * max(1.0, float(np.abs(z).sum() / max(np.abs(zi).sum(), 1e-12)))
        table = (np.linalg.qr(z)[0] if np.abs(z).sum() else z).astype(np.float32) * idf[:, None]
        parts = max(1, -(-iw.count() // block_items))
        part = F.pmod(F.xxhash64(item_id), F.lit(parts))
        blocks = []
        for p in range(parts):
            got = iw.where(part == p).collect()  # about block_items rows
            rows = [(r[item_id], np.array(r["w"], np.int32), {zlib.crc32(x.encode()) - (1 << 31) for x in words(r[answer])} if r[answer] and len(r[answer]) > 1 else None) for r in got]
            blocks.append(ItemBlock.build(sorted(rows, key=lambda r: (r[0], r[1].tolist())), table, run))
        return cls(table, blocks, run, cosine, probes)

    def _windows(self, off: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, end, latent vector) of the windows of a batch."""
        first, of, nth = _blocks(off, self.run)
        block = _sums(self.table, _dims(w), first)
        lone = np.diff(np.append(of, -1)) != 0  # a document's last block
        begin = ~lone | (nth == 0)
        both = np.flatnonzero(begin & ~lone)
        vec = block.copy()
        vec[both] += block[both + 1]
        at = np.flatnonzero(begin)
        return of[at], first[at], np.minimum(first[at] + 2 * self.run, off[of[at] + 1]), _unit(vec[at])

    def _candidates(self, block: ItemBlock, vec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document window, item window, cosine) of the pairs above the cosine in the nearest cells."""
        probes = min(self.probes, len(block.cells))
        out = []
        for a in range(0, len(vec), 16_384):
            v = vec[a : a + 16_384]
            near = np.argpartition(-(v @ block.cells.T), probes - 1, axis=1)[:, :probes]
            row, cell = np.repeat(np.arange(len(v)), probes), near.ravel()
            order = np.argsort(cell.astype(np.uint16) if len(block.cells) < 1 << 16 else cell, kind="stable")
            row, at = row[order], np.searchsorted(cell[order], np.arange(len(block.cells) + 1))
            for c in range(len(block.cells)):
                lo, hi = block.bounds[c], block.bounds[c + 1]
                rows = row[at[c] : at[c + 1]]
                if hi > lo and len(rows):
                    cos = v[rows] @ block.vectors[lo:hi].T
                    i, j = np.nonzero(cos >= self.cosine)
                    if len(i):
                        out.append((a + rows[i], lo + j, cos[i, j]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))

    def _same_runs(self, block: ItemBlock, w: np.ndarray, h: np.ndarray, first: np.ndarray, end: np.ndarray, win: np.ndarray, item: np.ndarray) -> np.ndarray:
        """(document window, item) of the candidates that share `run` words in a row, as pairs of indexes."""
        live = np.zeros(len(first), bool)
        live[win] = True
        u = np.flatnonzero(live)
        at = first[u][:, None] + np.arange(self.run + 1)
        ok = at + self.run <= end[u][:, None]
        pos, owner = at[ok], np.repeat(u, ok.sum(1))
        lo, hi = np.searchsorted(block.grams, h[pos], "left"), np.searchsorted(block.grams, h[pos], "right")
        hit = np.flatnonzero(hi > lo)
        many = (hi - lo)[hit]
        g = np.repeat(lo[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pos, owner = np.repeat(pos[hit], many), np.repeat(owner[hit], many)
        step = np.arange(self.run)
        same = (w[pos[:, None] + step] == block.words[block.gram_at[g, 1][:, None] + step]).all(1) if len(g) else np.zeros(0, bool)
        n = len(block.ids)
        key = _distinct(owner[same] * n + block.gram_at[g[same], 0])
        live[:] = False
        live[key // n] = True
        near = live[win]  # the candidates of windows with such runs, a small part
        asked = _distinct(win[near] * n + item[near])
        key = key[asked[np.searchsorted(asked, key).clip(max=len(asked) - 1)] == key] if len(asked) else key[:0]
        return np.stack([key // n, key % n], 1)

    def _each(self, hashes: DataFrame, doc_id: str, schema: str, fn: Callable) -> DataFrame:
        """fn(block, hashed words, window documents, firsts, ends, candidates) -> columns, over all documents and blocks."""
        kind = hashes.schema[doc_id].dataType.simpleString()

        def over(block: ItemBlock) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    off, w = _lists(b.column(1))
                    if not len(w):
                        continue
                    doc, first, end, vec = self._windows(off, w)
                    rows, cols = fn(self, block, w, doc, first, end, self._candidates(block, vec))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *cols], names=["k", *(x.split()[0] for x in schema.split(", "))])

            return hashes.select(doc_id, "w").mapInArrow(run, f"k {kind}, {schema}")

        return reduce(DataFrame.unionByName, map(over, self.blocks)).withColumnRenamed("k", doc_id)

    def verbatim(self, hashes: DataFrame, doc_id: str = "doc_id") -> DataFrame:
        """(doc_id, item_id) of candidates that share `run` consecutive words."""
        def check(self: LeakFinder, block: ItemBlock, w: np.ndarray, doc: np.ndarray, first: np.ndarray, end: np.ndarray, cand: tuple) -> tuple:
            got = self._same_runs(block, w, rolling(w, self.run), first, end, cand[0], block.window[cand[1], 0])
            pairs = np.unique(np.stack([doc[got[:, 0]], block.ids[got[:, 1]]], 1), axis=0)
            return pairs[:, 0], [pa.array(pairs[:, 1], pa.int64())]

        return self._each(hashes, doc_id, "item_id bigint", check).distinct()

    def report(self, hashes: DataFrame, doc_id: str = "doc_id", similar: float = 0.8, common: float = 0.8) -> DataFrame:
        """(doc_id, item_id, cosine, lcs, longest_run, answer): the best window pair of each document and item whose
        cosine is at least `similar` and whose longest common subsequence covers `common` of the item window, or which
        share `run` words in a row. lcs is that share; answer tells whether all words of the answer (of two letters or
        more) are in the window."""
        schema = "item_id bigint, cosine double, lcs double, longest_run bigint, answer boolean"

        def check(self: LeakFinder, block: ItemBlock, w: np.ndarray, doc: np.ndarray, first: np.ndarray, end: np.ndarray, cand: tuple) -> tuple:
            win, at, cos = cand
            item = block.window[at, 0]
            n = len(block.ids)
            same = self._same_runs(block, w, rolling(w, self.run), first, end, win, item)
            exact = np.isin(win * n + item, same[:, 0] * n + same[:, 1])
            best: dict[tuple[int, int], tuple[float, float, int, bool]] = {}
            for p in np.flatnonzero(exact | (cos >= similar)):
                a, b = w[first[win[p]] : end[win[p]]].tolist(), block.words[block.window[at[p], 1] : block.window[at[p], 2]].tolist()
                share = lcs(a, b) / len(b)
                if share < common and not exact[p]:
                    continue
                ans = block.answers[item[p]]
                row = (share, float(cos[p]), longest_run(a, b), ans is not None and ans <= set(a))
                k = int(doc[win[p]]), int(block.ids[item[p]])
                best[k] = max(best.get(k, (-1.0, 0.0, 0, False)), row)
            keys = sorted(best)
            val = [best[k] for k in keys]
            return [i for i, _ in keys], [pa.array([x for _, x in keys], pa.int64()), pa.array([v[1] for v in val], pa.float64()), pa.array([v[0] for v in val], pa.float64()), pa.array([v[2] for v in val], pa.int64()), pa.array([v[3] for v in val], pa.bool_())]

        return self._each(hashes, doc_id, schema, check)


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence (bit-parallel over a)."""
    at: dict[object, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def longest_run(a: list, b: list) -> int:
    """Length of the longest run of words in both."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                new[j] = row[j - 1] + 1
                best = max(best, new[j])
        row = new
    return best
