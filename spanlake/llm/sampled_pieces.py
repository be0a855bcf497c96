"""Sampled segmentations into sentence pieces by forward filtering and backward sampling over the piece lattice.

No piece crosses a space that follows text, so a text's lattice falls into chunks (spaces and what follows). The forward
sums of each distinct chunk are taken once and kept while there is room; all occurrences are then walked backwards
together, with random numbers that depend only on the row's key, the seed and the position. Decoding gives back every
byte.

The vocabulary is of merges and has ranks, no probabilities: a piece of rank r weighs (r + 1) ** -alpha.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField

from spanlake.llm._common import SpanHasher, add_columns, any_names, binary, mix, pieces, table

SPACE = 0x2581
#: Characters of a chunk up to which chunks are summed side by side; longer ones, one by one. Both keep logarithms.
PLAIN = 256
#: Scales all segmentations of a span alike and keeps the sums near one.
KAPPA = 2.5
SLICE = 1 << 19
_BASE = 0x5851F42D4C957F2D * 8 + 5 & (1 << 64) - 1
_BACK = pow(_BASE, -1, 1 << 64)
_CHUNKS = SpanHasher(81)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _BACK)):
            x = np.full(n + n // 8, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def _prefix(points: np.ndarray) -> np.ndarray:
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * _power(len(points) + 1)[0][: len(points)], out=total[1:])
    return total


def _salt(length: int) -> int:
    return length * 0x9E3779B97F4A7C15 & (1 << 64) - 1


class Table:
    """From 64-bit keys to numbers above 0, looked up for whole arrays; what shares a slot goes to a next table."""

    BITS = 18

    def __init__(self, keys: np.ndarray, values: np.ndarray, level: int = 0):
        self.odd = np.uint64((0xD1B54A32D192ED03 + 0x9E3779B97F4A7C16 * level) & (1 << 64) - 1 | 1)
        self.keys, self.values, self.over = np.zeros(1 << self.BITS, np.uint64), np.zeros(1 << self.BITS, np.int32), None
        with np.errstate(over="ignore"):
            slot = self._slot(keys)
        _, first = np.unique(slot, return_index=True)
        self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        if len(rest):
            self.over = np.zeros(1 << self.BITS, bool)
            self.over[slot[rest]] = True
            self.next = Table(keys[rest], values[rest], level + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.odd) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys, 0 for others."""
        slot = self._slot(keys)
        same = self.keys[slot] == keys
        out = np.where(same, self.values[slot], 0)
        if self.over is not None:
            again = np.flatnonzero(self.over[slot] & ~same)
            if len(again):
                out[again] = self.next.get(keys[again])
        return out


class Lattices:
    """Lattices of chunks that a worker has met, by 64 bits of hash: of each node its edges back, with cumulative chances.

    They depend on the chunk alone. All go when there are more than LIMIT edges, and at the end of a task.
    """

    LIMIT = 1 << 20

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.base: dict[int, int] = {}
        self.nodes = self.edges = 0
        self.lo, self.hi = np.zeros(1 << 10, np.int32), np.zeros(1 << 10, np.int32)
        self.ids, self.step, self.cum = np.zeros(1 << 10, np.int32), np.zeros(1 << 10, np.int16), np.zeros(1 << 10)

    def add(self, keys: np.ndarray, base: np.ndarray, lo: np.ndarray, ids: np.ndarray, step: np.ndarray, cum: np.ndarray) -> None:
        """base: first node of each chunk, and their number; lo: first edge of each node, and their number."""
        for names, have, values in ((("lo", "hi"), self.nodes, (lo[:-1] + self.edges, lo[1:] + self.edges)), (("ids", "step", "cum"), self.edges, (ids, step, cum))):
            for name, x in zip(names, values, strict=True):
                old = getattr(self, name)
                if have + len(x) > len(old):
                    new = np.zeros((have + len(x)) * 3 // 2, old.dtype)
                    new[:have] = old[:have]
                    setattr(self, name, old := new)
                old[have : have + len(x)] = x
        self.base.update(zip(keys.tolist(), (base[:-1] + self.nodes).tolist(), strict=True))
        self.nodes += len(lo) - 1
        self.edges += len(ids)


class Vocabulary:
    """Pieces by hash, with the ids of byte pieces and the text of each piece."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.byte_id = np.zeros(256, np.int64)
        self.weight: dict[str, tuple[int, float]] = {}
        for i in range(self.size):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(p.replace(chr(SPACE), " ").encode())
                self.weight[p] = (i, -alpha * math.log1p(max(0.0, -model.get_score(i))) + KAPPA * len(p))
        self.longest = max(map(len, self.weight))
        if self.longest > 255:
            raise ValueError("pieces of more than 255 characters are not supported")
        self.lengths = np.array([len(b) for b in self.bytes_of])
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))
        self.content = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.inner = np.array(sorted({ord(c) for p in self.weight for c in p}))
        self.ids = np.array([i for i, _ in self.weight.values()], np.int32)
        self.weights = np.array([w for _, w in self.weight.values()])
        found: dict[int, int] = {}  # for each piece and beginning of a piece: its place and one, twice; plus one if longer pieces begin so
        for k, p in enumerate(self.weight):
            x = _prefix(np.array([ord(c) for c in p]))
            for n in range(1, len(p)):
                key = int(x[n]) ^ _salt(n)
                found[key] = found.get(key, 0) | 1
            key = int(x[-1]) ^ _salt(len(p))
            found[key] = found.get(key, 0) & 1 | 2 * (k + 1)
        self.table = Table(np.array(list(found), np.uint64), np.array(list(found.values()), np.int32))
        self.lattices = Lattices()

    def content_of(self, ids: np.ndarray) -> bytes:
        width = self.lengths[ids]
        at = np.arange(int(width.sum())) + np.repeat(self.offsets[ids] - (np.cumsum(width) - width), width)
        return self.content[at].tobytes()


@cache
def _vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


def _uniform(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (mix(key + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _long(v: Vocabulary, chunk: str, key: np.uint64, at: int) -> list[tuple[int, int]]:
    """(end, piece or -1 for the character's bytes) of one long chunk; only the forward sums are held."""
    n = len(chunk)
    total = array("d", [0.0]) * (n + 1)

    def ways(j: int) -> list[tuple[int, int, float]]:
        got = [(i, p[0], total[i] + p[1]) for i in range(max(0, j - v.longest), j) if (p := v.weight.get(chunk[i:j]))]
        if chunk[j - 1] not in v.weight or chunk[j - 1] == "\0":
            got.append((j - 1, -1, total[j - 1]))
        return got

    for j in range(1, n + 1):
        logs = [x for _, _, x in ways(j)]
        top = max(logs)
        total[j] = top + math.log(sum(math.exp(x - top) for x in logs))
    out, j = [], n
    with np.errstate(over="ignore"):
        while j:
            u = float(_uniform(np.array([key], np.uint64), np.array([at + j]))[0])
            for i, p, x in ways(j):
                u -= math.exp(x - total[j])
                if u < 0:
                    break
            out.append((j, p))
            j = i
    return out


def _lattice(points: np.ndarray, total: np.ndarray, back: np.ndarray, s: np.ndarray, k: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, ...]:
    """The lattices of chunks of k characters from s on: nodes between characters, edges for pieces (see Lattices.add)."""
    base = np.concatenate(([0], np.cumsum(k + 1)))
    within = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
    pos, end, node = np.repeat(s, k) + within, np.repeat(s + k, k), np.repeat(base[:-1], k) + within
    # An edge as one number, in the order in which sums are taken: place of its end in the chunk, end, start.
    edges, e_id, e_w = [], [], []
    alive, offset = np.arange(len(pos)), within
    for length in range(1, v.longest + 1):
        p = pos[alive]
        found = v.table.get((total[p + length] - total[p]) * back[p] ^ np.uint64(_salt(length)))
        got = np.flatnonzero(found > 1)
        piece, on = (found[got] >> 1) - 1, alive[got]
        e_id.append(v.ids[piece])
        e_w.append(v.weights[piece])
        if length == 1 and len(got) < len(found):
            none = alive[found <= 1]
            on = np.concatenate((on, none))
            e_id.append(np.full(len(none), v.size, np.int32))
            e_w.append(np.zeros(len(none)))
        edges.append((offset[on] + length) << 42 | (node[on] + length) << 8 | 255 - length)
        alive = alive[(found & 1 > 0) & (p + length < end[alive])]
        if not len(alive):
            break
    edges = np.concatenate(edges)
    order = np.argsort(edges)
    edges = edges[order]
    ids, w, t, step = np.concatenate(e_id)[order], np.concatenate(e_w)[order], edges >> 8 & (1 << 34) - 1, 255 - (edges & 255)
    f = t - step
    sums = np.zeros(base[-1])  # logarithms: plain sums of 112 kana are already below the least double
    groups = np.flatnonzero(np.diff(t, prepend=-1))
    each = np.diff(np.append(groups, len(t)))
    level = np.searchsorted(edges, np.arange(1, PLAIN + 2) << 42)
    prob = np.empty(len(f))
    g = np.searchsorted(groups, level)
    for p in range(len(level) - 1):
        a, b = level[p], level[p + 1]
        if a == b:
            continue
        logs = sums[f[a:b]] + w[a:b]
        own, many = groups[g[p] : g[p + 1]], each[g[p] : g[p + 1]]
        top = np.maximum.reduceat(logs, own - a)
        prob[a:b] = np.exp(logs - np.repeat(top, many))
        whole = np.add.reduceat(prob[a:b], own - a)
        prob[a:b] /= np.repeat(whole, many)
        sums[t[own]] = top + np.log(whole)
    # Cumulative sums of each node by itself: those of a whole slice would round by what else is in it.
    nth = np.arange(len(t)) - np.repeat(groups, each)
    for n in range(1, int(nth.max(initial=0)) + 1):
        at = np.flatnonzero(nth == n)
        prob[at] += prob[at - 1]
    lo = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=base[-1]))))
    place = lo[t] + nth
    out = np.empty(len(t), np.int32), np.empty(len(t), np.int16), np.empty(len(t))
    for x, values in zip(out, (ids, step, prob), strict=True):
        x[place] = values
    return base, lo, *out


def encode(texts: np.ndarray, offsets: np.ndarray, keys: np.ndarray, v: Vocabulary, before: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts (bytes in texts[offsets[i]:offsets[i + 1]]) and the first of each; keys: one of each row.

    before: the characters that came before, of texts that are later parts of longer ones (from a space on); -1: whole.
    """
    raw = texts[offsets[0] : offsets[-1]]
    marks = offsets - offsets[0]
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    first = np.searchsorted(np.flatnonzero((raw & 0xC0) != 0x80), marks)
    n_docs = len(marks) - 1
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return np.zeros(0, np.int64), np.zeros(n_docs + 1, np.int64)
    # The mark itself in a text has no piece here: its bytes are taken, so that it comes back as it was.
    truth, points = points, points.copy()
    points[truth == SPACE] = 0
    points[truth == 32] = SPACE
    begin = first[full]
    if before < 0:
        points, truth = np.insert(points, begin, SPACE), np.insert(truth, begin, 32)
        begin = begin + np.arange(len(full))
    n = len(points)
    doc = np.zeros(n, np.int64)
    doc[begin] = 1
    doc = np.cumsum(doc) - 1
    space = points == SPACE
    known = v.inner[np.minimum(np.searchsorted(v.inner, points), len(v.inner) - 1)] == points
    cut = np.zeros(n, bool)
    cut[1:] = (space[1:] & ~space[:-1]) | ~known[1:] | ~known[:-1]
    cut[begin] = True
    start = np.flatnonzero(cut)
    stop = np.append(start[1:], n)
    out = np.full(n + 1, -1)
    with np.errstate(over="ignore"):
        total, back = _prefix(points), _power(n + 1)[1]
        row_key = mix(keys.astype(np.uint64))[full]
        lone = (stop - start == 1) & ~known[start]
        out[stop[lone]] = v.size  # bytes of the character before
        size = stop - start
        for c in np.flatnonzero(size > PLAIN).tolist():
            a, z = int(start[c]), int(stop[c])
            for j, p in _long(v, "".join(map(chr, points[a:z].tolist())), row_key[doc[a]], a - int(begin[doc[a]]) + before + 1):
                out[a + j] = p if p >= 0 else v.size
        mine = np.flatnonzero(~lone & (size <= PLAIN))
        start, size = start[mine], size[mine]
        keys_of, at, which = np.unique(_CHUNKS(points.view(np.uint8), 4 * start, 4 * (start + size)), return_index=True, return_inverse=True)
        lattices = v.lattices
        if lattices.edges > lattices.LIMIT:
            lattices.clear()
        new = np.flatnonzero([k not in lattices.base for k in keys_of.tolist()])
        if len(new):
            lattices.add(keys_of[new], *_lattice(points, total, back, start[at[new]], size[at[new]], v))
        base = np.fromiter(map(lattices.base.__getitem__, keys_of.tolist()), np.int64, len(keys_of))
        # All occurrences, from their ends.
        at_node = base[which] + size
        where = start + size
        zero = base[which]
        key, origin = row_key[doc[start]], begin[doc[start]] - (before + 1)
        live, cum = np.arange(len(start)), lattices.cum
        while len(live):
            x = at_node[live]
            u = _uniform(key[live], where[live] - origin[live])
            a, b = lattices.lo[x].astype(np.int64), lattices.hi[x].astype(np.int64)
            aim, e = u * cum[b - 1], a.copy()
            on = np.flatnonzero(e < b - 1)
            while len(on := on[cum[e[on]] <= aim[on]]):
                e[on] += 1
                on = on[e[on] < b[on] - 1]
            out[where[live]] = lattices.ids[e]
            step = lattices.step[e]
            where[live] -= step
            at_node[live] = x - step
            live = live[at_node[live] > zero[live]]
    ends = np.flatnonzero(out >= 0)
    ids, owner = out[ends], doc[ends - 1]
    if (ids == v.size).any():  # characters without a piece become the pieces of their bytes
        cp = truth[ends - 1].astype(np.int64)
        width = np.where(ids == v.size, 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000), 1)
        row = np.repeat(np.arange(len(ids)), width)
        k = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
        c, last = cp[row], width[row] - 1 - k
        lead = np.where(width[row] == 1, c, np.array([0, 0, 0xC0, 0xE0, 0xF0])[width[row]] | c >> 6 * last)
        byte = np.where(k == 0, lead, 0x80 | c >> 6 * last & 0x3F)
        ids = np.where(ids[row] == v.size, v.byte_id[byte & 0xFF], ids[row])
        owner = owner[row]
    counts = np.zeros(n_docs, np.int64)
    counts[full] = np.bincount(owner, minlength=len(full))
    return ids, np.concatenate(([0], np.cumsum(counts)))


def decode(ids: np.ndarray, first: np.ndarray, v: Vocabulary) -> list[bytes]:
    """The texts of piece sequences: the first space is the one that encoding adds."""
    content = v.content_of(ids)
    edges = np.concatenate(([0], np.cumsum(v.lengths[ids])))[first]
    return [content[a + 1 : b] if b > a else b"" for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _parts(text: np.ndarray) -> list[int]:
    """Where the parts of a long text begin: at spaces after text, about SLICE bytes apart; chunks end there anyway."""
    good = np.flatnonzero((text[1:] == 32) & (text[:-1] != 32)) + 1
    out = [0]
    while True:
        k = int(np.searchsorted(good, out[-1] + SLICE))
        if k == len(good):
            return out
        out.append(int(good[k]))


def encode_long(text: np.ndarray, key: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, bool]:
    """Piece ids of one text, made part by part as encode() makes them of the whole, and whether they decode to it."""
    begins, ids, same, before = _parts(text), [], True, -1
    for a, z in zip(begins, [*begins[1:], len(text)], strict=True):
        part = text[a:z]
        got, _ = encode(part, np.array([0, len(part)]), key, v, before)
        said = v.content_of(got)
        same &= (said[1:] if before < 0 else said) == part.tobytes()
        before = max(before, 0) + int(((part & 0xC0) != 0x80).sum())
        ids.append(got.astype(np.int32))
    return np.concatenate(ids), same


@any_names
def encode_texts(docs: DataFrame, path: str, keys: list[str], text: str = "text", alpha: float = 1.0, seed: int = 0, with_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """docs with n_pieces, ids (if asked for), ids_sha256 (of the ids as little-endian int32), and whether they decode to the text.

    The segmentation of a row depends on the columns `keys`, the seed and its text alone. A null or empty text has no
    pieces and decodes to the empty text. Rows with equal keys and texts are segmented alike. Long texts are segmented
    part by part, with the same result, so that memory follows the longest run without a space, not the longest text.
    """
    fields = [StructField("n_pieces", LongType(), False), StructField("ids_sha256", StringType(), False), StructField("lossless", BooleanType(), False)]
    fields += [StructField("ids", ArrayType(IntegerType(), False), False)] * with_ids

    def work(cols):
        v = _vocabulary(path, alpha)
        content, offsets, _ = binary(cols[0])
        key = np.asarray(cols[1]).view(np.uint64)
        n, sha, same, lists = [], [], [], []
        for i, j in pieces(np.diff(offsets), SLICE):
            if j == i + 1 and offsets[j] - offsets[i] > 2 * SLICE:
                small, whole = encode_long(content[offsets[i] : offsets[j]], key[i:j], v)
                n.append(len(small))
                sha.append(hashlib.sha256(small.tobytes()).hexdigest())
                same.append(whole)
                if with_ids:
                    lists.append(pa.ListArray.from_arrays(pa.array([0, len(small)], pa.int32()), pa.array(small)))
                continue
            ids, first = encode(content, offsets[i : j + 1], key[i:j], v)
            small = ids.astype(np.int32)
            n += np.diff(first).tolist()
            edges = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
            sha += [hashlib.sha256(small[a:b].tobytes()).hexdigest() for a, b in edges]
            same += [x == content[offsets[i + k] : offsets[i + k + 1]].tobytes() for k, x in enumerate(decode(ids, first, v))]
            if with_ids:
                lists.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(small)))
        return [n, sha, same, *([pa.concat_arrays(lists)] if with_ids else [])]

    return add_columns(docs, [F.coalesce(F.col(text), F.lit("")).cast("binary"), F.xxhash64(*keys, F.lit(seed))], fields, work, () if keep_text else (text,), lambda: _vocabulary(path, alpha).lattices.clear())


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"], with_ids=False, keep_text=False)
    return out.select("doc_id", "n_pieces", "ids_sha256", "lossless")
