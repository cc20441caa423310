"""SentencePiece encoding and decoding with sampled segmentations.

All segmentations of a text into vocabulary pieces form a lattice. Pieces get Zipf
log-probabilities from their merge rank, since a BPE vocabulary has ranks only. Sampling
without replacement is Gumbel top-k: a best-first (A-star) search over the lattice in
which the bound of a partial segmentation is the perturbed score of its best completion.
Because the bound of a child given its parent is a truncated Gumbel variable, the bounds
are exact and the search pops the k best perturbed segmentations in order, all distinct,
with their perturbed scores; the next bound gives the inclusion probability of each.

The lattice factors exactly where no piece spans two neighbouring characters, so a text
is a row of short atoms. Masses of atoms are computed once for each distinct atom; all
atoms of many texts are walked together. All random numbers are hashes of the row key,
the sample's number and the place in the text, so results depend on nothing else.

Characters without a piece are spelled in byte pieces. Decoding joins the pieces, turns
the meta symbol into spaces and drops the leading one; decoding an encoding gives back
the text.

Defined results: null and empty texts have one segmentation, without pieces; a text with
fewer segmentations than asked for gives those it has, with inclusion 1; rows with equal
keys and texts have equal samples; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import slices, table

#: The default vocabulary file, where neither the function's parameter nor the setting MODEL_SETTING names one.
MODEL_FILE, MODEL_SETTING = "/opt/tokenizers/piece_bpe_32k.model", "spark.gaugeworks.sentencepiece.model"
SAMPLES = 2
#: Rank offset of the Zipf law, and the exponent that sharpens (over 1) or flattens it.
ZIPF, THETA = 2.7, 1.0
#: Extra cost of spelling a character in bytes.
BYTE_LOGP = -16.0
#: Distinct atoms kept by a worker between batches.
KEPT_ATOMS = 140_000
#: Bytes of text handled together; an array of this many numbers stays small.
SLICE = 600_000
SEED = 0

META = "▁"


class Vocabulary(NamedTuple):
    pieces: list[str]  # by id; byte and control pieces are empty strings
    logp: np.ndarray
    byte_ids: np.ndarray  # id of each byte's piece
    surface: list[bytes]  # by id: what decoding writes


def model_file(spark: SparkSession, given: str | None = None) -> str:
    return given or spark.conf.get(MODEL_SETTING, MODEL_FILE)


def load(path: str = MODEL_FILE) -> Vocabulary:
    """Pieces with Zipf log-probabilities by rank; read on the driver and broadcast."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces, surface, byte_ids, rank = [], [], np.full(256, -1, np.int64), np.full(n, np.inf)
    for i in range(n):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            b = int(p[3:5], 16)
            byte_ids[b] = i
            pieces.append("")
            surface.append(bytes([b]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            pieces.append("")
            surface.append(b"")
        else:
            pieces.append(p)
            surface.append(p.replace(META, " ").encode())
            rank[i] = -sp.get_score(i)
    weight = np.where(np.isfinite(rank), 1 / (np.maximum(rank, 0) + ZIPF), 0.0)
    with np.errstate(divide="ignore"):
        logp = THETA * np.log(weight / weight.sum())
    logp[byte_ids[byte_ids >= 0]] = BYTE_LOGP
    return Vocabulary(pieces, logp, byte_ids, surface)


def _splitmix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray | int, purpose: int, place: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the row key, the purpose and the place only."""
    x = np.asarray(key, np.uint64) ^ _splitmix(np.asarray(place, np.uint64) ^ (np.uint64(purpose) << np.uint64(48)))
    return (_splitmix(x) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


_WORD = (1 << 64) - 1


def _splitmix_one(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _WORD
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _WORD
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _WORD
    return x ^ (x >> 31)


def uniform_one(key: int, purpose: int, place: int) -> float:
    """uniform() of one place, without arrays."""
    return (_splitmix_one(key ^ _splitmix_one(place ^ purpose << 48)) >> 11) * 2.0**-53 + 2.0**-54


def codes(chars: np.ndarray) -> np.ndarray:
    """Numbers of characters in which the meta symbol is 0 and so among the common ones."""
    return np.where(chars == ord(META), 0, chars + 1)


def characters(code: np.ndarray) -> np.ndarray:
    return np.where(code == 0, ord(META), code - 1)


#: Places whose part of a random number is kept in a table.
KEPT_PLACES = 1 << 18


class Lattices:
    """Edges of distinct atoms: from each character the pieces that start there, with the chance of each given what follows."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.n_pieces = len(v.pieces)
        self.surface = pa.array(v.surface, pa.large_binary())
        # neighbouring characters that some piece spans
        spelled = [codes(np.array([ord(c) for c in p], np.int64)).tolist() for p in v.pieces]
        pairs = {a << 21 | b for p in spelled for a, b in zip(p, p[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.dense = np.zeros((1024, 1024), bool)
        for x in pairs:
            a, b = x >> 21, x & 0x1FFFFF
            if a < 1024 and b < 1024:
                self.dense[a, b] = True
        # a trie as a sorted table of (node, character) -> node
        trie: dict[int, int] = {}
        piece_of = [-1]
        for i, p in enumerate(spelled):
            node = 0
            for c in p:
                k = node << 21 | c
                if k not in trie:
                    trie[k] = len(piece_of)
                    piece_of.append(-1)
                node = trie[k]
            if p:
                piece_of[node] = i
        self.keys = np.array(sorted(trie), np.int64)
        self.next = np.array([trie[k] for k in self.keys.tolist()], np.int64)
        self.piece_of = np.array(piece_of, np.int64)
        # the first two steps of common characters without a search
        self.one, self.two = np.full(1024, -1, np.int32), np.full((1024, 1024), -1, np.int32)
        for k, node in trie.items():
            if not k >> 21 and k < 1024:
                self.one[k] = node
        parent = {node: k for k, node in trie.items() if not k >> 21}
        for k, node in trie.items():
            a, b = parent.get(k >> 21), k & 0x1FFFFF
            if a is not None and a < 1024 and b < 1024:
                self.two[a, b] = node
        self.mixed: dict[int, np.ndarray] = {}
        self.clear()

    def _step(self, node: np.ndarray, chars: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
        """The trie nodes one character on; -1 where there is none."""
        c = chars[at + depth]
        if depth < 2:
            near = c < 1024 if depth == 0 else (c < 1024) & (chars[at] < 1024)
            out = np.full(len(at), -1, np.int64)
            out[near] = self.one[c[near]] if depth == 0 else self.two[chars[at[near]], c[near]]
            if near.all():
                return out
            far = np.nonzero(~near)[0]
            out[far] = self._searched(node[far], c[far])
            return out
        return self._searched(node, c)

    def _searched(self, node: np.ndarray, c: np.ndarray) -> np.ndarray:
        k = node << 21 | c
        j = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[j] == k, self.next[j], -1)

    def clear(self) -> None:
        self.known: dict[int, int] = {}  # hash of an atom -> its first position
        self.n_positions = self.n_edges = 0
        self.edge_from = np.zeros(1 << 16, np.int32)  # by position; one more entry at the end
        self.piece = np.zeros(1 << 18, np.int32)
        self.length = np.zeros(1 << 18, np.uint8)
        self.chance = np.zeros(1 << 18, np.float32)  # running sum of the chances from the same position
        self.logq = np.zeros(1 << 18)

    def draws(self, key: np.ndarray, purpose: int, place: np.ndarray) -> np.ndarray:
        """As uniform(), the part of near places from a table."""
        if purpose not in self.mixed:
            self.mixed[purpose] = _splitmix(np.arange(KEPT_PLACES, dtype=np.uint64) ^ (np.uint64(purpose) << np.uint64(48)))
        if len(place) and place.max() >= KEPT_PLACES:
            return uniform(key, purpose, place)
        return (_splitmix(key ^ self.mixed[purpose][place]) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54

    def _grow(self, positions: int, edges: int) -> None:
        """Room for so many more, by doubling."""
        for name, n in (("edge_from", self.n_positions + positions + 1), ("piece", self.n_edges + edges), ("length", self.n_edges + edges), ("chance", self.n_edges + edges), ("logq", self.n_edges + edges)):
            old = getattr(self, name)
            if len(old) < n:
                new = np.zeros(max(n, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether some piece holds a followed by b."""
        small = (a < 1024) & (b < 1024)
        out = np.zeros(len(a), bool)
        out[small] = self.dense[a[small], b[small]]
        if not small.all():
            k = a[~small] << 21 | b[~small]
            at = np.minimum(np.searchsorted(self.pairs, k), len(self.pairs) - 1)
            out[~small] = self.pairs[at] == k
        return out

    def add(self, text: np.ndarray, first: np.ndarray, length: np.ndarray, names: list[int]) -> None:
        """Add atoms, given as stretches of the characters of text; the distinct names become known."""
        starts = np.cumsum(length) - length
        n = int(length.sum())
        atom = np.repeat(np.arange(len(first)), length)
        offset = np.arange(n) - starts[atom]
        chars = text[first[atom] + offset]
        left = length[atom] - offset  # characters up to the atom's end
        node, at = np.zeros(n, np.int64), np.arange(n)
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        single = np.zeros(n, bool)
        depth = 0
        while len(at):
            node = self._step(node, chars, at, depth)
            ok = node >= 0
            at, node = at[ok], node[ok]
            depth += 1
            piece = self.piece_of[node]
            good = piece >= 0
            found.append((at[good], piece[good], depth))
            if depth == 1:
                single[at[good]] = True
            more = left[at] > depth
            at, node = at[more], node[more]
        lone = np.nonzero(~single)[0]
        code = characters(chars[lone])
        # a character without a piece: the byte's piece, or for several bytes a number past the vocabulary
        found.append((lone, np.where(code < 128, self.v.byte_ids[np.minimum(code, 127)], self.n_pieces + code), 1))
        found.reverse()  # the longest piece of a position first: it is mostly the likeliest, so a draw is soon decided
        src = np.concatenate([f[0] for f in found])
        piece = np.concatenate([f[1] for f in found])
        span = np.concatenate([np.full(len(f[0]), f[2]) for f in found])
        order = np.argsort(src, kind="stable")
        src, piece, span = src[order], piece[order], span[order]
        cost = np.where(piece < self.n_pieces, self.v.logp[np.minimum(piece, self.n_pieces - 1)], 2 * BYTE_LOGP)
        edge_from = np.append(0, np.cumsum(np.bincount(src, minlength=n)))
        # mass of everything from a position to the atom's end, nearest the end first
        mass = np.zeros(n + 1)
        goal = src + span
        ends = left[src] == span
        by_left = np.argsort(left, kind="stable")
        cuts = np.searchsorted(left[by_left], np.arange(1, int(left.max(initial=0)) + 2))
        logq = np.empty(len(src))
        for d in range(len(cuts) - 1):
            p = by_left[cuts[d] : cuts[d + 1]]
            count = edge_from[p + 1] - edge_from[p]
            owner = np.repeat(np.arange(len(p)), count)
            e = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + edge_from[p][owner]
            value = cost[e] + np.where(ends[e], 0.0, mass[goal[e]])
            begin = np.cumsum(count) - count
            top = np.maximum.reduceat(value, begin)
            mass[p] = top + np.log(np.add.reduceat(np.exp(value - top[owner]), begin))
            logq[e] = value - mass[p][owner]
        chance = np.cumsum(np.exp(logq))
        chance -= np.repeat(np.append(0, chance)[edge_from[:-1]], np.diff(edge_from))
        chance[edge_from[1:] - 1] = 2.0  # the last edge of a position takes what is left
        self._grow(n, len(src))
        base, e_base = self.n_positions, self.n_edges
        self.edge_from[base : base + n + 1] = edge_from + e_base
        for name, new in (("piece", piece), ("length", span), ("chance", chance), ("logq", logq)):
            getattr(self, name)[e_base : e_base + len(src)] = new
        self.n_positions, self.n_edges = base + n, e_base + len(src)
        for name, s in zip(names, starts.tolist(), strict=True):
            self.known[name] = base + s


class Texts(NamedTuple):
    """Some texts cut into atoms."""

    keys: np.ndarray
    chars: np.ndarray
    text_from: np.ndarray  # by text: its first atom (one more entry at the end)
    atom_from: np.ndarray  # by atom: its first character
    length: np.ndarray
    root: np.ndarray  # by atom: its first position in the lattices


def prepare(texts: list[str | None], keys: np.ndarray, lat: Lattices) -> Texts:
    """Cut texts into atoms and make the lattices know them."""
    data = [(META + t.replace(" ", META)) if t else "" for t in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    chars = codes(np.frombuffer("".join(data).encode("utf-32-le", "replace"), "<u4").astype(np.int64))
    n = len(chars)
    begin = np.ones(n, bool)
    begin[1:] = ~lat.spans(chars[:-1], chars[1:])
    text_at = np.cumsum(sizes) - sizes
    begin[text_at[sizes > 0]] = True
    atom_from = np.nonzero(begin)[0]
    length = np.diff(atom_from, append=n)
    text_from = np.searchsorted(atom_from, np.append(text_at, n))
    if not n:
        return Texts(keys, chars, text_from, atom_from, length, np.zeros(0, np.int64))
    place = np.arange(n) - np.repeat(atom_from, length)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_splitmix(chars.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)), atom_from)
    which, names = pd.factorize(h)
    first = np.empty(len(names), np.int64)
    first[which[::-1]] = np.arange(len(h))[::-1]
    if len(lat.known) > KEPT_ATOMS:
        lat.clear()
    listed = names.tolist()
    new = [i for i, x in enumerate(listed) if x not in lat.known]
    if new:
        at = first[new]
        lat.add(chars, atom_from[at], length[at], [listed[i] for i in new])
    root = np.fromiter(map(lat.known.__getitem__, listed), np.int64, len(listed))[which]
    return Texts(keys, chars, text_from, atom_from, length, root)


def walk(t: Texts, lat: Lattices, sample: int, atoms: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sample a segmentation of each of the atoms: edges in order, where each atom's edges start, and log-chances of the atoms."""
    at, position, done = np.arange(len(atoms)), t.root[atoms], np.zeros(len(atoms), np.int64)
    count, logp = np.zeros(len(atoms), np.int64), np.zeros(len(atoms))
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    key, length = t.keys[owner], t.length[atoms]
    place = t.atom_from[atoms] - t.atom_from[np.minimum(t.text_from[owner], len(t.atom_from) - 1)]
    while len(at):
        u = lat.draws(key[at], sample, place[at] + done[at])
        edge = lat.edge_from[position[at]]
        wrong = np.nonzero(u >= lat.chance[edge])[0]
        while len(wrong):
            edge[wrong] += 1
            wrong = wrong[u[wrong] >= lat.chance[edge[wrong]]]
        steps.append((at, edge))
        count[at] += 1
        logp[at] += lat.logq[edge]
        step = lat.length[edge]
        done[at] += step
        position[at] += step
        at = at[done[at] < length[at]]
    start = np.zeros(len(atoms) + 1, np.int64)
    np.cumsum(count, out=start[1:])
    edges = np.empty(start[-1], np.int64)
    for k, (who, edge) in enumerate(steps):
        edges[start[who] + k] = edge
    return edges, start, np.minimum(logp, 0.0)


def _differing(lat: Lattices, root: int, length: int, taken: list[tuple[int, ...]], draw) -> tuple[tuple[int, ...], float] | None:
    """A segmentation of one atom other than those taken, by its chance among these; None if hardly any is left."""
    position, left, rivals, edges, logp = root, length, [list(x) for x in taken], [], 0.0
    while left:
        low, high = int(lat.edge_from[position]), int(lat.edge_from[position + 1])
        rest = []
        for e in range(low, high):
            q = math.exp(lat.logq[e])
            # what the taken ones through this edge hold of it; one minus it without cancellation for a single one
            through = [r[1:] for r in rivals if r[0] == e]
            if not through:
                rest.append(q)
            elif len(through) == 1:
                rest.append(q * -math.expm1(min(0.0, sum(lat.logq[x] for x in through[0]))))
            else:
                rest.append(q * max(0.0, 1 - sum(math.exp(sum(lat.logq[x] for x in r)) for r in through)))
        total = sum(rest)
        if total <= 1e-300:
            return None
        u, e = draw(len(edges)) * total, low
        for k, r in enumerate(rest):
            if r > 0:
                e = low + k
                if u < r:
                    break
                u -= r
        rivals = [r[1:] for r in rivals if r[0] == e]
        edges.append(e)
        logp += lat.logq[e]
        position += int(lat.length[e])
        left -= int(lat.length[e])
    return tuple(edges), min(0.0, float(logp))


def _truncated(mass: np.ndarray | float, top: np.ndarray | float, u: np.ndarray | float) -> np.ndarray:
    """The maximum of Gumbel variables of this log-mass, given that it is at most top."""
    with np.errstate(over="ignore", divide="ignore"):
        return -np.logaddexp(-top, np.log(-np.log(u)) - mass)


class Sample(NamedTuple):
    edges: np.ndarray
    start: np.ndarray  # by atom of the text
    logp: np.ndarray  # by atom
    score: float


def search(t: Texts, lat: Lattices, k: int) -> list[tuple[list[Sample], float]]:
    """For each text its k best perturbed segmentations in order, and the bound of the next one.

    The agenda of a text holds sets of segmentations: those that agree with a sample up to
    an atom and differ in it. Popping one draws its best member, which is a sample; the
    sets that are left beside it go back with their own bounds.
    """
    n_texts = len(t.keys)
    counts = np.diff(t.text_from)
    out: list[list[Sample]] = [[] for _ in range(n_texts)]
    agenda: list[list[tuple]] = [[] for _ in range(n_texts)]

    def left_beside(sample: int, who: list[int], start: np.ndarray, local: np.ndarray, logp: np.ndarray, base: np.ndarray) -> None:
        """Sets that differ from a sample of each text in one of the given atoms.

        start: where each text's atoms begin here; local: their numbers in the text;
        base: log-chance of all atoms before them.
        """
        sizes = np.diff(start)
        owner = np.repeat(np.arange(len(who)), sizes)
        running = np.cumsum(logp) - logp
        before = running - np.repeat(running[np.minimum(start[:-1], max(len(logp) - 1, 0))] if len(logp) else np.zeros(len(who)), sizes) + base[owner]
        with np.errstate(divide="ignore"):
            mass = before + np.log(-np.expm1(logp))
        score = np.array([out[i][-1].score for i in who])
        bounds = _truncated(mass, score[owner], uniform(t.keys[np.array(who, np.int64)][owner], 2048 + sample, local))
        bounds[mass <= -600] = -np.inf
        for n, i in enumerate(who):
            low, high = int(start[n]), int(start[n + 1])
            mine = bounds[low:high]
            # only the k + 1 best can ever be popped
            best = np.argpartition(-mine, k)[: k + 1] if high - low > k + 1 else np.arange(high - low)
            s, number = out[i][-1], len(out[i]) - 1
            for j in best.tolist():
                if mine[j] > -np.inf:
                    a = int(local[low + j])
                    heapq.heappush(agenda[i], (-float(mine[j]), len(agenda[i]), number, a, (tuple(s.edges[s.start[a] : s.start[a + 1]].tolist()),), float(before[low + j])))

    # the root: all segmentations, of log-mass zero
    atoms = np.arange(len(t.atom_from))
    owner = np.repeat(np.arange(n_texts), counts)
    edges, start, logp = walk(t, lat, 0, atoms, owner)
    top = -np.log(-np.log(uniform(t.keys, 4095, 0)))
    for i in range(n_texts):
        a, b = int(t.text_from[i]), int(t.text_from[i + 1])
        s = Sample(edges[start[a] : start[b]], start[a : b + 1] - start[a], logp[a:b], float(np.ravel(top)[i]))
        out[i].append(s)
    left_beside(0, list(range(n_texts)), t.text_from, atoms - np.repeat(t.text_from[:-1], counts), logp, np.zeros(n_texts))
    for r in range(1, k):
        chosen: list[tuple] = []
        for i in range(n_texts):
            while agenda[i]:
                bound, _, parent, a, taken, before = heapq.heappop(agenda[i])
                g = int(t.text_from[i]) + a
                got = _differing(lat, int(t.root[g]), int(t.length[g]), list(taken), lambda n, key=int(t.keys[i]), a=a, r=r: uniform_one(key, 1024 + r, a * 64 + n))
                if got is None:
                    continue
                chosen.append((i, -bound, parent, a, taken, before, *got))
                break
        # the atoms after the one that differs are sampled anew, for all texts together
        many = [np.arange(int(t.text_from[c[0]]) + c[3] + 1, int(t.text_from[c[0] + 1])) for c in chosen]
        if not chosen:
            break
        sizes = [len(m) for m in many]
        fresh = np.concatenate(many)
        edges, start, logp = walk(t, lat, r, fresh, np.repeat(np.array([c[0] for c in chosen]), sizes))
        at, bases = 0, []
        for c, size in zip(chosen, sizes, strict=True):
            i, score, parent, a, taken, before, own, own_logp = c
            p = out[i][parent]
            head = int(p.start[a])
            new_edges = np.concatenate([p.edges[:head], np.array(own, np.int64), edges[start[at] : start[at + size]]])
            new_start = np.concatenate([p.start[: a + 1], start[at : at + size + 1] - start[at] + head + len(own)])
            s = Sample(new_edges, new_start, np.concatenate([p.logp[:a], [own_logp], logp[at : at + size]]), score)
            at += size
            out[i].append(s)
            bases.append(float(s.logp[: a + 1].sum()))
            taken = (*taken, own)
            left = 1 - sum(math.exp(min(0.0, float(sum(lat.logq[e] for e in x)))) for x in taken)
            if left > 1e-12:
                bound = float(_truncated(before + math.log(left), score, uniform_one(int(t.keys[i]), 3072 + r, a)))
                heapq.heappush(agenda[i], (-bound, len(agenda[i]) + 10_000, parent, a, taken, before))
        who = [c[0] for c in chosen]
        left_beside(r, who, np.append(0, np.cumsum(sizes)), fresh - np.repeat(t.text_from[who], sizes), logp, np.array(bases))
    return [(s, -agenda[i][0][0] if agenda[i] else -math.inf) for i, s in enumerate(out)]


def piece_ids(s: Sample, lat: Lattices, v: Vocabulary) -> np.ndarray:
    """The ids of a sample; characters of several bytes without a piece become their byte pieces."""
    ids = lat.piece[s.edges]
    n = len(v.pieces)
    wide = np.nonzero(ids >= n)[0]
    if not len(wide):
        return ids
    out, at = [], 0
    for w in wide.tolist():
        out += [ids[at:w], v.byte_ids[list(chr(int(ids[w]) - n).encode("utf-8", "replace"))]]
        at = w + 1
    return np.concatenate([*out, ids[at:]])


def decode(ids: list[int], v: Vocabulary) -> str:
    """The text of a row of ids."""
    data = b"".join(map(v.surface.__getitem__, ids))
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def decoded_all(ids: np.ndarray, ends: np.ndarray, surface: pa.Array) -> Iterator[str]:
    """As decode() of each of many rows of ids that lie one after the other; what they write is gathered at once."""
    if not len(ids):
        yield from [""] * (len(ends) - 1)
        return
    _, offsets, data = surface.take(pa.array(np.where(ids < 0, ids + len(surface), ids))).buffers()
    at, written = np.frombuffer(offsets, np.int64)[ends].tolist(), data.to_pybytes() if data else b""
    for a, b in pairwise(at):
        yield written[a + (a < b and written[a] == 32) : b].decode("utf-8", "replace")


def inclusion(logp: float, bound: float) -> float:
    """Chance that a segmentation of this log-probability is among the samples, given the bound of the next one."""
    if bound == -math.inf:
        return 1.0
    return -math.expm1(-math.exp(min(700.0, logp - bound)))


def row_keys(ids: list, seed: int = SEED) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), seed) for i in ids], np.uint64)


def sampled(documents: DataFrame, k: int = SAMPLES, vocabulary: str | None = None, key: str = "doc_id") -> DataFrame:
    """A row for each sample: key, sample (0, 1 ...), ids, n_pieces, log_prob, perturbed, inclusion, ids_xxh64, decoded_ok.

    decoded_ok: decoding the ids gave the text.
    """
    # made once; a worker keeps it, with the atoms that it knows, from task to task
    sent = documents.sparkSession.sparkContext.broadcast(Lattices(load(model_file(documents.sparkSession, vocabulary))))
    kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
    names = ["sample", "ids", "n_pieces", "log_prob", "perturbed", "inclusion", "ids_xxh64", "decoded_ok"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = sent.value
        v = lat.v
        for s in slices(batches, most=SLICE):
            texts = s.column(1).to_pylist()
            t = prepare(texts, row_keys(s.column(0).to_pylist()), lat)
            rows, who, pieces = [], [], []
            for i, (got, bound) in enumerate(search(t, lat, k)):
                for j, x in enumerate(got):
                    ids = piece_ids(x, lat, v).astype(np.int32)
                    logp = float(x.logp.sum())
                    rows.append((j, len(ids), logp, x.score, inclusion(logp, bound), xxhash.xxh64_hexdigest(ids.astype("<i4").tobytes())))
                    who.append(i)
                    pieces.append(ids)
            ends, flat = np.cumsum([0, *map(len, pieces)], dtype=np.int32), np.concatenate(pieces)
            cols = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            cols.insert(1, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            cols.append(pa.array([x == (texts[i] or "") for i, x in zip(who, decoded_all(flat, ends, lat.surface), strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([s.column(0).take(pa.array(who)), *cols], names=[key, *names])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, "text").mapInArrow(run, f"{key} {kind}, sample int, ids array<int>, n_pieces long, log_prob double, perturbed double, inclusion double, ids_xxh64 string, decoded_ok boolean")


def encoded(documents: DataFrame, vocabulary: str | None = None, ids: str = "ids") -> DataFrame:
    """The documents with the library's own (deterministic) encoding in ids; a column of that name is replaced. Null is the empty text."""
    with open(model_file(documents.sparkSession, vocabulary), "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())
    kept = documents.drop(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=sent.value)
        for s in slices(batches):
            found = sp.encode([t or "" for t in s.column("text").to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([*s.columns, pa.array(found, pa.list_(pa.int32()))], names=[*s.schema.names, ids])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(ids, ArrayType(IntegerType()))]))


def decoded(rows: DataFrame, vocabulary: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with the text of their ids in decoded; a column of that name is replaced. Null ids give null."""
    sent = rows.sparkSession.sparkContext.broadcast(load(model_file(rows.sparkSession, vocabulary)))
    kept = rows.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [None if x is None else decode(x, sent.value) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*b.schema.names, text])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(text, StringType())]))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(table(spark, sf_dir, "documents"))
