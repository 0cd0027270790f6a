"""SentencePiece encoding and decoding with sampled segmentations, distinct and seeded by row.

All segmentations of a text into vocabulary pieces form a lattice; a segmentation's probability is proportional to the product
of its pieces' weights.  Gumbel top-k draws ``k`` distinct ones without replacement: every segmentation gets its log
probability plus Gumbel noise, and the k largest are found by a search that is best-first over *sets* of segmentations (A*).  The
best member of a set is an ancestral draw; taking it out splits the set into one set a step of its path - those that agree up
to there and then differ - whose largest perturbed values are truncated Gumbels.  The next sample comes from the set with the
largest value.  The largest value that is left over after k samples is the threshold of the inclusion scores.

Words (a run of spaces and what follows up to the next space) do not share pieces, so the lattice of a text is a chain of
words' lattices, and those of a batch's distinct words are built and summed together in numpy.

Piece weights: a merge-based vocabulary has ranks for scores, so the piece of rank r weighs 1 / (r + 2.7); a vocabulary whose
scores are log probabilities can be used as it is.  Characters outside the vocabulary fall back to bytes, so decoding returns
every text exactly.

Defined results.  A null text gives null results; an empty text has the one empty segmentation.  A text with fewer than k
segmentations gives all it has.  Equal rows (same key, same text) give equal samples.  No rows in, no rows out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import give_back, small_batches, with_arrow

SPACE_MARK = "▁"
#: Log probability below which a prefix cannot matter beside the sets that branch off before it.
FAINT = -80.0
#: Stands where no piece may match.
NO_CODE = 0x1FFFFF
CHUNK = re.compile(r" *[^ ]+| +\Z")


@dataclass(frozen=True)
class PieceModel:
    """A SentencePiece model file's bytes.  ``scores``: "ranks" or "logprob"."""

    proto: bytes
    scores: str = "ranks"
    seed: int = 11

    @classmethod
    def from_path(cls, path: str, **options) -> PieceModel:
        with open(path, "rb") as f:
            return cls(f.read(), **options)


class Vocabulary:
    """Pieces as a trie over code points, with log weights and byte pieces."""

    def __init__(self, model: PieceModel):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model.proto)
        n = sp.get_piece_size()
        self.byte_ids = np.zeros(256, np.int32)
        self.text_of: list[bytes] = [b""] * n
        usable: list[tuple[str, int]] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.text_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and SPACE_MARK not in piece.lstrip(SPACE_MARK):
                self.text_of[i] = piece.replace(SPACE_MARK, " ").encode()
                usable.append((piece, i))
        score = np.array([sp.get_score(i) for i in range(n)])
        if model.scores == "ranks":
            rank = np.where(score <= -1e8, n, -score)
            self.logw = -np.log(rank + 2.7)
        else:
            self.logw = score
        self.log_fallback = float(-np.log(n + 2.7)) if model.scores == "ranks" else float(score.min()) - 10
        # a trie whose edges (node << 21 | code point) lie in an open-addressed table; spaces stand for the space mark
        children: dict[tuple[int, int], int] = {}
        final = {}
        self.longest = 0
        for piece, i in usable:
            node = 0
            for c in piece.replace(SPACE_MARK, " "):
                node = children.setdefault((node, ord(c)), len(children) + 1)
            final[node] = i
            self.longest = max(self.longest, len(piece))
        self.piece_at = np.full(len(children) + 1, -1, np.int32)
        self.piece_at[list(final)] = list(final.values())
        # a slot holds key << 20 | child, so a probe is one look-up; the root's children lie in an array of their own
        if len(children) >= 1 << 20:
            raise ValueError("the vocabulary's trie has too many nodes")
        self.bits = max(8, len(children).bit_length() + 2)
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.of_root = np.zeros(NO_CODE + 1, np.int32)
        for (node, c), child in children.items():
            if not node:
                self.of_root[c] = child
                continue
            k = (node << 21) | c
            h = self._hash_one(k)
            while self.slots[h] >= 0:
                h = (h + 1) & ((1 << self.bits) - 1)
            self.slots[h] = k << 20 | child

    def _hash_one(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - self.bits)

    def child(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Children of trie nodes below the root, 0 where there is none."""
        key = (node.astype(np.int64) << 21) | code
        h = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)
        found = self.slots[h]
        out = np.where(found >> 20 == key, found & 0xFFFFF, 0).astype(np.int32)
        on = np.flatnonzero((out == 0) & (found >= 0))
        while len(on):
            h[on] = (h[on] + 1) & ((1 << self.bits) - 1)
            found = self.slots[h[on]]
            hit = found >> 20 == key[on]
            out[on[hit]] = found[hit] & 0xFFFFF
            on = on[~hit & (found >= 0)]
        return out


def chunks(text: str) -> list[str]:
    """Words with their spaces, the first of which is left out: the text's own dummy space stands before the first word."""
    parts = text.split(" ")
    return parts if "" not in parts else [c[1:] for c in CHUNK.findall(" " + text)]


def distinct_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, index of every word in order, number of words of each text)."""
    parts = pc.split_pattern(pa.array(texts, pa.string()), " ")
    coded = parts.flatten().dictionary_encode()
    names, word = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    at = parts.offsets.to_numpy().astype(np.int64)
    if "" not in names:
        return names, word, np.diff(at)
    known = {w: i for i, w in enumerate(names)}
    blank, rows = known[""], []
    odd = np.add.reduceat(np.append(word == blank, False), at[:-1]) if len(texts) else []
    for i, t in enumerate(texts):  # texts with several spaces in a row, or none at all
        rows.append(np.array([known.setdefault(w, len(known)) for w in (chunks(t) if t else [])], np.int64) if odd[i] else word[at[i] : at[i + 1]])
    return list(known), np.concatenate(rows), np.array([len(r) for r in rows], np.int64)


class Lattices:
    """The lattices of distinct words: edges sorted by node, longest first, with probabilities given the node.

    A word of m characters (its first space included) has nodes 0..m.  Nodes are numbered by (position, word), words sorted by
    length, so that the nodes of a position are together and the sums run over positions, last to first.
    """

    def __init__(self, words: list[str], v: Vocabulary):
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(-size, kind="stable")
        self.rank = np.empty(len(words), np.int64)  # word -> its place among the sorted
        self.rank[order] = np.arange(len(words))
        size = size[order]
        longest = int(size[0]) if len(words) else 0
        # words with a node at position p: those longer than or equal to p
        with_node = np.searchsorted(-size, -np.arange(longest + 2), "right") if longest else np.zeros(2, np.int64)
        self.base = np.concatenate(([0], np.cumsum(with_node[: longest + 1]))).astype(np.int64)
        joined = "\0".join([" " + words[i] for i in order.tolist()]) + "\0"
        flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.int32)
        first = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
        word = np.repeat(np.arange(len(words), dtype=np.int32), size + 1)
        pos = np.arange(len(flat), dtype=np.int32) - first.astype(np.int32)[word]
        inside = pos < size.astype(np.int32)[word]  # the rest are word ends, which no piece crosses
        base = self.base.astype(np.int32)
        node_of = base[pos] + word
        code = np.append(np.where(inside & (flat != ord(SPACE_MARK)), flat, NO_CODE), np.full(v.longest, NO_CODE, np.int32))
        # pieces starting at every character, a length at a time
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        live = np.flatnonzero(inside)
        node = v.of_root[code[live]]
        n_nodes = int(self.base[-1])
        counts = np.zeros(n_nodes, np.int64)
        for n in range(1, v.longest + 1):
            ok = node > 0
            live, node = live[ok], node[ok]
            if not len(live):
                break
            piece = v.piece_at[node]
            found = piece >= 0
            edges.append((live[found], piece[found]))
            counts[node_of[live[found]]] += 1
            node = v.child(node, code[live + n])
        single = np.zeros(len(flat), bool)
        if edges:
            single[edges[0][0]] = True
        missing = np.flatnonzero(inside & ~single)  # no piece for the character alone: its bytes
        self.fallback: list[np.ndarray] = []
        known: dict[int, int] = {}
        codes = []
        for c in flat[missing].tolist():
            if c not in known:
                known[c] = len(self.fallback)
                self.fallback.append(v.byte_ids[np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8)])
            codes.append(-1 - known[c])
        counts[node_of[missing]] += 1
        # a node has one edge of a length at most: the longest lengths take their places first
        self.first_edge = np.concatenate(([0], np.cumsum(counts)))
        free = self.first_edge[:-1].copy()
        piece, self.source, self.target = (np.empty(self.first_edge[-1], np.int32) for _ in range(3))
        for n, (at, ids) in [*reversed(list(enumerate(edges, 1))), (1, (missing, np.array(codes, np.int32)))]:
            here = node_of[at]
            place = free[here]
            free[here] += 1
            piece[place], self.source[place], self.target[place] = ids, here, base[pos[at] + n] + word[at]
        self.piece, node = piece, self.source
        del edges, live, single, code, inside, pos, word, node_of, free
        beta = np.zeros(n_nodes)
        val = np.empty(len(node))
        for at in range(longest - 1, -1, -1):
            lo, hi = self.base[at], self.base[at] + np.searchsorted(-size, -at, "left")  # nodes that aren't ends
            a, b = self.first_edge[lo], self.first_edge[hi]
            if a == b:
                continue
            val[a:b] = v.logw[np.maximum(piece[a:b], 0)] + beta[self.target[a:b]]
            val[a:b][piece[a:b] < 0] += v.log_fallback - v.logw[0]
            begin = self.first_edge[lo:hi] - a
            top = np.maximum.reduceat(val[a:b], begin)
            total = np.add.reduceat(np.exp(val[a:b] - np.repeat(top, counts[lo:hi])), begin)
            beta[lo:hi] = top + np.log(total)
        val -= beta[node]
        self.logq = val
        self.cdf = np.exp(self.logq)
        at, left = self.first_edge[:-1][counts > 1], counts[counts > 1]
        while len(at):  # each node's own sum, so that it doesn't depend on what else is in the batch
            at, left = at + 1, left - 1
            self.cdf[at] += self.cdf[at - 1]
            at, left = at[left > 1], left[left > 1]

    def roots(self, words: np.ndarray) -> np.ndarray:
        return self.base[0] + self.rank[words]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) that depend on their arguments only."""
    x = key + np.uint64(0x9E3779B97F4A7C15) * (np.atleast_1d(a).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.atleast_1d(b).astype(np.uint64) + np.uint64(1))
    return ((_mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def row_key(doc_id: int | None, text: str, seed: int) -> int:
    d = hashlib.blake2b(f"{seed}:{doc_id}:{len(text)}".encode(), digest_size=8).digest()
    return int.from_bytes(d, "little")


@dataclass
class Sample:
    """Edge path of one sample of every text of a batch: ``text`` and ``edge`` by step, steps of a text together."""

    begin: np.ndarray
    edge: np.ndarray
    log_prob: np.ndarray
    perturbed: np.ndarray
    exists: np.ndarray


def descend(lat: Lattices, occ: np.ndarray, node: np.ndarray, key: np.ndarray, serial: np.ndarray, draw: int) -> tuple[np.ndarray, np.ndarray]:
    """Ancestral draws from each occurrence's node to its word's end: (index into occ, edge), in order of occurrence and step."""
    at, owner, out_o, out_e, step = node.copy(), np.arange(len(occ)), [], [], 0
    while len(owner):
        ends = lat.first_edge[at] == lat.first_edge[at + 1]
        if ends.any():
            owner, at = owner[~ends], at[~ends]
            if not len(owner):
                break
        u = uniform(key[owner], serial[owner] * 1024 + draw, step)
        edge = lat.first_edge[at].copy()
        last = lat.first_edge[at + 1] - 1
        on = np.flatnonzero((u > lat.cdf[edge]) & (edge < last))
        while len(on):
            edge[on] += 1
            e = edge[on]
            on = on[(u[on] > lat.cdf[e]) & (e < last[on])]
        out_o.append(owner)
        out_e.append(edge)
        at = lat.target[edge]
        step += 1
    if not out_o:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    o, e = np.concatenate(out_o), np.concatenate(out_e)
    order = np.argsort(o, kind="stable")
    return o[order], e[order]


class Sampler:
    """Draws for batches of texts."""

    def __init__(self, model: PieceModel):
        self.v, self.seed = Vocabulary(model), model.seed

    def sample(self, texts: list[str], ids: list, k: int) -> tuple[list[Sample], Lattices, np.ndarray]:
        """``k`` samples of every text, and the threshold (largest perturbed value that is left, -inf if nothing is)."""
        names, word, count = distinct_words(texts)
        lat = Lattices(names, self.v)
        n = len(texts)
        start = np.concatenate(([0], np.cumsum(count)))
        text_of = np.repeat(np.arange(n), count)
        serial = np.arange(len(word)) - start[text_of]
        key = np.array([row_key(i, t, self.seed) for i, t in zip(ids, texts, strict=True)], np.uint64)
        root = lat.roots(word)
        gumbel = -np.log(-np.log(uniform(key, 1 << 40, 0)))
        samples, pool = [], []
        value = gumbel
        o, e = descend(lat, np.arange(len(word)), root, key[text_of], serial, 0)
        steps = _Steps(text_of[o], o, e, n)
        exists = np.ones(n, bool)
        begin_step, excluded = np.zeros(n, np.int64), None
        threshold = np.full(n, -np.inf)
        for r in range(k):
            lq = lat.logq[steps.edge]
            total = np.bincount(steps.text, weights=lq, minlength=n)
            samples.append(Sample(steps.begin, steps.edge, total, value.copy(), exists.copy()))
            # the sets that are left when this sample is taken out of its own: one a step from where it was drawn
            before = np.concatenate(([0.0], np.cumsum(lq)))[:-1]
            prefix = before - np.repeat(before[np.minimum(steps.begin[:-1], max(len(before) - 1, 0))] if len(before) else np.zeros(n), np.diff(steps.begin))
            t = np.full(len(lq), -np.inf)
            # sets behind a prefix this unlikely are lost in the rounding of the others; they are only looked at if no other is left
            self._values(lat, steps, np.flatnonzero(prefix > FAINT), t, prefix, lq, excluded, begin_step, exists, value, key, r)
            none = _top(steps, t) == -np.inf
            if none.any():
                self._values(lat, steps, np.flatnonzero((prefix <= FAINT) & none[steps.text]), t, prefix, lq, excluded, begin_step, exists, value, key, r)
            pool.append(_Pool(steps, t, excluded, begin_step.copy(), None if excluded is None else self._taken.copy()))
            best = np.stack([p.top() for p in pool])
            which = best.argmax(axis=0)
            threshold = best.max(axis=0)
            if r == k - 1:
                break
            exists = exists & ~np.isneginf(threshold)
            value = np.where(exists, threshold, -np.inf)
            steps, begin_step, excluded, self._taken = self._next(lat, pool, which, exists, key, text_of, serial, root, start, r + 1, n)
        return samples, lat, threshold

    def _values(self, lat, steps, at, t, prefix, lq, excluded, begin_step, exists, value, key, r):
        """Largest perturbed values of the sets at steps ``at``: Gumbels of the sets' mass, truncated at the sample's value."""
        text = steps.text[at]
        step_no = at - steps.begin[text]
        gone = np.exp(lq[at])
        closed = ~exists[text] | (step_no < begin_step[text])
        if excluded is not None:
            extra = np.flatnonzero(step_no == begin_step[text])
            gone[extra] += excluded[text[extra]]
            node = lat.source[steps.edge[at[extra]]]
            closed[extra] |= lat.first_edge[node + 1] - lat.first_edge[node] <= 1 + self._taken[text[extra]]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            mu = np.where(closed, -np.inf, prefix[at] + np.log(np.maximum(1 - gone, 0)))
            noise = -np.log(uniform(key[text], (1 << 41) + r, step_no))
            near = -np.log(np.exp(-value[text]) + np.exp(-mu) * noise)
            t[at] = np.where(mu > -600, near, np.where(np.isneginf(mu), -np.inf, mu - np.log(noise)))

    def _next(self, lat, pool, which, exists, key, text_of, serial, root, start, draw, n):
        """Paths of the next sample: the chosen set's prefix, another edge, then ancestral draws to the text's end."""
        heads_t, heads_e, heads_o = [], [], []
        cut, excl, taken = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
        occ_at, node_at = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        for j, p in enumerate(pool):
            mine = np.flatnonzero(exists & (which == j))
            if not len(mine):
                continue
            at = p.take(mine)  # global step index of the chosen set of each of these texts
            s = p.steps
            local = at - s.begin[mine]
            same = p.excluded is not None
            prior = np.where(local == p.begin_step[mine], p.excluded[mine], 0.0) if same else np.zeros(len(mine))
            ptaken = np.where(local == p.begin_step[mine], p.taken[mine], 0) if same else np.zeros(len(mine), np.int64)
            # prefix steps
            length = local
            src = np.repeat(s.begin[mine], length) + (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))
            heads_t.append(np.repeat(mine, length))
            heads_e.append(s.edge[src])
            heads_o.append(s.occ[src])
            old = s.edge[at]
            node = lat.source[old]
            banned = [[int(x)] for x in old]
            for i, m in enumerate(mine):  # edges already taken out at this very step by earlier samples of the chain
                if same and local[i] == p.begin_step[m]:
                    banned[i] += self._banned[m]
            new = np.empty(len(mine), np.int64)
            u = uniform(key[mine], (1 << 42) + draw, local)
            for i, m in enumerate(mine):
                lo, hi = lat.first_edge[node[i]], lat.first_edge[node[i] + 1]
                edges = np.array([x for x in range(lo, hi) if x not in banned[i]])
                q = np.exp(lat.logq[edges])
                c = np.cumsum(q)
                new[i] = edges[min(int(np.searchsorted(c, u[i] * c[-1], "right")), len(edges) - 1)]
                self._banned_next[int(m)] = banned[i]
            heads_t.append(mine)
            heads_e.append(new)
            heads_o.append(s.occ[at])
            cut[mine], excl[mine], taken[mine] = local, prior + np.exp(lat.logq[old]), ptaken + 1
            occ_at[mine], node_at[mine] = s.occ[at], lat.target[new]
        self._banned, self._banned_next = self._banned_next, {}
        # the rest of the word where the path turned, and all later words
        turned = np.flatnonzero(occ_at >= 0)
        later = np.repeat(turned, start[turned + 1] - occ_at[turned] - 1)
        width = start[turned + 1] - occ_at[turned] - 1
        later_occ = np.repeat(occ_at[turned] + 1, width) + (np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width))
        occ = np.concatenate([occ_at[turned], later_occ])
        o, e = descend(lat, occ, np.concatenate([node_at[turned], root[later_occ]]), key[np.concatenate([turned, later])], serial[occ], draw)
        t = np.concatenate([*heads_t, text_of[occ[o]]])
        oc = np.concatenate([*heads_o, occ[o]])
        ed = np.concatenate([*heads_e, e])
        order = np.lexsort((np.arange(len(t)), oc))  # within a word: prefix, turn, then the rest, as they were added
        return _Steps(t[order], oc[order], ed[order], n), cut, excl, taken

    _taken = None
    _banned: dict = {}
    _banned_next: dict = {}


@dataclass
class _Steps:
    text: np.ndarray
    occ: np.ndarray
    edge: np.ndarray
    n: int

    def __post_init__(self):
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(self.text, minlength=self.n)))).astype(np.int64)


def _top(steps: _Steps, values: np.ndarray) -> np.ndarray:
    """The largest value of each text."""
    out = np.full(steps.n, -np.inf)
    full = np.flatnonzero(np.diff(steps.begin) > 0)
    if len(full):
        out[full] = np.maximum.reduceat(values, steps.begin[full])
    return out


class _Pool:
    """The open sets along one sample's path: their largest perturbed values, by step."""

    def __init__(self, steps: _Steps, values: np.ndarray, excluded, begin_step, taken):
        self.steps, self.values, self.excluded, self.begin_step, self.taken = steps, values, excluded, begin_step, taken

    def top(self) -> np.ndarray:
        return _top(self.steps, self.values)

    def take(self, texts: np.ndarray) -> np.ndarray:
        """Step of the largest value of each text; the set is closed."""
        at = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            a, b = self.steps.begin[t], self.steps.begin[t + 1]
            at[i] = a + int(self.values[a:b].argmax())
        self.values[at] = -np.inf
        return at


def path_ids(lat: Lattices, edges: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, where each text's begin): byte fallbacks are written out."""
    piece = lat.piece[edges]
    low = piece < 0
    if not low.any():
        return piece, begin
    width = np.ones(len(piece), np.int64)
    sizes = np.array([len(f) for f in lat.fallback])
    width[low] = sizes[-1 - piece[low]]
    at = np.concatenate(([0], np.cumsum(width)))
    out = np.repeat(piece, width)
    flat, first = np.concatenate(lat.fallback), np.concatenate(([0], np.cumsum(sizes)))
    w = width[low]
    inside = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
    out[np.repeat(at[:-1][low], w) + inside] = flat[np.repeat(first[-1 - piece[low]], w) + inside]
    return out, at[begin]


def decode_ids(ids, text_of: list[bytes]) -> str:
    """The text of ids: pieces and bytes joined, less the dummy space."""
    out = b"".join(map(text_of.__getitem__, ids))
    return out[1:].decode("utf-8", "surrogatepass") if out[:1] == b" " else out.decode("utf-8", "surrogatepass")


def log_inclusion(log_prob: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """log P(the segmentation's perturbed value exceeds the threshold); 0 where nothing was left out."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        x = log_prob - threshold
        return np.where(np.isneginf(threshold), 0.0, np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 30))))))


def sampled(batch: pa.RecordBatch, sampler: Sampler, k: int, most_chars: int = 500_000) -> Iterator[tuple[int, str, list]]:
    """(row, text, samples as (ids, log probability, perturbed value, log inclusion)) for rows with a text, some at a time."""
    upto = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    to = 0
    while to < batch.num_rows:
        at = to
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most_chars, "right")))
        part = batch.slice(at, to - at)
        texts, ids = part.column("text").to_pylist(), part.column("doc_id").to_pylist()
        rows = [i for i, t in enumerate(texts) if t is not None]
        if not rows:
            continue
        samples, lat, threshold = sampler.sample([texts[i] for i in rows], [ids[i] for i in rows], k)
        flat = [path_ids(lat, s.edge, s.begin) for s in samples]
        score = [log_inclusion(s.log_prob, threshold) for s in samples]
        for j, i in enumerate(rows):
            out = []
            for s, (seq, begin), inc in zip(samples, flat, score, strict=True):
                if s.exists[j]:
                    out.append((seq[begin[j] : begin[j + 1]], float(s.log_prob[j]), float(s.perturbed[j]), float(inc[j])))
            yield at + i, texts[i], out
        del samples, lat, threshold, flat, score
        give_back()


SAMPLE = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("log_prob", T.DoubleType()), T.StructField("perturbed", T.DoubleType()), T.StructField("log_inclusion", T.DoubleType())])


def encode(docs: DataFrame, model: PieceModel, k: int = 2) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``samples``: array of (ids, log_prob, perturbed, log_inclusion), best perturbed first."""

    def make():
        sampler = Sampler(model)

        def step(batch):
            rows: list = [None] * batch.num_rows
            for i, _, found in sampled(batch, sampler, k):
                rows[i] = [{"ids": x.tolist(), "log_prob": p, "perturbed": g, "log_inclusion": c} for x, p, g, c in found]
            kind = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64())]))
            return [pa.array(rows, kind)]

        return step

    return with_arrow(docs, make, [T.StructField("samples", T.ArrayType(SAMPLE), True)])


def decode(rows: DataFrame, model: PieceModel) -> DataFrame:
    """``rows`` with ``decoded``: the text of the column ``ids`` (array of int); null for null."""

    def make():
        text_of = Vocabulary(model).text_of

        def step(batch):
            return [pa.array([None if x is None else decode_ids(x, text_of) for x in batch.column("ids").to_pylist()], pa.string())]

        return step

    return with_arrow(rows, make, [T.StructField("decoded", T.StringType(), True)])


def digests(docs: DataFrame, model: PieceModel, k: int = 2) -> DataFrame:
    """(doc_id, n_samples, n_pieces, ids_md5, log_prob, log_inclusion - arrays by sample -, distinct, round_trip)."""

    def run(batches):
        sampler = Sampler(model)
        text_of = sampler.v.text_of
        for b in batches:
            doc = b.column("doc_id").to_pylist()
            rows = [(d, 0, None, None, None, None, None, None) for d in doc]
            for i, text, found in sampled(b, sampler, k):
                md5 = [hashlib.md5(x.astype("<i4").tobytes()).hexdigest() for x, *_ in found]
                ok = all(decode_ids(x.tolist(), text_of) == text for x, *_ in found)
                rows[i] = (doc[i], len(found), [len(x) for x, *_ in found], md5, [round(p, 6) for _, p, _, _ in found], [round(c, 6) for *_, c in found], len(set(md5)) == len(md5), ok)
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.bool_(), pa.bool_()]
            names = ["doc_id", "n_samples", "n_pieces", "ids_md5", "log_prob", "log_inclusion", "all_distinct", "round_trip"]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=names)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_samples int, n_pieces array<int>, ids_md5 array<string>, log_prob array<double>, log_inclusion array<double>, all_distinct boolean, round_trip boolean")
