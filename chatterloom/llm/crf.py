"""A skip-chain conditional random field over tokens, in numpy.

Labels of neighbouring tokens share transition potentials; distant tokens that repeat or
resemble one another share skip potentials, one table of label pairs for repeats and one for
resemblances. Marginals come from loopy message passing: the chain is summed exactly by
forward-backward, messages along the skip edges are added to the token potentials, and both
alternate until the messages settle, so that evidence at one mention of a name reaches all
the others. All weights, those of the skip edges included, are fitted together by the
conditional likelihood with the edges in place. All texts of a batch are summed together,
padded to a common length.
"""

from __future__ import annotations

import base64
import json
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np

from chatterloom.llm.tokens import default_ranks

LABELS = ["O", "email", "phone", "id_number", "address", "name"]
L = len(LABELS)
#: Kinds of skip edges: the same word but for case, and words that resemble one another.
EDGES = ["same", "like"]
#: Change of a message, in logs, below which it is settled, and rounds allowed beyond one an edge.
SETTLED = 1e-3
SWINGS = 200
#: Padded cells (texts times tokens) summed at once.
CELLS = 60_000
#: Words of a public vocabulary up to this rank say nothing by being repeated.
COMMON_RANK = 12_000
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|\n|[^\w\s]|_")
_BOUND = "\x00"
_TINY = 1e-280


@lru_cache(maxsize=2)
def word_ranks(names: tuple[str, ...] = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")) -> dict[bytes, int]:
    """Ranks of whole words in public tokenizers' vocabularies, which grow as words get rarer; of
    two vocabularies (one English, one of many languages) the lower."""
    out: dict[bytes, int] = {}
    for name in names:
        with open(default_ranks(name), "rb") as f:
            for line in f:
                a, r = line.split()
                w = base64.b64decode(a)
                if len(w) > 1 and w[:1] == b" ":
                    out[w[1:]] = min(int(r), out.get(w[1:], 1 << 30))
    return out


def shape(w: str) -> str:
    if w.isdigit():
        return "d" + str(min(len(w), 12))
    if w[0].isalpha():
        if len(w) == 1:
            return "X" if w.isupper() else "x"
        return "XX" if w.isupper() else "Xx" if w[0].isupper() else "xx"
    return w


def rarity(w: str) -> tuple[str, str]:
    """How rare a word is in small letters, and how much commoner it is with a capital."""
    ranks = word_ranks()
    low, cap = ranks.get(w.lower().encode()), ranks.get(w.capitalize().encode())
    rare = "4" if low is None else "0" if low < 1500 else "1" if low < 6000 else "2" if low < 16000 else "3"
    if low is None or cap is None:
        return rare, "?" if cap is None and low is None else "C" if low is None else "c"
    return rare, "C" if 2 * cap < low else "c" if cap > 1.3 * low else "="


def own_features(w: str) -> list[str]:
    low, s = w.lower(), shape(w)
    if w.isdigit():
        return ["b", "s=" + s, "w=" + w if len(w) < 5 else "w=#", "z=" + str(w[0] == "0") + s]
    out = ["b", "s=" + s, "w=" + low]
    if w[0].isalpha() and len(w) > 1:
        rare, proper = rarity(w)
        out += ["r=" + rare + proper, "rs=" + rare + proper + s, "f2=" + low[-2:], "n=" + str(min(len(w), 12))]
        if len(w) > 3:
            out += ["f3=" + low[-3:], "sf=" + s + low[-2:], "p3=" + low[:3]]
        if len(w) > 5:
            out.append("f4=" + low[-4:])
        if not low.isascii():
            out.append("na=" + s)
    return out


def near_features(w: str, at: str) -> list[str]:
    if w == _BOUND:
        return [at + "=$"]
    out = [at + "=" + ("#" if w.isdigit() else w.lower()), at + "s=" + shape(w)]
    if w[0].isalpha() and len(w) > 1:
        rare, proper = rarity(w)
        out.append(at + "r=" + rare + proper + shape(w))
    return out


OFFSETS = {-3: "l3", -2: "l2", -1: "l1", 1: "r1", 2: "r2", 3: "r3"}


def coarse(w: str) -> str:
    """What of a word its neighbours are crossed with."""
    if w == _BOUND:
        return "$"
    if not w[0].isalpha() or len(w) == 1:
        return shape(w)
    rare, proper = rarity(w)
    return shape(w) + rare + proper


class Model:
    """Weights by feature name; matrices by word are built as words turn up."""

    def __init__(self, weights: dict[str, list[float]], trans: list[list[float]], skip: dict[str, list[list[float]]]):
        self.w = {k: np.asarray(v) for k, v in weights.items()}
        self.trans = np.asarray(trans, dtype=float)
        self.skip = np.stack([np.asarray(skip[k], dtype=float) for k in EDGES])
        self.zero = np.zeros(L)
        self.ids: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.kinds: list[int] = []
        self.kind_names: dict[str, int] = {}
        self.links: list[bool] = []

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        return cls(d["weights"], d["transitions"], d["skip"])

    def with_skip(self, factor: float) -> Model:
        """The same model, its skip potentials multiplied; 0 leaves the plain chain."""
        return Model(self.w, self.trans, dict(zip(EDGES, self.skip * factor)))

    def _sum(self, names: list[str]) -> np.ndarray:
        return sum((self.w[n] for n in names if n in self.w), self.zero)

    def _id(self, w: str) -> int:
        i = self.ids.get(w)
        if i is None:
            i = self.ids[w] = len(self.rows)
            own = self._sum(own_features(w)) if w != _BOUND else self.zero
            self.rows.append(np.stack([own, *(self._sum(near_features(w, a)) for a in OFFSETS.values())]))
            self.kinds.append(self.kind_names.setdefault(coarse(w), len(self.kind_names)))
        return i

    def emissions(self, docs: list[list[str]], marks: list[list[str]]) -> list[np.ndarray]:
        """Token potentials; ``marks`` has the pattern each token lies in, or ``""``."""
        if len(self.ids) > 400_000:  # a worker that has seen very many words starts over
            self.__init__(self.w, self.trans, dict(zip(EDGES, self.skip)))
        pad = [_BOUND] * max(OFFSETS)
        flat = list(pad)
        starts = []
        for d in docs:
            starts.append(len(flat))
            flat += d
            flat += pad
        ids = np.fromiter((self._id(w) for w in flat), dtype=np.int64, count=len(flat))
        rows = np.stack(self.rows)
        e = rows[ids, 0].copy()
        for k, off in enumerate(OFFSETS, start=1):
            src = rows[ids, k]
            if off < 0:
                e[-off:] += src[:off]
            else:
                e[:-off] += src[off:]
        kinds = np.asarray(self.kinds)[ids]
        names = {v: k for k, v in self.kind_names.items()}
        words = list(self.ids)
        for off, tag in ((-1, "cl"), (1, "cr")):
            other = np.roll(ids, -off)
            keys, inv = np.unique(kinds * len(words) + other, return_inverse=True)
            table = np.stack([self._sum([f"{tag}={names[k // len(words)]}|{words[k % len(words)].lower()}"]) for k in keys])
            e += table[inv]
        out = []
        for d, m, s in zip(docs, marks, starts):
            x = e[s : s + len(d)]
            for i, p in enumerate(m):
                if p:
                    x[i] += self._sum(["m=" + p, f"ms={p}|{shape(d[i])}"])
            out.append(x)
        return out


@lru_cache(maxsize=200_000)
def _link_key(w: str) -> tuple[str, str | None] | None:
    """What a word is linked by: itself, and for words of five letters or more its first five.

    Signs, single characters and words of a public vocabulary's commonest part, unless they have
    a capital and are commoner with one, say nothing by being repeated.
    """
    if len(w) < 2 or not (w[0].isalpha() or w.isdigit()):
        return None
    low = re.sub("['’]s?$", "", w.lower()) or w.lower()
    if w[0].isalpha():
        rank = word_ranks().get(low.encode())
        if rank is not None and rank < COMMON_RANK and (w[0].islower() or rarity(w)[1] != "C"):
            return None
    return low, low[:5] + "*" if w[0].isalpha() and len(low) > 4 else None


def skip_edges(doc: list[str]) -> list[tuple[int, int, int]]:
    """Each word and the last earlier one that repeats (kind 0) or else resembles it (kind 1:
    the same first five letters). A chain of nearest repeats, so edges are linear in the text."""
    same: dict[str, int] = {}
    like: dict[str, int] = {}
    out = []
    for i, w in enumerate(doc):
        key = _link_key(w)
        if key is None:
            continue
        j = same.get(key[0])
        if j is None and key[1] is not None:
            j = like.get(key[1])
            if j is not None and j < i - 1:
                out.append((j, i, 1))
        elif j is not None and j < i - 1:
            out.append((j, i, 0))
        same[key[0]] = i
        if key[1] is not None:
            like[key[1]] = i
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def chain(e: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label marginals of padded texts (B, T, L), and the scaled forward and backward sums.

    Sums are kept as probabilities, scaled at every token, so that a step is one small product.
    """
    n, t, _ = e.shape
    a = np.exp(trans - trans.max())
    x = np.exp(e - e.max(axis=2, keepdims=True)) + _TINY
    f, b = np.empty_like(e), np.ones_like(e)
    f[:, 0] = x[:, 0] / x[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        v = (f[:, i - 1] @ a) * x[:, i]
        v /= v.sum(axis=1, keepdims=True)
        f[:, i] = np.where(mask[:, i, None], v, f[:, i - 1])
    at = a.T
    for i in range(t - 2, -1, -1):
        v = (x[:, i + 1] * b[:, i + 1]) @ at
        v /= v.sum(axis=1, keepdims=True)
        b[:, i] = np.where(mask[:, i + 1, None], v, 1.0)
    m = f * b
    m /= m.sum(axis=2, keepdims=True)
    return m, f, b


def marginals(model: Model, docs: list[list[str]], marks: list[list[str]]) -> list[np.ndarray]:
    """Probability of each label of each token of each text."""
    out: list[np.ndarray] = [np.zeros((0, L))] * len(docs)
    order = sorted((i for i, d in enumerate(docs) if d), key=lambda i: len(docs[i]))
    e = model.emissions([docs[i] for i in order], [marks[i] for i in order])
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * len(docs[order[stop]]) <= CELLS:
            stop += 1
        part = order[at:stop]
        for i, p in zip(part, _batch(model, [docs[i] for i in part], e[at:stop])):
            out[i] = p
        at = stop
    return out


def _pad(es: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(x) for x in es)
    e, mask = np.zeros((len(es), t, L)), np.zeros((len(es), t), dtype=bool)
    for k, x in enumerate(es):
        e[k, : len(x)] = x
        mask[k, : len(x)] = True
    return e, mask


class Loop:
    """Messages along the skip edges of padded texts; ``edges`` has one list a text, not empty."""

    def __init__(self, e: np.ndarray, mask: np.ndarray, edges: list[list[tuple[int, int, int]]]):
        self.e, self.mask = e, mask
        flat = np.array([(r, *x) for r, es in enumerate(edges) for x in es], dtype=np.int64)
        self.row, self.i, self.j, self.kind = flat.T
        self.per_text = np.bincount(self.row, minlength=len(edges))
        self.to_i, self.to_j = np.zeros((len(flat), L)), np.zeros((len(flat), L))

    def node(self) -> np.ndarray:
        """Token potentials with the messages added."""
        node = self.e.copy()
        np.add.at(node, (self.row, self.i), self.to_i)
        np.add.at(node, (self.row, self.j), self.to_j)
        return node

    def settle(self, trans: np.ndarray, skip: np.ndarray, most: int | None = None) -> None:
        """Messages passed until those of each text settle, or for ``most`` rounds."""
        moving, rounds = np.ones(len(self.e), dtype=bool), 0
        while moving.any() and (most is None or rounds < most):
            on = moving[self.row]
            row = (np.cumsum(moving) - 1)[self.row[on]]
            i, j, psi, old_i, old_j = self.i[on], self.j[on], skip[self.kind[on]], self.to_i[on], self.to_j[on]
            node = self.e[moving]
            np.add.at(node, (row, i), old_i)
            np.add.at(node, (row, j), old_j)
            m = np.log(chain(node, self.mask[moving], trans)[0] + _TINY)
            new_j = _lse((m[row, i] - old_i)[:, :, None] + psi, 1)
            new_i = _lse((m[row, j] - old_j)[:, None, :] + psi, 2)
            new_i -= new_i.max(axis=1, keepdims=True)
            new_j -= new_j.max(axis=1, keepdims=True)
            change = np.zeros(len(self.e))
            np.maximum.at(change, self.row[on], np.maximum(np.abs(new_i - old_i), np.abs(new_j - old_j)).max(axis=1))
            # half steps once evidence could have passed every edge: what still swings then is a loop
            step = np.where(rounds < self.per_text[self.row[on]] + 4, 1.0, 0.5)[:, None]
            self.to_i[on], self.to_j[on] = old_i + step * (new_i - old_i), old_j + step * (new_j - old_j)
            rounds += 1
            # a text leaves once its messages are settled, so its result is the same in any batch
            moving = moving & (change > SETTLED) & (rounds < self.per_text + SWINGS)

    def beliefs(self, m: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Joint label probabilities of both ends of each edge, for marginals ``m``."""
        lm = np.log(m + _TINY)
        z = (lm[self.row, self.i] - self.to_i)[:, :, None] + (lm[self.row, self.j] - self.to_j)[:, None, :] + skip[self.kind]
        z = np.exp(z - z.max(axis=(1, 2), keepdims=True))
        return z / z.sum(axis=(1, 2), keepdims=True)


def _batch(model: Model, docs: list[list[str]], es: list[np.ndarray]) -> list[np.ndarray]:
    e, mask = _pad(es)
    edges = [skip_edges(d) for d in docs] if model.skip.any() else [[] for _ in docs]
    linked = [k for k, s in enumerate(edges) if s]
    if linked:
        loop = Loop(e[linked], mask[linked], [edges[k] for k in linked])
        loop.settle(model.trans, model.skip)
        e[linked] = loop.node()
    m = chain(e, mask, model.trans)[0]
    return [m[k, : len(d)] for k, d in enumerate(docs)]


def fit(
    docs: list[list[str]], marks: list[list[str]], gold: list[list[int]], known: frozenset[str],
    epochs: int = 5, rate: float = 0.15, l2: float = 1e-5, least: int = 5, seed: int = 7,
) -> dict:
    """Weights that maximise the conditional likelihood of ``gold``, by adaptive gradients.

    Only words in ``known`` may be features by themselves. The skip potentials are fitted with
    the rest: their gradient is the observed minus the believed label pairs of the edges.
    """
    rng = np.random.default_rng(seed)
    word_at = {"w", *OFFSETS.values()}

    def allowed(x: str) -> bool:
        tag, _, value = x.partition("=")
        if tag in word_at or tag in ("cl", "cr"):
            word = value.rpartition("|")[2] if tag in ("cl", "cr") else value
            return not word[:1].isalpha() or word in known
        return True

    def feats(d: list[str], m: list[str]) -> list[list[str]]:
        edge = max(OFFSETS)
        p = [_BOUND] * edge + d + [_BOUND] * edge
        rows = []
        for i, w in enumerate(d):
            fs = own_features(w)
            for off, tag in OFFSETS.items():
                fs += near_features(p[i + edge + off], tag)
            for off, tag in ((-1, "cl"), (1, "cr")):
                fs.append(f"{tag}={coarse(w)}|{p[i + edge + off].lower()}")
            if m[i]:
                fs += ["m=" + m[i], f"ms={m[i]}|{shape(w)}"]
            rows.append(fs)
        return rows

    count: dict[str, int] = defaultdict(int)
    raw = [feats(d, m) for d, m in zip(docs, marks)]
    for rows in raw:
        for fs in rows:
            for x in fs:
                count[x] += 1
    names = {x: k for k, x in enumerate(x for x, c in count.items() if c >= least and allowed(x))}
    ids = [[np.array([names[x] for x in fs if x in names], dtype=np.int64) for fs in rows] for rows in raw]
    del raw
    edges = [skip_edges(d) for d in docs]
    w, trans, skip = np.zeros((len(names), L)), np.zeros((L, L)), np.zeros((len(EDGES), L, L))
    gw, gt, gs = np.full_like(w, 1e-6), np.full_like(trans, 1e-6), np.full_like(skip, 1e-2)
    order = np.array([i for i, d in enumerate(docs) if d])
    for epoch in range(epochs):
        rng.shuffle(order)
        for s in range(0, len(order), 128):
            part = order[s : s + 128]
            flat, lens, rows = [], [], []
            for i in part:
                rows.append(len(ids[i]))
                for x in ids[i]:
                    flat.append(x)
                    lens.append(len(x))
            seg = np.concatenate([[0], np.cumsum(lens)[:-1]])
            fid = np.concatenate(flat)
            ev = np.add.reduceat(w[fid], seg)
            e, mask = _pad(np.split(ev, np.cumsum(rows)[:-1]))
            linked = [k for k, i in enumerate(part) if edges[i]] if epoch else []
            loop = None
            if linked:
                loop = Loop(e[linked], mask[linked], [edges[part[k]] for k in linked])
                loop.settle(trans, skip, most=6)
                e[linked] = loop.node()
            m, f, b = chain(e, mask, trans)
            if loop is not None:
                got = -loop.beliefs(m[linked], skip)
                for k, (r, i, j) in enumerate(zip(loop.row, loop.i, loop.j)):
                    y = gold[part[linked[r]]]
                    got[k, y[i], y[j]] += 1
                grad = np.zeros_like(skip)
                np.add.at(grad, loop.kind, got)
                grad = (grad + grad.transpose(0, 2, 1)) / 2 - 0.02 * skip
                grad[:, 0, 0] = 0.0  # the reference: agreeing on nothing is no evidence
                gs += grad**2
                skip += rate * grad / np.sqrt(gs)
            y = np.zeros(mask.shape, dtype=np.int64)
            for k, i in enumerate(part):
                y[k, : rows[k]] = gold[i]
            g = -m
            np.put_along_axis(g, y[:, :, None], np.take_along_axis(g, y[:, :, None], 2) + 1, 2)
            ge = g[mask]
            x = np.exp(e - e.max(axis=2, keepdims=True)) * b
            pair = f[:, :-1, :, None] * np.exp(trans - trans.max())[None, None] * x[:, 1:, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            both = mask[:, 1:]
            grad_t = -pair[both].sum(axis=0)
            np.add.at(grad_t, (y[:, :-1][both], y[:, 1:][both]), 1)
            tok = np.repeat(np.arange(len(lens)), lens)
            uniq, inv = np.unique(fid, return_inverse=True)
            gu = np.stack([np.bincount(inv, ge[tok, c], len(uniq)) for c in range(L)], 1) - l2 * len(part) * w[uniq]
            gw[uniq] += gu**2
            w[uniq] += rate * gu / np.sqrt(gw[uniq])
            gt += grad_t**2
            trans += rate * grad_t / np.sqrt(gt)
    keep = {n: [round(float(v), 2) for v in w[k]] for n, k in names.items() if np.abs(w[k]).max() > 0.2}
    return {"weights": keep, "transitions": np.round(trans, 4).tolist(), "skip": {k: np.round(skip[t], 4).tolist() for t, k in enumerate(EDGES)}}
