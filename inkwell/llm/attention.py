"""A small causal self-attention model over subword ids, trained and applied in numpy and the graphs of kernels.

An id's probability is that of its class given the context, times that of the id in its class given the id before. The
first factor is the attention model: its logits start from the log share of classes after the id before, and attention
over the ids before moves them. The second comes from counts of pairs of ids, smoothed towards the counts of single ids.
All counts are those of the whole training corpus. Texts are cut into blocks of STEP positions. The window of a block is
the block before and itself, so windows overlap, each position is scored once, and no position sees a later one.
"""

from __future__ import annotations

import ctypes
import io
from collections.abc import Iterator

import numpy as np

from inkwell.llm.kernels import kernel
from inkwell.llm.lookup import Lookup

STEP = 16
CLASSES, SINGLE = 64, 40
OWN = 448  # of the commonest ids have an embedding of their own, others that of their class
WIDTH, HIDDEN = 16, 32
BATCH, STEPS, RATE = 384, 500, 0.01
SMOOTH, AFTER, INSIDE = 0.1, 5.0, 20.0  # added to counts of ids, of classes after an id, of ids in a class after an id
PASS_RATE, SHARE = 0.003, 1.0  # of the pass over a shard: the rate, and the chance of each run of windows (1: all take part)
PASS_BATCH, RUN = 128, 16  # windows of a step, and neighbouring ones that it takes together, as they share their keys
SIDE = 257  # marks of a neighbour: the 256 commonest ids, and all others
SLICE = 256  # windows scored at a time, so that their arrays stay in a core's cache
LOOKED = 2048  # windows whose pairs of ids are looked up at a time
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CAUSAL = np.where(np.arange(2 * STEP)[None, :] <= np.arange(STEP)[:, None] + STEP, 0.0, -1e9).astype(np.float32)
PARTS = ("embed", "wq", "wk", "wv", "bias", "w1", "w2", "b1", "wo", "b")


_SCALE = np.float32(WIDTH**-0.5)


def layout(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of texts: inputs and goals (blocks x STEP), which blocks are scored, and each block's text.

    A text's inputs are ``end`` and its ids, its goals its ids and ``end``. A block of -1 goes before each text; -1 fills
    the last block.
    """
    length = np.diff(bounds) + 1
    blocks = -(-length // STEP) + 1
    first = np.cumsum(blocks) - blocks
    inputs = np.full(int(blocks.sum()) * STEP, -1, np.int32)
    goals = inputs.copy()
    start = (first + 1) * STEP
    inputs[start] = end
    goals[start + length - 1] = end
    place = np.arange(len(ids)) + np.repeat(start - bounds[:-1], np.diff(bounds))
    inputs[place + 1] = ids
    goals[place] = ids
    scored = np.ones(len(inputs) // STEP, bool)
    scored[first] = False
    return inputs.reshape(-1, STEP), goals.reshape(-1, STEP), scored, np.repeat(np.arange(len(length)), blocks)


def ranked(counts: np.ndarray, end: int) -> np.ndarray:
    """Ids from the commonest on, without ``end``."""
    rank = np.lexsort((np.arange(len(counts)), -counts))
    return rank[rank != end]


def neighbour_cells(before: np.ndarray, after: np.ndarray, rank: np.ndarray, size: int) -> np.ndarray:
    """Cells id * 2 * SIDE + mark: each id with the mark of its left neighbour, and (from SIDE on) of its right one."""
    marks = np.full(size, SIDE - 1)
    marks[rank[: SIDE - 1]] = np.arange(min(SIDE - 1, len(rank)))
    return np.concatenate([after.astype(np.int64) * (2 * SIDE) + marks[before], before.astype(np.int64) * (2 * SIDE) + SIDE + marks[after]])


def classes(counts: np.ndarray, cells: np.ndarray, times: np.ndarray, end: int) -> np.ndarray:
    """Class of each id: the commonest have their own, others are clustered by their neighbours, given as distinct cells.

    The last class is that of ids met less than 5 times; ``end`` has the first.
    """
    rank = ranked(counts, end)
    out = np.full(len(counts), CLASSES - 1)
    out[end] = 0
    out[rank[: SINGLE - 1]] = np.arange(1, SINGLE)
    owner, mark = np.divmod(cells, 2 * SIDE)
    often = np.bincount(owner[mark < SIDE], weights=times[mark < SIDE], minlength=len(counts)) >= 5
    free = np.flatnonzero(often & (out == CLASSES - 1))
    groups = CLASSES - 1 - SINGLE
    if len(free) > groups:
        row = np.full(len(counts), -1)
        row[free] = np.arange(len(free))
        use = row[owner] >= 0
        seen = np.zeros((len(free), 2 * SIDE), np.float32)
        seen[row[owner[use]], mark[use]] = times[use]
        seen /= np.maximum(seen.sum(axis=1, keepdims=True), 1)
        np.sqrt(seen, out=seen)
        centre = seen[np.linspace(0, len(free) - 1, groups).astype(int)]
        for _ in range(8):
            own = (seen @ centre.T).argmax(axis=1)
            member = np.zeros((groups, len(free)), np.float32)
            member[own, np.arange(len(free))] = 1
            sums = member @ seen
            centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)
        out[free] = SINGLE + own
    else:
        out[free] = SINGLE + np.arange(len(free))
    return out


def pair_key(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A 64-bit key of a pair of ids, different for different pairs and mixed in its high bits."""
    return ((before.astype(np.uint64) << np.uint64(32)) + after.astype(np.uint64) + np.uint64(1)) * _ODD


def untrained(counts: np.ndarray, kind: np.ndarray, follow: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], end: int) -> Model:
    """A model whose attention part is still random, with zero weight on its logits.

    ``counts`` are those of ids, ``kind`` gives their classes, ``follow`` (ids x CLASSES) counts classes after each id,
    ``pairs`` (before, after, number) are the pairs of ids that are kept.
    """
    smooth = counts + SMOOTH
    inside = np.log(smooth / np.bincount(kind, weights=smooth, minlength=CLASSES)[kind])
    seen = np.flatnonzero(follow.sum(axis=1))
    row = np.zeros(len(counts), np.int32)  # 0: an id after which nothing was counted
    row[seen] = np.arange(1, len(seen) + 1)
    share = (follow.sum(axis=0) + 1) / (follow.sum() + CLASSES)
    follow = np.concatenate([np.zeros((1, CLASSES)), follow[seen]])
    logits = np.log((follow + AFTER * share) / (follow.sum(axis=1, keepdims=True) + AFTER))
    a, b, n = pairs
    kept = np.bincount(row[a].astype(np.int64) * CLASSES + kind[b], weights=n, minlength=follow.size).reshape(follow.shape)
    after = np.log((n + INSIDE * np.exp(inside[b])) / (kept[row[a], kind[b]] + INSIDE)) if len(a) else np.zeros(1)
    own = np.full(len(counts), -1)
    often = ranked(counts, end)[:OWN]
    own[often] = np.arange(len(often))
    look = np.where(own >= 0, own, OWN + kind)
    rng = np.random.default_rng(11)
    f = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
    return Model({"kind": kind.astype(np.int32), "look": look.astype(np.int32), "row": row, "inside": inside, "logits": logits.astype(np.float32), "kept": kept.astype(np.float32), "pair": pair_key(a, b), "after": after, "embed": rng.normal(0, 1, (OWN + CLASSES, WIDTH)).astype(np.float32), "wq": f(WIDTH, WIDTH), "wk": f(WIDTH, WIDTH), "wv": f(WIDTH, WIDTH), "bias": np.zeros((STEP, 2 * STEP), np.float32), "w1": f(WIDTH, HIDDEN), "w2": f(WIDTH, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "wo": np.zeros((HIDDEN, CLASSES), np.float32), "b": np.zeros(CLASSES, np.float32)})


def keep_freed_memory() -> None:
    """Where malloc is glibc's, up to 32 MB that arrays free stay in the process, so the next ones need no new pages."""
    tune = getattr(ctypes.CDLL(None), "mallopt", None)
    if tune is not None:
        tune(-3, 8 << 20)  # M_MMAP_THRESHOLD
        tune(-1, 32 << 20)  # M_TRIM_THRESHOLD


def _windows(blocks: np.ndarray) -> np.ndarray:
    """Each block of a run with the one before, as views: runs x (n + 1) x STEP -> runs x n x 2 STEP."""
    runs, n, _ = blocks.shape
    return np.lib.stride_tricks.as_strided(blocks, (runs, n - 1, 2 * STEP), blocks.strides, writeable=False)


class Model:
    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.__dict__ |= arrays

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: v for k, v in self.__dict__.items() if isinstance(v, np.ndarray)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Model:
        with np.load(io.BytesIO(raw)) as held:
            return cls({k: held[k] for k in held.files})

    def prepare(self) -> Model:
        """Tables of the weights by embedding, which serve all windows."""
        self.q, self.x1 = self.embed @ (self.wq * _SCALE), self.embed @ self.w1 + self.b1
        self.k, self.v = self.embed @ self.wk, self.embed @ self.wv
        self.bent = self.bias + _CAUSAL
        return self

    def forward(self, before: np.ndarray, now: np.ndarray, row: np.ndarray) -> tuple:
        """Logits of the classes that follow ``now``: blocks of embeddings' numbers, -1 where nothing stands; ``row`` of the table of logits."""
        logits, rest = self.run_logits(np.stack([before, now], axis=1), row[:, None])
        return logits.reshape(*now.shape, CLASSES), rest

    def run_logits(self, blocks: np.ndarray, row: np.ndarray) -> tuple:
        """Logits (positions x CLASSES) after all blocks but the first of each run, and what gradients need.

        ``blocks`` are as in ``run_hidden``; ``row`` (runs x n x STEP) holds places in the table of logits.
        """
        rest = self.run_hidden(blocks)
        logits = rest[-1] @ self.wo
        logits += self.b
        logits += self.logits.take(row.ravel(), axis=0)
        return logits, rest

    def run_hidden(self, blocks: np.ndarray) -> tuple:
        """The hidden layer (positions x HIDDEN) in all blocks but the first of each run, and before it what gradients need.

        ``blocks`` (runs x (n + 1) x STEP) holds embeddings' numbers. -1 stands in whole blocks, or after a text's end,
        where no position of the text looks.
        """
        look = np.maximum(blocks, 0, dtype=np.intp)
        asked, met = look[:, 1:].reshape(-1, STEP), _windows(look).reshape(-1, 2 * STEP)
        q, k, v, x1 = self.q.take(asked, axis=0), self.k.take(met, axis=0), self.v.take(met, axis=0), self.x1.take(asked, axis=0)
        mask = np.zeros((len(asked), 1, 2 * STEP), np.float32)
        mask[blocks[:, :-1, 0].ravel() < 0, :, :STEP] = -1e9
        share, mixed, hidden = kernel("attend")(q, k, v, self.bent, mask, self.w2, x1)
        return look, q, k, v, share, mixed.reshape(-1, WIDTH), hidden.reshape(-1, HIDDEN)

    def score(self, ids: np.ndarray, bounds: np.ndarray, end: int) -> np.ndarray:
        """log10 probability of each text with its end."""
        self.prepare()
        inputs, goals, _, text = layout(ids, bounds, end)
        total = np.zeros(len(bounds) - 1)
        none, now, goal = goals < 0, np.maximum(inputs, 0), np.maximum(goals, 0)
        inner = np.concatenate([self.in_class(now[at : at + LOOKED], goal[at : at + LOOKED]) for at in range(0, len(inputs), LOOKED)] or [np.zeros((0, STEP))])
        met = np.append(self.look, np.int32(-1))[np.concatenate([np.full((1, STEP), -1, inputs.dtype), inputs])]
        for first in range(0, len(inputs), SLICE):  # the blocks of -1 before texts have no goals
            part = slice(first, first + SLICE)
            hidden = self.run_hidden(met[None, first : first + SLICE + 1])[-1]
            p = kernel("log_shares")(hidden, self.wo, self.b, self.logits.take(self.row.take(now[part]).ravel(), axis=0))[0]
            hit = p.ravel().take(np.arange(0, p.size, CLASSES) + self.kind.take(goal[part].ravel()))
            each = inner[part]
            each += hit.reshape(each.shape)
            each[none[part]] = 0
            total += np.bincount(text[part], weights=each.sum(axis=1), minlength=len(total))
        return total / np.log(10)

    def in_class(self, before: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Log probability of ids in their classes after the ids before."""
        if not hasattr(self, "lookup"):
            self.lookup = Lookup(self.pair)
            self.held = np.append(self.after, np.nan)[self.lookup.slot]  # by place in the table
        out = self.lookup.values(pair_key(before.ravel(), goal.ravel()), self.held)
        new = np.flatnonzero(np.isnan(out))
        a, b = before.ravel()[new], goal.ravel()[new]
        out[new] = np.log(INSIDE) + self.inside[b] - np.log(self.kept[self.row[a], self.kind[b]] + INSIDE)
        return out.reshape(goal.shape)


def _blocks(m: Model, sequences: Iterator[tuple[np.ndarray, np.ndarray]], end: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(embeddings' numbers, rows of logits, goal classes, scored blocks) of sequences."""
    look, kind = np.append(m.look, np.int32(-1)), np.append(m.kind, np.int32(-1))
    for ids, bounds in sequences:
        inputs, goals, scored, _ = layout(ids.astype(np.int32), bounds, end)
        yield look[inputs], m.row[np.maximum(inputs, 0)], kind[goals], np.flatnonzero(scored)


def start(m: Model, sequences: Iterator[tuple[np.ndarray, np.ndarray]], end: int) -> Model:
    """A first fit on a sample of (ids, bounds), from which the shards go on; ``m`` changes."""
    rng, adam, held, first = np.random.default_rng(11), _Adam(m), [], 0
    for look, row, goal, at in _blocks(m, sequences, end):
        held.append((look, row, goal, at + first))
        first += len(look)
    if not held:
        return m
    look, row, goal, at = (np.concatenate(x) for x in zip(*held, strict=True))
    for step in range(1, STEPS + 1):
        b = rng.choice(at, BATCH)
        adam.step(gradients(m, look[b - 1], look[b], row[b], goal[b]), RATE * min(1.0, 2 * (1 - step / (STEPS + 1))))
    return m


class _Adam:
    """Steps on the weights of ``m``, which become views of one vector."""

    def __init__(self, m: Model) -> None:
        self.n, self.flat = 0, weights(m).astype(np.float32)
        self.first, self.second = np.zeros_like(self.flat), np.zeros_like(self.flat)
        at = 0
        for p in PARTS:
            old = getattr(m, p)
            setattr(m, p, self.flat[at : at + old.size].reshape(old.shape))
            at += old.size

    def step(self, found: dict[str, np.ndarray], rate: float) -> None:
        self.n += 1
        g = np.concatenate([found[p].ravel() for p in PARTS])
        self.first += np.float32(0.1) * (g - self.first)
        g *= g
        self.second += np.float32(0.01) * (g - self.second)
        size = np.sqrt(self.second, out=g)
        size *= np.float32((1 - 0.99**self.n) ** -0.5)
        size += np.float32(1e-8)
        np.divide(self.first, size, out=size)
        size *= np.float32(rate / (1 - 0.9**self.n))
        self.flat -= size


def weights(m: Model) -> np.ndarray:
    """What gradients move, as one vector."""
    return np.concatenate([getattr(m, p).ravel() for p in PARTS]).astype(np.float64)


def with_weights(m: Model, flat: np.ndarray) -> Model:
    at = 0
    for p in PARTS:
        old = getattr(m, p)
        setattr(m, p, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
        at += old.size
    return m


def pass_over(m: Model, sequences: Iterator[tuple[np.ndarray, np.ndarray]], end: int) -> tuple[int, int]:
    """Training on all windows of a shard, once each (a SHARE of them below 1); ``m`` changes. Returns the numbers of windows seen and used."""
    rng, adam, windows, used = np.random.default_rng(11), _Adam(m), 0, 0
    for look, row, goal, at in _blocks(m, sequences, end):
        windows += len(at)
        runs = -(-len(look) // RUN)
        fill = runs * RUN - len(look)
        look = np.concatenate([np.full((1, STEP), -1, look.dtype), look, np.full((fill, STEP), -1, look.dtype)])
        row, goal = (np.concatenate([x, np.full((fill, STEP), empty, x.dtype)]).reshape(runs, RUN, STEP) for x, empty in ((row, 0), (goal, -1)))
        look = np.lib.stride_tricks.as_strided(look, (runs, RUN + 1, STEP), (RUN * look.strides[0], *look.strides))
        some = np.flatnonzero(rng.random(runs) < SHARE)
        held = (goal[:, :, 0] >= 0).sum(axis=1)  # windows of each run
        used += int(held[some].sum())
        for b in np.array_split(rng.permutation(some), max(round(len(some) * RUN / PASS_BATCH), 1)) if len(some) else ():
            if held[b].any():
                adam.step(run_gradients(m, look[b], row[b], goal[b]), PASS_RATE)
    return windows, used


def _summed_rows(place: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows (of even width) by their place, below n (and 2**15)."""
    order = np.argsort(place.astype(np.int16), kind="stable")
    met = place.take(order)
    first = np.concatenate([[0], np.flatnonzero(met[1:] != met[:-1]) + 1])
    out = np.zeros((n, rows.shape[1]), np.float32)
    # columns are summed one by one, so two go as one complex number
    out[met.take(first)] = np.add.reduceat(rows.take(order, axis=0).view(np.complex64), first, axis=0).view(np.float32)
    return out


def gradients(m: Model, before: np.ndarray, now: np.ndarray, row: np.ndarray, goal: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log likelihood of the goals' classes (-1: none)."""
    return run_gradients(m, np.stack([before, now], axis=1), row[:, None], goal[:, None])


def run_gradients(m: Model, blocks: np.ndarray, row: np.ndarray, goal: np.ndarray) -> dict[str, np.ndarray]:
    """As ``gradients``, for runs of neighbouring blocks as in ``run_logits``."""
    look, q, k, v, share, mixed, hidden = m.prepare().run_hidden(blocks)
    goal = goal.ravel()
    aimed = (goal >= 0).astype(np.float32)
    aimed /= max(np.count_nonzero(aimed), 1)
    p = kernel("shares")(hidden, m.wo, m.b, m.logits.take(row.ravel(), axis=0))[0]
    p *= aimed[:, None]
    p.reshape(-1)[np.arange(0, p.size, CLASSES) + np.maximum(goal, 0)] -= aimed  # now the gradients of logits
    ones = np.ones(len(p), np.float32)
    dz = p @ m.wo.T
    slope = hidden * hidden
    dz *= np.subtract(1, slope, out=slope)
    dmix = dz @ m.w2.T
    # dkv: of a key and value in its own window and the next one; the queries hold the scale already
    ds, dq, pairs = kernel("attend_back")(q, k, v, share, dmix.reshape(q.shape), ((mixed * dmix) @ ones[:WIDTH]).reshape(-1, STEP, 1))
    pairs = pairs.reshape(len(look), -1, 2 * STEP, 2 * WIDTH)
    dkv = np.zeros((*look.shape, 2 * WIDTH), np.float32)
    dkv[:, 1:] = pairs[:, :, STEP:]
    dkv[:, :-1] += pairs[:, :, :STEP]
    dkv = dkv.reshape(-1, 2 * WIDTH)
    dq = dq.reshape(-1, WIDTH)
    dq *= _SCALE
    x, asked = m.embed.take(look.ravel(), axis=0), m.embed.take(look[:, 1:].ravel(), axis=0)
    dx = dkv @ np.concatenate([m.wk, m.wv], axis=1).T
    own = dq @ m.wq.T
    own += dz @ m.w1.T
    dx.reshape(*look.shape, WIDTH)[:, 1:] += own.reshape(len(look), -1, STEP, WIDTH)
    wo, w2, wkv, wq, w1 = kernel("products")(p, hidden, mixed, dz, x, dkv, asked, dq)
    wk, wv = np.split(wkv, 2, axis=1)
    bias = (ones[: len(ds)] @ ds.reshape(len(ds), -1)).reshape(STEP, 2 * STEP)
    embed = _summed_rows(look.ravel(), dx, len(m.embed))
    return {"embed": embed, "wq": wq, "wk": wk, "wv": wv, "bias": bias, "w1": w1, "w2": w2, "b1": ones @ dz, "wo": wo, "b": ones @ p}
