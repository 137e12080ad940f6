"""A causal self-attention model over subword ids, in numpy, with its gradients.

The probability of an id is that of its class after the ids before it, times its own within the class after the id just
before. Counts of all training ids enter the network as biases: of classes after a context - the bucket of the last id and
the class of the one before it - and of ids after a bucket. On top of the first, one attention head with a learned bias for
each distance looks at the last ``CONTEXT`` ids and corrects the scores of all classes. Both factors sum to one, and so does
their product over all ids.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTH, CLASSES = 8, 32
CONTEXT, STRIDE = 16, 14
#: Ids that are contexts of their own, the most frequent ones, and contexts that the others share.
OWN, SHARED = 960, 64
CONTEXTS = OWN + SHARED
#: Ids whose counts by context are looked up in a table of 8 MB at most instead of a sorted list.
SMALL = 2047
#: How many counts what is known of fewer ids weighs as.
CLASS_PRIOR, CONTEXT_PRIOR, ID_PRIOR = 10.0, 20.0, 10.0
#: Windows at a time.
BATCH = 256
#: The largest exponent that a network may come to; 32-bit floats end at 88.
MOST = 60.0
SHAPES = {"e": (CONTEXTS, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "b": (CONTEXT,), "w": (WIDTH, CLASSES)}
_AHEAD = np.triu(np.ones((CONTEXT, CONTEXT), bool), 1)
_ONES = np.ones(CONTEXT, np.float32)
_AWAY = np.clip(np.arange(CONTEXT)[:, None] - np.arange(CONTEXT)[None, :], 0, None)
_SCALE = np.float32(WIDTH**-0.5)


def contexts_of(counts: np.ndarray) -> np.ndarray:
    """The context that each id is: its rank if it is among the most frequent, else one that it shares."""
    order = np.argsort(-counts, kind="stable")
    out = OWN + (((np.arange(len(counts), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(SHARED)).astype(np.int64)
    out[order[:OWN]] = np.arange(min(OWN, len(counts)))
    return out.astype(np.int32)


def classes_of(counts: np.ndarray, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A class for each id, by k-means over what ids follow: ``keys`` are context * ids + id, seen ``n`` times."""
    size = len(counts)
    seen = np.flatnonzero(counts > 0)
    out = np.zeros(size, np.int32)
    if not len(seen):
        return out
    seen = seen[np.argsort(-counts[seen], kind="stable")]
    place = np.full(size, -1, np.int64)
    place[seen] = np.arange(len(seen))
    profile = np.full((len(seen), CONTEXTS), 0.02 / CONTEXTS, np.float32)
    np.add.at(profile, (place[keys % size], keys // size), n.astype(np.float32))
    profile /= profile.sum(1, keepdims=True)
    np.sqrt(profile, out=profile)
    centres = profile[np.linspace(0, len(seen) - 1, CLASSES).astype(int)].copy()
    weight = counts[seen].astype(np.float32) + 1
    for _ in range(12):
        near = np.argmax(profile @ centres.T - 0.5 * (centres**2).sum(1), 1)
        for c in range(CLASSES):
            mine = near == c
            if mine.any():
                centres[c] = np.average(profile[mine], axis=0, weights=weight[mine])
    out[seen] = near
    return out


@dataclass
class Vocabulary:
    """Context and class of each id, and the biases: logs of counts, smoothed."""

    context: np.ndarray
    classes: np.ndarray
    #: Log probability of each class after each pair of a context and a class before it.
    follow: np.ndarray
    #: Sorted context * ids + id, their counts, an id's prior within its class, and the log total of a context's class.
    keys: np.ndarray
    counts: np.ndarray
    prior: np.ndarray
    total: np.ndarray
    #: Which ids have been seen, and counts of these by context where that makes a small table.
    seen: np.ndarray | None = None
    table: np.ndarray | None = None

    @classmethod
    def of(cls, counts: np.ndarray, context: np.ndarray, classes: np.ndarray, keys: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> Vocabulary:
        """``pairs`` has a count for each context, class before it, and class after it."""
        size, order = len(counts), np.argsort(keys)
        keys, n = keys[order], n[order].astype(np.float32)
        after = np.zeros((CONTEXTS, CLASSES))
        np.add.at(after, (keys // size, classes[keys % size]), n)
        every = (after.sum(0) + 0.1) / (after.sum() + 0.1 * CLASSES)
        lower = (after + CLASS_PRIOR * every) / (after.sum(1, keepdims=True) + CLASS_PRIOR)
        pairs = pairs.reshape(CONTEXTS, CLASSES, CLASSES)
        follow = np.log((pairs + CONTEXT_PRIOR * lower[:, None]) / (pairs.sum(2, keepdims=True) + CONTEXT_PRIOR)).astype(np.float32)
        mine = np.bincount(classes, weights=counts + 0.1, minlength=CLASSES)
        prior = (ID_PRIOR * (counts + 0.1) / mine[classes]).astype(np.float32)
        out = cls(context, classes, follow.reshape(-1, CLASSES), keys, n, prior, np.log(after + ID_PRIOR).astype(np.float32))
        used = np.flatnonzero(counts > 0)
        if len(used) <= SMALL:
            out.seen = np.zeros(size, np.int32)  # 0 for all that haven't been
            out.seen[used] = np.arange(1, len(used) + 1)
            out.table = np.zeros((len(used) + 1, CONTEXTS), np.float32)
            out.table[out.seen[keys % size], keys // size] = n
        return out

    def read(self, ids: np.ndarray, lengths: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each id of texts one after another: the context before it, the bias' row, and its class."""
        first = (np.cumsum(lengths) - lengths)[lengths > 0]
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[first] = begin
        earlier = np.empty_like(ids)
        earlier[1:] = before[:-1]
        earlier[first] = begin
        context = self.context[before]
        return context, context * np.int32(CLASSES) + self.classes[earlier], self.classes[ids]

    def within(self, ids: np.ndarray, context: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Log probability of each id within its class after the context."""
        seen = np.take(self.prior, ids)
        if self.table is not None:
            seen = seen + np.take(self.table, np.take(self.seen, ids).astype(np.int64) * self.table.shape[1] + context)
        elif len(self.keys):
            wanted = context.astype(np.int64) * len(self.context) + ids
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            seen = seen + np.where(self.keys[at] == wanted, self.counts[at], np.float32(0))
        return np.log(seen) - self.total[context, classes]


def start(seed: int = 0) -> dict[str, np.ndarray]:
    """A network that gives just what the biases say, and attends to near ids most."""
    made = np.random.default_rng(seed)
    p = {n: made.normal(0, 0.3, s).astype(np.float32) for n, s in SHAPES.items()}
    p["v"] *= np.float32(1.5)
    p |= {"w": np.zeros(SHAPES["w"], np.float32), "b": -0.1 * np.arange(CONTEXT, dtype=np.float32)}
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[n].ravel() for n in SHAPES]).astype(np.float64)


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    cuts = np.cumsum([0, *(int(np.prod(s)) for s in SHAPES.values())])
    return {n: values[lo:hi].reshape(s) for (n, s), lo, hi in zip(SHAPES.items(), cuts[:-1], cuts[1:], strict=True)}


def attended(p: dict[str, np.ndarray], contexts: np.ndarray):
    """What attention makes of each position of each row of contexts, and what gradients need.

    ``Adam`` holds exponents where 32-bit floats can, so they are not held here.
    """
    of, shape = contexts.ravel(), (*contexts.shape, WIDTH)
    q, k, v = (np.take(p["e"] @ m, of, 0).reshape(shape) for m in (p["q"] * _SCALE, p["k"], p["v"]))
    a = q @ np.ascontiguousarray(k.transpose(0, 2, 1))
    a += np.where(_AHEAD, np.float32(-np.inf), p["b"][_AWAY])
    np.exp(a, out=a)
    a /= (a.reshape(-1, CONTEXT) @ _ONES).reshape(*contexts.shape, 1)
    return a @ v, (q, k, v, a)


def scored(p: dict[str, np.ndarray], z: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Scores of classes for each row of ``z``; ``bias`` is a copy, and written to."""
    bias += z @ p["w"]
    return bias


def gradients(p: dict[str, np.ndarray], contexts: np.ndarray, bias: np.ndarray, classes: np.ndarray, real: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Sums over real positions of the gradients of the negative log probability of classes, and of that itself."""
    z, (q, k, v, a) = attended(p, contexts)
    of = contexts.ravel()
    x = np.take(p["e"], of, 0)
    states, counted = z.reshape(-1, WIDTH), real.ravel().astype(z.dtype)
    d = scored(p, states, bias)
    at, mine = np.arange(len(d)), classes.ravel()
    right = d[at, mine]
    np.exp(d, out=d)
    total = d @ np.ones(CLASSES, d.dtype)
    loss = float(((np.log(total) - right) * counted).sum())
    d *= (counted / total)[:, None]
    d[at, mine] -= counted
    g = {"w": states.T @ d}
    dz = (d @ p["w"].T).reshape(z.shape)
    da = dz @ np.ascontiguousarray(v.transpose(0, 2, 1))
    da -= np.einsum("bid,bid->bi", dz, z)[..., None]  # the mean of a row's gradients, weighed by its attention
    da *= a
    g["b"] = np.bincount(_AWAY[~_AHEAD], weights=(np.ones(len(da), da.dtype) @ da.reshape(len(da), -1)).reshape(CONTEXT, CONTEXT)[~_AHEAD], minlength=CONTEXT)
    dx = np.zeros_like(x)
    for n, dn in (("q", da @ k * _SCALE), ("k", da.transpose(0, 2, 1) @ q), ("v", a.transpose(0, 2, 1) @ dz)):  # the scale is in ``q``
        dn = dn.reshape(-1, WIDTH)
        g[n] = x.T @ dn
        dx += dn @ p[n].T
    dx = np.ascontiguousarray(dx.T)
    g["e"] = np.stack([np.bincount(of, weights=dx[j], minlength=CONTEXTS) for j in range(WIDTH)], 1)
    return g, loss


def epoch(p: dict[str, np.ndarray], vocabulary: Vocabulary, ids: np.ndarray, lengths: np.ndarray, begin: int, batch: int = BATCH) -> np.ndarray:
    """Gradients summed over windows side by side that hold every id of the texts once; then the loss, and how many ids."""
    context, row, classes = vocabulary.read(ids, lengths, begin)
    out, loss = np.zeros(len(flat(p))), 0.0
    at, stop, _ = _windows(lengths, CONTEXT)
    for low in range(0, len(at), batch):
        place, real = _places(at[low : low + batch], stop[low : low + batch])
        g, more = gradients(p, np.take(context, place), np.take(vocabulary.follow, np.take(row, place.ravel()), 0), np.take(classes, place), real)
        out += flat(g)
        loss += more
    return np.concatenate([out, [loss, float(lengths.sum())]])


class Adam:
    """Steps along mean gradients of whole rounds."""

    def __init__(self, rate: float, steps: int):
        self.rate, self.steps, self.step = rate, steps, 0
        self.first = self.second = 0.0

    def stepped(self, p: dict[str, np.ndarray], gradient: np.ndarray) -> dict[str, np.ndarray]:
        self.first, self.second = 0.8 * self.first + 0.2 * gradient, 0.95 * self.second + 0.05 * gradient**2
        rate, self.step = self.rate * (1 - self.step / self.steps), self.step + 1
        move = self.first / (1 - 0.8**self.step) / (np.sqrt(self.second / (1 - 0.95**self.step)) + 1e-8)
        p = shaped(flat(p) - rate * move)
        # No state is longer than the longest value, and no pair of contexts more alike than these bounds say.
        largest = (np.abs(p["e"] @ p["v"]).max(0) @ np.abs(p["w"])).max()
        p["w"] = p["w"] * (MOST / largest if largest > MOST else 1.0)
        norm = lambda x: np.sqrt((x**2).sum(1).max())
        alike = norm(p["e"] @ p["q"]) * norm(p["e"] @ p["k"]) * _SCALE + np.abs(p["b"]).max()
        p["q"], p["b"] = (p[n] * min(1.0, MOST / alike) for n in "qb")
        return {n: v.astype(np.float32) for n, v in p.items()}


def _windows(lengths: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows over texts one after another begin, where their texts end, and their numbers within these."""
    ends = np.cumsum(lengths)
    n = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - CONTEXT) // stride)), 0)
    of = np.repeat(np.arange(len(lengths)), n)
    number = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return (ends - lengths)[of] + number * stride, ends[of], number


def _places(at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = at[:, None] + np.arange(CONTEXT)
    real = place < stop[:, None]
    return np.minimum(place, stop[:, None] - 1), real


def log10_probabilities(p: dict[str, np.ndarray], vocabulary: Vocabulary, ids: np.ndarray, lengths: np.ndarray, begin: int, batch: int = BATCH) -> np.ndarray:
    """log10 probability of each id of texts one after another, each beginning after the id ``begin``.

    Windows of CONTEXT ids overlap; all but a text's first score only the ids past the overlap, so each id is scored once,
    and no window reaches into another text.
    """
    context, row, classes = vocabulary.read(ids, lengths, begin)
    out = vocabulary.within(ids, context, classes).astype(np.float64)
    at, stop, number = _windows(lengths, STRIDE)
    ones = np.ones(CLASSES, np.float32)
    for low in range(0, len(at), batch):
        place, real = _places(at[low : low + batch], stop[low : low + batch])
        z, _ = attended(p, np.take(context, place))
        wanted = real & ((np.arange(CONTEXT) >= CONTEXT - STRIDE) | (number[low : low + batch, None] == 0))
        here = place[wanted]
        scores = scored(p, z[wanted], np.take(vocabulary.follow, np.take(row, here), 0))
        right = scores[np.arange(len(here)), classes[here]]
        np.exp(scores, out=scores)
        out[here] += right - np.log(scores @ ones)
    return out / np.log(10)
