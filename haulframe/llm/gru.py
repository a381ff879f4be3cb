"""A gated recurrent language model in numpy: forward, truncated backpropagation, scoring.

Symbols: the words of the vocabulary and the end, then one symbol for each tail class, both in
classes of ``CLASS`` symbols each, then the beginning. The output softmax is factored: first a
class, then a symbol of the class. Documents run through lanes one after another; a lane's state
is carried from window to window and set to zero where a document begins.

Inside a window arrays lie by step, then by feature, with the lanes in their rows: parts of the
gates are then contiguous, sums over features run along whole rows, and a step stays in the cache.
"""

from __future__ import annotations

import heapq

import numpy as np

CLASS = 32
HIDDEN = 24
# Tokens that training takes from a document in a row.
SEGMENT = 256
LOG10 = float(np.log(10))
NEVER = np.float32(-1e9)
# Lanes that scoring takes even beside a very long document, and places of its windows.
FEWEST = 32
PLACES = 4096
# Logits of this size are safe in single precision.
HIGH = 60.0


def new_model(word_counts: np.ndarray, tail_counts: np.ndarray, hidden: int = HIDDEN,
              seed: int = 7) -> dict[str, np.ndarray]:
    """Weights that start as the unigram model of the given counts (end: last of the words)."""
    draw = np.random.default_rng(seed)
    shares = np.concatenate([_padded(word_counts + 1.0), _padded(tail_counts + 1.0)])
    by_class = shares.reshape(-1, CLASS).sum(axis=1)
    with np.errstate(divide="ignore"):
        bias = np.where(shares > 0, np.log(shares), NEVER)
    return {k: v.astype(np.float32) for k, v in {
        "inputs": draw.normal(0, 0.1, (len(shares) + 1, 3 * hidden)),
        "state": draw.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)),
        "state_bias": np.zeros(3 * hidden),
        "classes": np.zeros((hidden, len(by_class))),
        "class_bias": np.log(by_class / by_class.sum()),
        "words": np.zeros((len(shares), hidden)),
        "word_bias": bias}.items()}


def _padded(counts: np.ndarray) -> np.ndarray:
    """With zeros up to whole classes."""
    return np.pad(counts, (0, -len(counts) % CLASS))


def flatten(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in sorted(model)])


def unflatten(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


class Lanes:
    """Documents (arrays of symbols, the end included) dealt over lanes of about equal length."""

    def __init__(self, docs: list[np.ndarray], lanes: int, begin: int):
        sizes = np.array([len(d) for d in docs])
        lanes = max(1, min(lanes, len(docs)))
        held: list[list[int]] = [[] for _ in range(lanes)]
        load = [(0, i) for i in range(lanes)]
        for d in np.argsort(-sizes, kind="stable").tolist():
            n, i = load[0]
            heapq.heapreplace(load, (n + int(sizes[d]), i))
            held[i].append(d)
        # Lanes from long to short, so those at work are always the first.
        held.sort(key=lambda ds: -sum(int(sizes[d]) for d in ds))
        order = [d for ds in held for d in ds]
        self.lengths = np.array([sum(int(sizes[d]) for d in ds) for ds in held])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.targets = np.concatenate([docs[d] for d in order])
        self.doc = np.repeat(order, sizes[order])
        self.fresh = np.zeros(len(self.targets), bool)
        self.fresh[np.cumsum(sizes[order]) - sizes[order]] = True
        self.inputs = np.empty_like(self.targets)
        self.inputs[1:] = self.targets[:-1]
        self.inputs[self.fresh] = begin

    def windows(self, steps: int):
        """Places (steps x lanes at work) and which of them hold a token."""
        for t in range(0, int(self.lengths.max()), steps):
            active = int(np.searchsorted(-self.lengths, -t))
            ahead = t + np.arange(min(steps, int(self.lengths[0]) - t))[:, None]
            valid = ahead < self.lengths[:active]
            yield active, np.where(valid, self.offsets[:active] + ahead, 0), valid


class _Space:
    """Arrays that windows use one after another: fresh memory for each would cost more time than
    most of the products."""

    def __init__(self, kind: np.dtype):
        self.kind, self.held = kind, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        held = self.held.get(name)
        if held is None or held.size < size:
            held = self.held[name] = np.empty(size, self.kind)
        return held[:size].reshape(shape)


def _with_bias(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights (outputs x hidden) and, as a last column, the bias: met by states with ones."""
    return np.concatenate([weights, bias[:, None]], axis=1)


def _safe(weights: np.ndarray, groups: int = 1) -> bool:
    """Whether the logits of each group of outputs can neither overflow nor vanish altogether:
    states lie between -1 and 1."""
    reach, bias = np.abs(weights[:, :-1]).sum(axis=1), weights[:, -1]
    lowest = (bias - reach).reshape(groups, -1).max(axis=1)
    return bool(-HIGH < lowest.min() and (bias + reach).max() < HIGH)


def _bounded(logits: np.ndarray, safe: bool) -> np.ndarray:
    """Logits (outputs x places) whose exponentials neither overflow nor vanish altogether."""
    if not safe:
        logits -= logits.max(axis=0)
    return logits


class _Window:
    """States of the places of a window: forward through all steps."""

    def __init__(self, model, run: Lanes, h: np.ndarray, place: np.ndarray, valid: np.ndarray,
                 space: _Space, keep: bool):
        steps, lanes = place.shape
        kind, n = space.kind, h.shape[1]
        self.inputs, self.fresh = run.inputs[place], run.fresh[place] & valid
        self.begins = self.fresh.any(axis=1).tolist()
        # The exponentials of the sigmoids take the arguments negated.
        turn = np.concatenate([np.full(2 * n, -1), np.ones(n)]).astype(kind)
        table = np.multiply(model["inputs"], turn, out=space("table", *model["inputs"].shape))
        state = _with_bias((model["state"] * turn).T, model["state_bias"] * turn)
        # With a last row of ones, for the biases; the first step's are the states before it.
        reached = space("states", steps + 1, n + 1, lanes)
        reached[:, n] = 1
        reached[0, :n] = h.T
        self.states = reached[1:]
        many = steps if keep else 1
        self.inner, self.gates = space("inner", many, n, lanes), space("gates", many, 3 * n, lanes)
        cleared = space("cleared", many, n + 1, lanes)
        # What each step starts from, with ones.
        self.before = list(reached[:steps])
        x, rest = np.empty((lanes, 3 * n), kind), np.empty((n, lanes), kind)
        with np.errstate(over="ignore"):
            for t in range(steps):
                if self.begins[t]:
                    start = cleared[t if keep else 0]
                    start[:] = reached[t]
                    start[:n, np.flatnonzero(self.fresh[t])] = 0
                    self.before[t] = start
                h = self.before[t]
                g = self.gates[t if keep else 0]
                np.matmul(state, h, out=g)
                table.take(self.inputs[t], axis=0, out=x, mode="clip")
                sig, new = g[:2 * n], g[2 * n:]
                if keep:
                    self.inner[t] = new
                sig += x[:, :2 * n].T
                np.exp(sig, out=sig)
                sig += kind.type(1)
                np.divide(kind.type(1), sig, out=sig)
                new *= sig[n:]
                new += x[:, 2 * n:].T
                np.tanh(new, out=new)
                np.subtract(h[:n], new, out=rest)
                rest *= sig[:n]
                np.add(rest, new, out=self.states[t, :n])
        self.last = np.ascontiguousarray(reached[steps, :n].T)

    def by_place(self, space: _Space) -> np.ndarray:
        """The states with their ones, a row for each place."""
        steps, width, lanes = self.states.shape
        out = space("by place", steps, lanes, width)
        for t in range(steps):
            out[t] = self.states[t].T
        return out.reshape(-1, width)


class _Words:
    """The places that hold a token, sorted by the class of their target."""

    def __init__(self, targets: np.ndarray, valid: np.ndarray, words: int, window: _Window,
                 space: _Space):
        kind = np.where(valid, targets // CLASS, words // CLASS).astype(np.int16)
        sizes = np.bincount(kind, minlength=words // CLASS + 1)[:-1]
        ends = np.cumsum(sizes)
        self.rows = np.argsort(kind, kind="stable")[:ends[-1]]
        self.parts = [(slice(c * CLASS, (c + 1) * CLASS), slice(int(ends[c] - sizes[c]), int(ends[c])))
                      for c in np.flatnonzero(sizes).tolist()]
        self.own = targets[self.rows] % CLASS
        self.states = window.by_place(space)
        self.near = self.states.take(self.rows, axis=0, mode="clip",
                                     out=space("near", len(self.rows), self.states.shape[1]))

    def logits(self, weights: np.ndarray, space: _Space) -> np.ndarray:
        out = space("words", CLASS, len(self.rows))
        for part, at in self.parts:
            np.matmul(weights[part], self.near[at].T, out=out[:, at])
        return out


def score(model: dict[str, np.ndarray], docs: list[np.ndarray], lanes: int = 512,
          steps: int | None = None) -> np.ndarray:
    """log10 probability of each document's symbols.

    No more lanes than the longest document fills, so that it is not left alone at the end.
    """
    total = np.zeros(len(docs))
    if not docs:
        return total
    sizes = [len(d) for d in docs]
    lanes = min(lanes, max(FEWEST, sum(sizes) // max(sizes)))
    steps = steps or PLACES // lanes
    words = len(model["words"])
    run = Lanes(docs, lanes, len(model["inputs"]) - 1)
    h = np.zeros((len(run.lengths), model["state"].shape[0]), model["state"].dtype)
    classes = _with_bias(model["classes"].T, model["class_bias"])
    inner = _with_bias(model["words"], model["word_bias"])
    safe, safe_inner = _safe(classes), _safe(inner, len(inner) // CLASS)
    space = _Space(h.dtype)
    for active, place, valid in run.windows(steps):
        window = _Window(model, run, h[:active], place, valid, space, keep=False)
        h = window.last
        targets = run.targets[place].astype(np.int64)
        kind = targets // CLASS
        found = np.empty(place.shape, space.kind)
        p = space("p", len(classes), active)
        for t in range(len(place)):
            np.matmul(classes, window.states[t], out=p)
            found[t] = _log_shares(_bounded(p, safe), kind[t])
        place, valid, found = place.ravel(), valid.ravel(), found.ravel()
        known = _Words(targets.ravel(), valid, words, window, space)
        logits = known.logits(inner, space)
        found[known.rows] += _log_shares(_bounded(logits, safe_inner), known.own)
        total += np.bincount(run.doc[place[valid]], found[valid], minlength=len(docs))
    return total / LOG10


def _log_shares(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Logarithm of each place's chosen output's share; the logits are overwritten."""
    own = logits[chosen, np.arange(len(chosen))]
    np.exp(logits, out=logits)
    return own - np.log(logits.sum(axis=0))


def train(model: dict[str, np.ndarray], seen: dict[str, np.ndarray], docs: list[np.ndarray],
          lanes: int = 256, steps: int = 16, rate: float = 0.2) -> int:
    """One pass of truncated backpropagation over the documents; returns the tokens used.

    Documents are cut into segments, dealt in a random order, so that no window learns from one
    long document alone. Changes ``model`` and ``seen`` (Adagrad's sums of squares) in place.
    """
    if not docs:
        return 0
    segments = [d[i:i + SEGMENT] for d in docs for i in range(0, len(d), SEGMENT)]
    order = np.random.default_rng(len(segments)).permutation(len(segments))
    run = Lanes([segments[i] for i in order], lanes, len(model["inputs"]) - 1)
    h = np.zeros((len(run.lengths), model["state"].shape[0]), model["state"].dtype)
    space = _Space(h.dtype)
    for active, place, valid in run.windows(steps):
        h, slopes = gradients(model, run, h[:active], place, valid, len(run.lengths) * steps, space)
        for k, g in slopes.items():
            # Long steps of a few lanes must not shake the weights.
            np.clip(g, -1, 1, out=g)
            size = space("size", *g.shape)
            seen[k] += np.multiply(g, g, out=size)
            np.sqrt(seen[k], out=size)
            size += np.float32(1e-6)
            g *= np.float32(rate)
            g /= size
            model[k] -= g
    return len(run.targets)


def gradients(model, run: Lanes, h, place, valid, full: int | None = None,
              space: _Space | None = None):
    """State after a window, and the slopes of its loss, divided by its tokens.

    ``full`` is what a window of all lanes holds: where few lanes are left it divides the loss
    instead, so that the last documents do not count for more than the others.
    """
    n = h.shape[1]
    steps, lanes = place.shape
    space = space or _Space(model["state"].dtype)
    window = _Window(model, run, h, place, valid, space, keep=True)
    slopes = {}
    spread = _output_slopes(model, slopes, window, run.targets[place].astype(np.int64), valid, full,
                            space)
    # Slopes of the gates: by the state's part; the input's part differs in its last third.
    part, by_new = space("dg", 3 * n, lanes), space("dn", n, lanes)
    by_input = space("by input", steps, lanes, 3 * n)
    dh, back, rest = np.zeros((n, lanes), space.kind), *np.empty((2, n, lanes), space.kind)
    by_state = np.zeros((3 * n, n + 1), space.kind)
    for t in range(steps - 1, -1, -1):
        gates, new, before = window.gates[t], window.gates[t, 2 * n:], window.before[t]
        z, r = gates[:n], gates[n:2 * n]
        dh += spread[t].T
        np.multiply(dh, z, out=back)
        np.subtract(dh, back, out=rest)
        # By z: (before - new) * dh * z * (1 - z).
        np.subtract(before[:n], new, out=part[:n])
        part[:n] *= rest
        part[:n] *= z
        # By the new state: dh * (1 - z) * (1 - new * new).
        np.multiply(new, new, out=by_new)
        np.subtract(1, by_new, out=by_new)
        by_new *= rest
        np.multiply(by_new, r, out=part[2 * n:])
        # By r: what came from the new state, times inner * r * (1 - r).
        np.subtract(1, r, out=rest)
        rest *= window.inner[t]
        np.multiply(part[2 * n:], rest, out=part[n:2 * n])
        by_state += part @ before.T
        by_input[t, :, :2 * n], by_input[t, :, 2 * n:] = part[:2 * n].T, by_new.T
        np.matmul(model["state"], part, out=dh)
        dh += back
        if window.begins[t]:
            dh[:, np.flatnonzero(window.fresh[t])] = 0
    slopes["state"] = np.ascontiguousarray(by_state[:, :n].T)
    slopes["state_bias"] = by_state[:, n].copy()
    # Inputs: the places of a symbol side by side, then their sums.
    order = np.argsort(window.inputs, axis=None, kind="stable")
    symbols = window.inputs.ravel()[order]
    starts = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    rows = by_input.reshape(-1, 3 * n).take(order, axis=0, mode="clip",
                                            out=space("by symbol", len(order), 3 * n))
    slopes["inputs"] = space("inputs", *model["inputs"].shape)
    slopes["inputs"][:] = 0
    slopes["inputs"][symbols[starts]] = np.add.reduceat(
        rows, starts, axis=0, out=space("symbols", len(starts), 3 * n))
    return window.last, slopes


def _output_slopes(model, slopes, window: _Window, targets, valid, full: int | None,
                   space: _Space):
    """Slopes by the states, a row for each place; those of the output's weights go into ``slopes``.
    Places that hold no token have none."""
    words, (steps, width, lanes) = len(model["words"]), window.states.shape
    n = width - 1
    scale = (valid / (full or max(1, valid.sum()))).astype(space.kind)
    kind = targets // CLASS
    # Words within their classes: one product for each class.
    known = _Words(targets.ravel(), valid.ravel(), words, window, space)
    weights, sums = _with_bias(model["words"], model["word_bias"]), np.zeros((words, width), space.kind)
    q = _bounded(known.logits(weights, space), _safe(weights, words // CLASS))
    _shares_less_own(q, scale.ravel()[known.rows], known.own)
    inner = space("by word", len(known.rows), n)
    for part, at in known.parts:
        np.matmul(q[:, at], known.near[at], out=sums[part])
        np.matmul(q[:, at].T, model["words"][part], out=inner[at])
    slopes["words"], slopes["word_bias"] = np.ascontiguousarray(sums[:, :n]), sums[:, n].copy()
    # Classes and tail classes.
    weights = _with_bias(model["classes"].T, model["class_bias"])
    p = np.matmul(weights, known.states.T, out=space("p", len(weights), steps * lanes))
    _shares_less_own(_bounded(p, _safe(weights)), scale.ravel(), kind.ravel())
    sums = p @ known.states
    slopes["classes"], slopes["class_bias"] = np.ascontiguousarray(sums[:, :n].T), sums[:, n].copy()
    back = np.matmul(p.T, weights[:, :n], out=space("back", steps * lanes, n))
    inner += back.take(known.rows, axis=0, mode="clip", out=space("own", *inner.shape))
    back[known.rows] = inner
    return back.reshape(steps, lanes, n)


def _shares_less_own(logits: np.ndarray, scale: np.ndarray, own: np.ndarray) -> None:
    """Turns logits into the slopes of the loss by them."""
    np.exp(logits, out=logits)
    logits *= scale / logits.sum(axis=0)
    logits[own, np.arange(len(own))] -= scale
