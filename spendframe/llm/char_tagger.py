"""A character-level bidirectional LSTM with CRF transitions, trained and run in NumPy.

Tags: 0 for outside, k for inside a span of kind k.  A tag of one kind never follows another kind's
directly, so the decoder compares two ways into a kind and one of each kind back to outside.
Gates are piecewise linear (slope 1/4 around 1/2), cells clip at 1: no exponentials at run time.
Arrays run over time first and hold lanes (windows) last, so every step is a few operations on
whole rows of lanes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Characters with a code of their own; all others fall into one of the classes below.
MARKS = "\n .,:;@_-+()[]{}<>/\\|#*$%&=\"'!?~^`"
PAD, DIGIT, OTHER, UPPER_OTHER = 0, 1, 2, 3
FIRST = 4
CODES = FIRST + len(LETTERS) + len(MARKS)
FORBIDDEN = -1e4


def _codes() -> np.ndarray:
    table = np.full(257, OTHER, np.uint8)
    for k, char in enumerate(LETTERS + MARKS):
        table[ord(char)] = FIRST + k
    for char in LETTERS:
        table[ord(char.upper())] = FIRST + LETTERS.index(char)
    table[ord("0") : ord("9") + 1] = DIGIT
    for char in "\t\r\x0b\x0c\xa0":
        table[ord(char)] = table[ord(" ")]
    return table


TABLE = _codes()


def code(text: str) -> np.ndarray:
    """Codes of a text's code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return TABLE[np.minimum(points, 256)]


@dataclass
class Tagger:
    """Weights: ``inputs`` (2, 4H, codes), ``recurrent`` (2, 4H, H), ``out`` (K, 2H), ``bias`` (K), ``moves`` (K, K).

    Gate rows are input, forget, output, candidate.  Direction 1 reads backwards."""

    inputs: np.ndarray
    recurrent: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    moves: np.ndarray

    @classmethod
    def new(cls, kinds: int, hidden: int, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        inputs = rng.normal(0, 0.4, (2, 4 * hidden, CODES)).astype(np.float32)
        inputs[:, hidden : 2 * hidden] += 1.0
        moves = np.zeros((kinds + 1, kinds + 1), np.float32)
        return cls(
            inputs,
            rng.normal(0, 0.4, (2, 4 * hidden, hidden)).astype(np.float32),
            rng.normal(0, 0.3, (kinds + 1, 2 * hidden)).astype(np.float32),
            np.zeros(kinds + 1, np.float32),
            moves,
        )

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.out, self.bias, self.moves]

    def allowed(self) -> np.ndarray:
        """Moves with those between two kinds ruled out."""
        ruled = self.moves.copy()
        kinds = np.arange(1, len(ruled))
        block = ruled[1:, 1:]
        block[kinds[:, None] != kinds[None, :]] = FORBIDDEN
        return ruled


def _run(model: Tagger, way: int, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (T, H, B) of one direction, in text order."""
    steps, lanes = codes.shape
    hidden = model.recurrent.shape[2]
    states = np.empty((steps, hidden, lanes), np.float32)
    h, c = np.zeros((hidden, lanes), np.float32), np.zeros((hidden, lanes), np.float32)
    inputs, recurrent = model.inputs[way], model.recurrent[way]
    scale = np.full((4 * hidden, 1), 0.25, np.float32)
    scale[3 * hidden :] = 1.0
    shift = np.full((4 * hidden, 1), 0.5, np.float32)
    shift[3 * hidden :] = 0.0
    inputs, recurrent = inputs * scale + shift, recurrent * scale  # slopes and centres are part of the weights
    low = np.where(shift > 0, np.float32(0), np.float32(-1))
    z = np.empty((4 * hidden, lanes), np.float32)
    for t in range(steps) if way == 0 else reversed(range(steps)):
        np.take(inputs, codes[t], axis=1, out=z, mode="clip")
        z += recurrent @ h
        before = z.copy() if keep is not None else None
        np.clip(z, low, np.float32(1), out=z)
        i, f, o, g = z[:hidden], z[hidden : 2 * hidden], z[2 * hidden : 3 * hidden], z[3 * hidden :]
        last_c, last_h = c, h
        c = f * c
        c += i * g
        h = np.clip(c, -1, 1)
        h *= o
        states[t] = h
        if keep is not None:
            keep.append((t, before, z.copy(), last_c, c, last_h))
    return states


def scores(model: Tagger, codes: np.ndarray) -> np.ndarray:
    """Emission scores (T, K, B) of windows given as codes (T, B)."""
    hidden = model.recurrent.shape[2]
    both = np.matmul(model.out[:, :hidden], _run(model, 0, codes))
    both += np.matmul(model.out[:, hidden:], _run(model, 1, codes))
    both += model.bias[:, None]
    return both


def decode(model: Tagger, emitted: np.ndarray) -> np.ndarray:
    """The best tags (T, B) of each lane."""
    steps, size, lanes = emitted.shape
    moves = model.moves
    enter, leave, stay = moves[0, 1:, None], moves[1:, 0, None], np.diag(moves)[1:, None]
    outside, inside = emitted[0, 0].copy(), emitted[0, 1:].copy()
    entered = np.empty((steps, size - 1, lanes), bool)
    left = np.zeros((steps, lanes), np.uint8)
    for t in range(1, steps):
        best, source = outside + moves[0, 0], left[t]
        for k in range(size - 1):
            way = inside[k] + leave[k]
            better = way > best
            np.copyto(best, way, where=better)
            source[better] = k + 1
        fresh, same = outside[None] + enter, inside + stay
        np.greater(fresh, same, out=entered[t])
        inside = np.maximum(fresh, same)
        inside += emitted[t, 1:]
        outside = best
        outside += emitted[t, 0]
    tags = np.empty((steps, lanes), np.uint8)
    lane = np.arange(lanes)
    final = np.concatenate([outside[None], inside])
    tag = final.argmax(axis=0).astype(np.uint8)
    for t in range(steps - 1, -1, -1):
        tags[t] = tag
        if t:
            from_kind = np.where(entered[t, np.maximum(tag, 1) - 1, lane], 0, tag)
            tag = np.where(tag == 0, left[t], from_kind).astype(np.uint8)
    return tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def loss_and_gradients(model: Tagger, codes: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log likelihood a character, and its gradients in the order of ``weights``."""
    steps, lanes = codes.shape
    hidden = model.recurrent.shape[2]
    kept: list[list] = [[], []]
    states = [_run(model, way, codes, kept[way]) for way in (0, 1)]
    joined = np.concatenate(states, axis=1)
    emitted = np.matmul(model.out, joined) + model.bias[:, None]
    moves = model.allowed()
    size = len(moves)

    forward = np.empty_like(emitted)
    forward[0] = emitted[0]
    for t in range(1, steps):
        forward[t] = emitted[t] + _log_sum(forward[t - 1][:, None] + moves[:, :, None], 0)
    total = _log_sum(forward[-1], 0)
    backward = np.zeros_like(emitted)
    for t in range(steps - 2, -1, -1):
        backward[t] = _log_sum(moves[:, :, None] + (emitted[t + 1] + backward[t + 1])[None], 1)
    given = np.exp(forward + backward - total)
    one = np.arange(size)[None, :, None] == tags[:, None]
    scale = 1.0 / (steps * lanes)
    path = (emitted * one).sum() + moves[tags[:-1], tags[1:]].sum()
    loss = float((total.sum() - path) * scale)

    d_emitted = ((given - one) * scale).astype(np.float32)
    d_moves = np.zeros_like(model.moves)
    for t in range(1, steps):
        pair = forward[t - 1][:, None] + moves[:, :, None] + (emitted[t] + backward[t])[None] - total
        d_moves += np.exp(pair).sum(axis=2) * scale
    np.subtract.at(d_moves, (tags[:-1].ravel(), tags[1:].ravel()), scale)
    kinds = np.arange(1, size)
    d_moves[1:, 1:][kinds[:, None] != kinds[None, :]] = 0

    d_out = np.einsum("tkb,thb->kh", d_emitted, joined)
    d_bias = d_emitted.sum(axis=(0, 2))
    d_joined = np.matmul(model.out.T, d_emitted)
    d_inputs, d_recurrent = np.zeros_like(model.inputs), np.zeros_like(model.recurrent)
    slope = np.full((4 * hidden, 1), 0.25, np.float32)
    slope[3 * hidden :] = 1.0
    low = np.zeros((4 * hidden, 1), np.float32)
    low[3 * hidden :] = -1.0
    for way in (0, 1):
        dh, dc = np.zeros((hidden, lanes), np.float32), np.zeros((hidden, lanes), np.float32)
        for t, before, z, last_c, c, last_h in reversed(kept[way]):
            i, f, o, g = z[:hidden], z[hidden : 2 * hidden], z[2 * hidden : 3 * hidden], z[3 * hidden :]
            dh = dh + d_joined[t, way * hidden : (way + 1) * hidden]
            clipped = np.clip(c, -1, 1)
            dc = dc + dh * o * (np.abs(c) < 1)
            dz = np.concatenate([dc * g, dc * last_c, dh * clipped, dc * i])
            dz *= (before > low) & (before < 1)
            dz *= slope
            dc = dc * f
            d_recurrent[way] += dz @ last_h.T
            hot = (codes[t][None] == np.arange(CODES)[:, None]).astype(np.float32)
            d_inputs[way] += dz @ hot.T
            dh = model.recurrent[way].T @ dz
    return loss, [d_inputs, d_recurrent, d_out, d_bias, d_moves]


def train(model: Tagger, codes: np.ndarray, tags: np.ndarray, *, steps: int, batch: int, rate: float, seed: int) -> list[float]:
    """Adam over random batches of the given windows (T, N); returns the losses."""
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(w) for w in model.weights]
    second = [np.zeros_like(w) for w in model.weights]
    losses = []
    for step in range(1, steps + 1):
        pick = rng.integers(0, codes.shape[1], batch)
        loss, gradients = loss_and_gradients(model, codes[:, pick], tags[:, pick])
        losses.append(loss)
        norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in gradients))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(model.weights, gradients, first, second):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return losses
