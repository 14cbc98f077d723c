"""Log-bilinear language model over word classes, trained with noise-contrastive estimation (numpy).

A class is a frequent word of its own, a bucket of other words, or the end of a text. The vectors of
the two classes before, each scaled by a position vector, add up to a predicted vector; the score of
a class is the product of the predicted vector with the class's output vector plus its bias.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTH = 24
NOISE = 32
BATCH = 512
RATE = 0.15


@dataclass
class Model:
    """``near`` and ``far`` scale the vectors of the last class and the one before it."""

    inputs: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray
    near: np.ndarray
    far: np.ndarray

    @classmethod
    def start(cls, shares: np.ndarray, seed: int = 0) -> Model:
        """Random vectors and the classes' log shares as biases: a unigram model to begin with."""
        draw = np.random.default_rng(seed)
        classes = len(shares)
        vectors = lambda: (draw.standard_normal((classes, WIDTH)) * 0.1).astype(np.float32)
        return cls(
            vectors(), vectors(), np.log(shares).astype(np.float32),
            np.ones(WIDTH, np.float32), np.full(WIDTH, 0.5, np.float32),
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.inputs, self.outputs, self.bias, self.near, self.far

    @classmethod
    def from_flat(cls, values: np.ndarray, classes: int) -> Model:
        sizes = [classes * WIDTH, classes * WIDTH, classes, WIDTH, WIDTH]
        a, b, c, d, e = np.split(np.asarray(values, np.float32), np.cumsum(sizes)[:-1])
        return cls(a.reshape(classes, WIDTH), b.reshape(classes, WIDTH), c, d, e)


def _rows_added(index: np.ndarray, values: np.ndarray, classes: int) -> np.ndarray:
    flat = (index[:, None] * WIDTH + np.arange(WIDTH)).ravel()
    return np.bincount(flat, values.ravel(), classes * WIDTH).reshape(classes, WIDTH).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Trainer:
    """Noise-contrastive estimation with AdaGrad; noise classes are shared by a batch."""

    def __init__(self, model: Model, shares: np.ndarray, seed: int) -> None:
        self.model, self.classes = model, len(shares)
        self._draw = np.random.default_rng(seed)
        self._edges = np.cumsum(shares)
        self._log_noise = np.log(NOISE * shares).astype(np.float32)
        self._squares = [np.full(p.shape, 1e-3, np.float32) for p in model.parts()]

    def _step(self, place: int, gradient: np.ndarray) -> None:
        squares, part = self._squares[place], self.model.parts()[place]
        squares += gradient * gradient
        part -= RATE * gradient / np.sqrt(squares)

    def learn(self, last: np.ndarray, before: np.ndarray, target: np.ndarray) -> None:
        for at in range(0, len(target), BATCH):
            cut = slice(at, at + BATCH)
            self._learn_batch(last[cut], before[cut], target[cut])

    def _learn_batch(self, last: np.ndarray, before: np.ndarray, target: np.ndarray) -> None:
        m, rows = self.model, len(target)
        one, two = m.inputs[last], m.inputs[before]
        predicted = one * m.near + two * m.far
        noise = np.minimum(
            np.searchsorted(self._edges, self._draw.random(NOISE), side="right"), self.classes - 1
        )
        out, noisy = m.outputs[target], m.outputs[noise]
        true = np.einsum("ij,ij->i", predicted, out) + m.bias[target] - self._log_noise[target]
        false = predicted @ noisy.T + (m.bias[noise] - self._log_noise[noise])
        g_true = ((_sigmoid(true) - 1.0) / rows).astype(np.float32)
        g_false = (_sigmoid(false) / rows).astype(np.float32)
        g_predicted = g_true[:, None] * out + g_false @ noisy
        g_outputs = _rows_added(target, g_true[:, None] * predicted, self.classes)
        np.add.at(g_outputs, noise, g_false.T @ predicted)
        g_bias = np.bincount(target, g_true, self.classes) + np.bincount(
            noise, g_false.sum(axis=0), self.classes
        )
        g_inputs = _rows_added(
            np.concatenate([last, before]),
            np.concatenate([g_predicted * m.near, g_predicted * m.far]),
            self.classes,
        )
        self._step(0, g_inputs)
        self._step(1, g_outputs)
        self._step(2, g_bias.astype(np.float32))
        self._step(3, (g_predicted * one).sum(axis=0))
        self._step(4, (g_predicted * two).sum(axis=0))


class Scorer:
    """Normalised log10 probabilities; the sum over all classes is taken once for every context."""

    def __init__(self, model: Model) -> None:
        self._model = model
        near, far = model.inputs * model.near, model.inputs * model.far
        classes = len(model.bias)
        self._log_total = np.empty((classes, classes), np.float32)
        for last in range(classes):
            scores = (near[last] + far) @ model.outputs.T + model.bias
            most = scores.max(axis=1)
            self._log_total[last] = most + np.log(np.exp(scores - most[:, None]).sum(axis=1))
        self._near, self._far = near, far

    def log10(self, last: np.ndarray, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        predicted = self._near[last] + self._far[before]
        score = np.einsum("ij,ij->i", predicted, self._model.outputs[target]) + self._model.bias[target]
        return (score - self._log_total[last, before]).astype(np.float64) / np.log(10.0)
