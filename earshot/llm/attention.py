"""A network that reads a text as a bag of passages: gated attention weighs them, the weighted passage is scored.

Hidden ``h = tanh(x W + b)`` for every passage, gate ``tanh(h V) * sigmoid(h U)``, weight the softmax of
``gate . w`` over the passages of a text, score ``sigmoid(c . sum(weight h) + d)``. Trained from labels of
whole texts by Adam on the cross entropy.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

HIDDEN = 24
GATES = 16
EPOCHS = 15
BATCH = 64
RATE = 0.004
DECAY = 1e-4
SEED = 12


class Network(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    tanh_gate: np.ndarray
    sigmoid_gate: np.ndarray
    attention: np.ndarray
    output: np.ndarray
    output_bias: np.ndarray


LEARNED = Network._fields[2:]


class Bag(NamedTuple):
    """Passages of a text, or of some of them: largest attention, sum of weights, weighted sum of hidden values."""

    largest: np.ndarray
    weight: np.ndarray
    hidden: np.ndarray


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def started(x: np.ndarray) -> Network:
    rng = np.random.default_rng(SEED)
    n = x.shape[1]

    def drawn(*shape: int) -> np.ndarray:
        return rng.standard_normal(shape) / np.sqrt(shape[0])

    mean = x.mean(axis=0, dtype=np.float64) if len(x) else np.zeros(n)
    scale = x.std(axis=0, dtype=np.float64) if len(x) else np.ones(n)
    scale = np.maximum(scale, 1e-3)
    shapes = drawn(n, HIDDEN), np.zeros(HIDDEN), drawn(HIDDEN, GATES), drawn(HIDDEN, GATES), drawn(GATES)
    return Network(mean, scale, *shapes, np.zeros(HIDDEN), np.zeros(1))


def _forward(net: Network, x: np.ndarray) -> tuple[np.ndarray, ...]:
    h = np.tanh(((x - net.mean) / net.scale).clip(-8, 8) @ net.hidden + net.hidden_bias)
    t, s = np.tanh(h @ net.tanh_gate), sigmoid(h @ net.sigmoid_gate)
    return h, t, s, (t * s) @ net.attention


def bags(net: Network, x: np.ndarray, counts: np.ndarray) -> Bag:
    """One bag for each run of ``counts`` passages."""
    h, _, _, attention = _forward(net, x)
    begins = np.cumsum(counts) - counts
    largest = np.maximum.reduceat(attention, begins)
    weight = np.exp(attention - np.repeat(largest, counts))
    return Bag(largest, np.add.reduceat(weight, begins), np.add.reduceat(weight[:, None] * h, begins))


def merged(bag: Bag, counts: np.ndarray) -> Bag:
    """Bags of whole texts from bags of ``counts`` pieces each."""
    begins = np.cumsum(counts) - counts
    largest = np.maximum.reduceat(bag.largest, begins)
    factor = np.exp(bag.largest - np.repeat(largest, counts))
    return Bag(largest, np.add.reduceat(factor * bag.weight, begins), np.add.reduceat(factor[:, None] * bag.hidden, begins))


def scores(net: Network, bag: Bag) -> np.ndarray:
    return sigmoid(bag.hidden / bag.weight[:, None] @ net.output + net.output_bias[0])


def slopes(net: Network, x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of whole texts, and its slopes."""
    h, t, s, attention = _forward(net, x)
    begins, owner = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
    weight = np.exp(attention - np.maximum.reduceat(attention, begins)[owner])
    weight /= np.add.reduceat(weight, begins)[owner]
    z = np.add.reduceat(weight[:, None] * h, begins)
    p = sigmoid(z @ net.output + net.output_bias[0]).clip(1e-7, 1 - 1e-7)
    loss = -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))
    d_out = (p - labels) / len(labels)
    d_z = d_out[:, None] * net.output
    d_weight = (h * d_z[owner]).sum(axis=1)
    mean = np.add.reduceat(weight * d_weight, begins)
    d_attention = weight * (d_weight - mean[owner])
    d_gate = d_attention[:, None] * net.attention
    d_t, d_s = d_gate * s * (1 - t * t), d_gate * t * s * (1 - s)
    d_h = weight[:, None] * d_z[owner] + d_t @ net.tanh_gate.T + d_s @ net.sigmoid_gate.T
    d_h *= 1 - h * h
    scaled = ((x - net.mean) / net.scale).clip(-8, 8)
    return loss, {
        "hidden": scaled.T @ d_h,
        "hidden_bias": d_h.sum(axis=0),
        "tanh_gate": h.T @ d_t,
        "sigmoid_gate": h.T @ d_s,
        "attention": (t * s).T @ d_attention,
        "output": z.T @ d_out,
        "output_bias": np.array([d_out.sum()]),
    }


def trained(x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Network:
    """Fitted to texts of ``counts`` passages each; without texts every score is one half."""
    net = started(x)
    first, second = ({name: np.zeros_like(getattr(net, name)) for name in LEARNED} for _ in range(2))
    begins, rng, step = np.cumsum(counts) - counts, np.random.default_rng(SEED), 0
    n_steps = EPOCHS * -(-len(counts) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(counts))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            rows = np.concatenate([np.arange(begins[i], begins[i] + counts[i]) for i in chosen])
            _, found = slopes(net, x[rows], counts[chosen], labels[chosen])
            step += 1
            rate = RATE * (1 - 0.9 * step / n_steps)
            new = {}
            for name in LEARNED:
                slope = found[name] + DECAY * getattr(net, name)
                first[name] = 0.9 * first[name] + 0.1 * slope
                second[name] = 0.999 * second[name] + 0.001 * slope * slope
                by = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                new[name] = getattr(net, name) - rate * by
            net = net._replace(**new)
    return net
