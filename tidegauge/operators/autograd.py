"""Reverse-mode derivatives over numpy arrays, enough for small networks in one task."""

from __future__ import annotations

import numpy as np


def _shaped(g: np.ndarray, shape: tuple) -> np.ndarray:
    """The gradient summed over what was broadcast."""
    while g.ndim > len(shape):
        g = g.sum(0)
    for i, n in enumerate(shape):
        if n == 1 and g.shape[i] != 1:
            g = g.sum(i, keepdims=True)
    return g


class V:
    """An array with the arrays that it was made from, and how a gradient goes back to them."""

    __array_priority__ = 1000

    def __init__(self, value, parents: tuple = (), back=None):
        self.value, self.parents, self.back, self.grad = np.asarray(value, float), parents, back, None

    @property
    def shape(self):
        return self.value.shape

    def __add__(self, o):
        o = var(o)
        return V(self.value + o.value, (self, o), lambda g: (_shaped(g, self.shape), _shaped(g, o.shape)))

    __radd__ = __add__

    def __neg__(self):
        return self * -1.0

    def __sub__(self, o):
        return self + var(o) * -1.0

    def __rsub__(self, o):
        return var(o) - self

    def __mul__(self, o):
        o = var(o)
        return V(self.value * o.value, (self, o), lambda g: (_shaped(g * o.value, self.shape), _shaped(g * self.value, o.shape)))

    __rmul__ = __mul__

    def __truediv__(self, o):
        return self * var(o).power(-1)

    def power(self, p: float):
        return V(self.value**p, (self,), lambda g: (g * p * self.value ** (p - 1),))

    def __matmul__(self, o):
        o = var(o)

        def back(g):
            return _shaped(g @ np.swapaxes(o.value, -1, -2), self.shape), _shaped(np.swapaxes(self.value, -1, -2) @ g, o.shape)

        return V(self.value @ o.value, (self, o), back)

    def __getitem__(self, at):
        once = all(i is Ellipsis or isinstance(i, int | slice) for i in (at if isinstance(at, tuple) else (at,)))

        def back(g):
            out = np.zeros(self.shape)
            if once:
                out[at] = g
            else:
                np.add.at(out, at, g)
            return (out,)

        return V(self.value[at], (self,), back)

    def sum(self, axis=None, keepdims=False):
        def back(g):
            if axis is not None and not keepdims:
                g = np.expand_dims(g, axis)
            return (np.broadcast_to(g, self.shape),)

        return V(self.value.sum(axis, keepdims=keepdims), (self,), back)

    def mean(self, axis=None, keepdims=False):
        n = self.value.size if axis is None else self.shape[axis]
        return self.sum(axis, keepdims) * (1.0 / n)

    def reshape(self, *shape):
        return V(self.value.reshape(*shape), (self,), lambda g: (g.reshape(self.shape),))

    def swap(self, a=-1, b=-2):
        return V(np.swapaxes(self.value, a, b), (self,), lambda g: (np.swapaxes(g, a, b),))

    def tanh(self):
        y = np.tanh(self.value)
        return V(y, (self,), lambda g: (g * (1 - y * y),))

    def sigmoid(self):
        y = 1 / (1 + np.exp(-np.clip(self.value, -60, 60)))
        return V(y, (self,), lambda g: (g * y * (1 - y),))

    def relu(self):
        return V(np.maximum(self.value, 0), (self,), lambda g: (g * (self.value > 0),))

    def exp(self):
        y = np.exp(np.clip(self.value, -60, 60))
        return V(y, (self,), lambda g: (g * y,))

    def log(self):
        return V(np.log(np.maximum(self.value, 1e-12)), (self,), lambda g: (g / np.maximum(self.value, 1e-12),))

    def softplus(self):
        return V(np.logaddexp(0, self.value), (self,), lambda g: (g / (1 + np.exp(-np.clip(self.value, -60, 60))),))

    def softmax(self, axis=-1):
        e = np.exp(self.value - self.value.max(axis, keepdims=True))
        y = e / e.sum(axis, keepdims=True)
        return V(y, (self,), lambda g: (y * (g - (g * y).sum(axis, keepdims=True)),))

    def backward(self) -> None:
        """Sets grad of all that this number came from."""
        order, seen = [], set()
        stack = [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack.append((v, True))
                stack += [(p, False) for p in v.parents]
        for v in order:
            v.grad = None
        self.grad = np.ones(self.shape)
        for v in reversed(order):
            if v.back is None or v.grad is None:
                continue
            for p, g in zip(v.parents, v.back(v.grad), strict=True):
                p.grad = g if p.grad is None else p.grad + g


def var(x) -> V:
    return x if isinstance(x, V) else V(x)


def concat(parts: list[V], axis: int = -1) -> V:
    cut = np.cumsum([p.shape[axis] for p in parts])[:-1]
    return V(np.concatenate([p.value for p in parts], axis), tuple(parts), lambda g: tuple(np.split(g, cut, axis)))


def stack(parts: list[V], axis: int = 1) -> V:
    return V(np.stack([p.value for p in parts], axis), tuple(parts), lambda g: tuple(np.moveaxis(g, axis, 0)))


class Weights:
    """Named weights, drawn when first asked for, and Adam over all of them."""

    def __init__(self, seed: int = 0):
        self.rng, self.all, self.moments, self.steps = np.random.default_rng(seed), {}, {}, 0

    def __call__(self, name: str, *shape: int, scale: float | None = None, start: np.ndarray | None = None) -> V:
        if name not in self.all:
            value = start if start is not None else self.rng.standard_normal(shape) * (scale if scale is not None else 1 / np.sqrt(max(1, shape[0])))
            self.all[name] = V(np.array(value, float))
        return self.all[name]

    def linear(self, name: str, x: V, out: int) -> V:
        return x @ self(f"{name}.w", x.shape[-1], out) + self(f"{name}.b", out, scale=0.0)

    def step(self, loss: V, rate: float = 0.01, only: str = "") -> float:
        """One step of Adam on the weights whose names start with `only`."""
        loss.backward()
        self.steps += 1
        for k, p in self.all.items():
            if p.grad is None or not k.startswith(only):
                continue
            g = np.clip(p.grad, -5, 5)
            m, v = self.moments.setdefault(k, (np.zeros(p.shape), np.zeros(p.shape)))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p.value = p.value - rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
        return float(loss.value)


class Many(Weights):
    """The weights of n networks side by side, each as one of Weights alone is drawn and moved: a first axis counts them."""

    def __init__(self, n: int, seed: int = 0):
        super().__init__(seed)
        self.n = n

    def __call__(self, name: str, *shape: int, scale: float | None = None, start: np.ndarray | None = None) -> V:
        if name not in self.all:
            value = super().__call__(name, *shape, scale=scale, start=start).value
            self.all[name] = V(np.repeat(value[None] if value.ndim > 1 else value[None, None], self.n, 0))
        return self.all[name]
