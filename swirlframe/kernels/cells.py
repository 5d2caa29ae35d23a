"""Nearest neighbours in memory, and the tree of adaptive cells that deals points to tasks."""

from __future__ import annotations

import numpy as np

#: Points of a bucket, the unit in which distances are taken.
BUCKET = 32
#: Squared distances are held against bounds with this much room for rounding.
ROOM = 1 + 1e-12


def split(x: np.ndarray, y: np.ndarray, most: int) -> list[np.ndarray]:
    """Indices of points in cells of at most ``most``, halved at the median of the wider side; equal points stay together if need be."""
    todo, out = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= most:
            out.append(at)
            continue
        wide = x if np.ptp(x[at]) >= np.ptp(y[at]) else y
        order = at[np.argsort(wide[at], kind="stable")]
        todo += [order[: len(at) // 2], order[len(at) // 2 :]]
    return out


class Tree:
    """Cells of one key: halves at sampled medians until a cell holds ``most`` sampled points. ``cell`` tells where points lie."""

    def __init__(self, x: np.ndarray, y: np.ndarray, most: int) -> None:
        self.axis, self.at, self.below, self.cells = [], [], [], 0
        todo = [(np.arange(len(x)), None)]
        while todo:
            own, hook = todo.pop()
            here = len(self.axis)
            if hook is not None:
                self.below[hook[0]][hook[1]] = here
            axis = int(np.ptp(y[own]) > np.ptp(x[own]))
            value = (x, y)[axis][own]
            if len(own) <= most or value.min() == value.max():
                self.axis.append(-1)
                self.at.append(0.0)
                self.below.append([self.cells, self.cells])
                self.cells += 1
                continue
            left = value <= np.median(value)
            left = value < value.max() if left.all() else left
            self.axis.append(axis)
            self.at.append(float(value[left].max()))  # a point goes left if it is at most this
            self.below.append([0, 0])
            todo += [(own[~left], (here, 1)), (own[left], (here, 0))]

    def cell(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        axis, at, below = np.array(self.axis), np.array(self.at), np.array(self.below)
        node = np.zeros(len(x), np.int64)
        while (inner := axis[node] >= 0).any():
            k = node[inner]
            right = np.where(axis[k] == 0, x[inner], y[inner]) > at[k]
            node[inner] = below[k, right.astype(int)]
        return below[node, 0]


def boxes(x: np.ndarray, y: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """(x0, x1, y0, y1) of each group."""
    return np.array([[x[g].min(), x[g].max(), y[g].min(), y[g].max()] for g in groups]).reshape(-1, 4)


def nearest_of_boxes(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances from a box to the nearest place of others."""
    dx = np.maximum(0, np.maximum(others[:, 0] - box[1], box[0] - others[:, 1]))
    dy = np.maximum(0, np.maximum(others[:, 2] - box[3], box[2] - others[:, 3]))
    return dx * dx + dy * dy


def farthest_of_boxes(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances between the farthest places of a box and of others."""
    dx = np.maximum(others[:, 1] - box[0], box[1] - others[:, 0])
    dy = np.maximum(others[:, 3] - box[2], box[3] - others[:, 2])
    return dx * dx + dy * dy


def bound(box: np.ndarray, others: np.ndarray, counts: np.ndarray, k: int) -> float:
    """A squared distance within which every place of a box has k points of the others (infinite if they hold fewer)."""
    far = farthest_of_boxes(box, others)
    order = np.argsort(far, kind="stable")
    have = np.searchsorted(np.cumsum(counts[order]), k)
    return float(far[order[have]]) * ROOM if have < len(order) else np.inf


class Points:
    """Points in buckets; of equally near ones the first come first, so they are given in order of their ids."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.x, self.y, self.groups = x, y, split(x, y, BUCKET)
        self.boxes, self.counts = boxes(x, y, self.groups), np.array([len(g) for g in self.groups])

    def nearest(self, x: np.ndarray, y: np.ndarray, k: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, squared distance) of each query's k nearest, in order; only those at most ``within`` (squared) away, if given.

        Queries go by buckets of their own: a bucket meets the points' buckets that can hold one of its k nearest, and no other.
        """
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for q in split(x, y, BUCKET) if len(self.x) and len(x) else []:
            box = boxes(x, y, [q])[0]
            far = bound(box, self.boxes, self.counts, k)
            if within is not None:
                far = min(far, float(within[q].max()))
            near = np.flatnonzero(nearest_of_boxes(box, self.boxes) <= far * ROOM)
            if not len(near):
                continue
            c = np.sort(np.concatenate([self.groups[g] for g in near]))
            with np.errstate(over="ignore"):
                dx, dy = self.x[c][None, :] - x[q][:, None], self.y[c][None, :] - y[q][:, None]
                d = dx * dx + dy * dy
            m = min(k, len(c))
            limit = np.partition(d, m - 1, axis=1)[:, m - 1]
            if within is not None:
                limit = np.minimum(limit, within[q])
            few = (d <= limit[:, None]).any(axis=0)
            c, d = c[few], d[:, few]
            m = min(k, len(c))
            order = np.argsort(d, axis=1, kind="stable")[:, :m]
            d = np.take_along_axis(d, order, axis=1)
            fine = d <= limit[:, None]
            out.append((np.repeat(q, fine.sum(axis=1)), c[order][fine], d[fine]))
        a, b, d = (np.concatenate(v) for v in zip(*out, strict=True))
        order = np.argsort(a, kind="stable")
        return a[order], b[order], d[order]
