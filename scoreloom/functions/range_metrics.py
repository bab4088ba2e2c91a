"""Metrics of resampled histograms, range by range: what a resampling task hands on per replicate.

A range is a run of cells in a metric's order, from the top score down or from the most confident row
down. Its part of a metric is a few numbers per replicate, once it is known what was drawn before it;
parts merge by sums, maxima or minima.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Array = np.ndarray


@dataclass
class Range:
    """Drawn cells of a range. `p` and `q` are counts of fakes and reals by (replicate, cell), `tp` and
    `fp` those drawn before the range, `n_p` and `n_q` those of a whole replicate. In confidence order
    `s` is 1 for a wrong row, else 0, and `wrong` counts wrong rows drawn before."""

    s: Array
    p: Array
    q: Array
    tp: Array
    fp: Array
    wrong: Array
    n_p: int
    n_q: int

    def curve(self) -> tuple[Array, Array, Array, Array]:
        """FPR and TPR after and before each cell."""
        tp = self.tp[:, None] + np.cumsum(self.p, axis=1)
        fp = self.fp[:, None] + np.cumsum(self.q, axis=1)
        return fp / self.n_q, tp / self.n_p, (fp - self.q) / self.n_q, (tp - self.p) / self.n_p


def _where(hit: Array, value: Array) -> Array:
    """The value where each replicate has its one hit; not a number without one."""
    found = np.where(hit, value, -np.inf).max(axis=1)
    return np.where(hit.any(axis=1), found, np.nan)


def auc(r: Range) -> list[Array]:
    below = r.n_q - (r.fp[:, None] + np.cumsum(r.q, axis=1))
    return [(r.p * (below + 0.5 * r.q)).sum(axis=1) / (r.n_p * r.n_q)]


def ap(r: Range) -> list[Array]:
    tp = r.tp[:, None] + np.cumsum(r.p, axis=1)
    taken = tp + r.fp[:, None] + np.cumsum(r.q, axis=1)
    return [(r.p * tp / np.maximum(taken, 1)).sum(axis=1) / r.n_p]


def eer(r: Range) -> list[Array]:
    f1, t1, f0, t0 = r.curve()
    d0, d1 = f0 - (1 - t0), f1 - (1 - t1)
    hit = (d1 >= 0) & (d0 < 0)
    t = -d0 / np.where(hit, d1 - d0, 1.0)
    return [_where(hit, (f0 + t * (f1 - f0) + (1 - t0) + t * (t0 - t1)) / 2)]


def acc(r: Range, thr: float = 0.5) -> list[Array]:
    return [np.where(r.s >= thr, r.p, r.q).sum(axis=1) / (r.n_p + r.n_q)]


def _crossed(x: float, x1: Array, x0: Array, y1: Array, y0: Array) -> Array:
    hit = (x0 <= x) & (x1 > x)
    return _where(hit, y0 + (y1 - y0) / np.where(hit, x1 - x0, 1.0) * (x - x0))


def tpr(r: Range, fpr: float = 0.0, interp: bool = False) -> list[Array]:
    f1, t1, f0, t0 = r.curve()
    if interp:
        return [_crossed(fpr, f1, f0, t1, t0)]
    return [np.where(f1 <= fpr, t1, 0.0).max(axis=1)]


def fpr(r: Range, tpr: float = 1.0, interp: bool = False) -> list[Array]:
    f1, t1, f0, t0 = r.curve()
    if interp:
        return [_crossed(tpr, t1, t0, f1, f0)]
    return [np.where(t1 >= tpr, f1, 1.0).min(axis=1) if tpr > 0 else np.zeros(len(r.p))]


def brier(r: Range) -> list[Array]:
    return [(r.p * (r.s - 1) ** 2 + r.q * r.s**2).sum(axis=1) / (r.n_p + r.n_q)]


def nll(r: Range) -> list[Array]:
    s = np.clip(r.s, 1e-7, 1 - 1e-7)
    return [-(r.p * np.log(s) + r.q * np.log(1 - s)).sum(axis=1) / (r.n_p + r.n_q)]


def inner_quantiles(bins: int) -> Array:
    return np.linspace(0, 1, bins + 1)[1:-1]


def order_statistics(r: Range, bins: int = 15) -> list[Array]:
    """For each inner edge of equal-count bins, the scores it lies between, as far as they are here."""
    n = r.n_p + r.n_q
    after = (r.tp + r.fp)[:, None] + np.cumsum(r.p + r.q, axis=1)
    least, beyond = n - after, n - after + r.p + r.q  # places of a cell's rows from the lowest score up
    out = []
    for at in inner_quantiles(bins) * (n - 1):
        for place in (np.floor(at), np.ceil(at)):
            out.append(_where((least <= place) & (place < beyond), np.broadcast_to(r.s, r.p.shape)))
    return out


def ece(r: Range, bins: int = 15, edges: Array | None = None) -> list[Array]:
    """Per bin, sum of scores less number of fakes; `edges` (replicate, edge) bound equal-count bins."""
    gap = (r.p + r.q) * r.s - r.p
    if edges is None:
        which = np.broadcast_to(np.searchsorted(inner_quantiles(bins), r.s, side="right"), gap.shape)
    else:
        which = (r.s[None, :, None] >= edges[:, None, :]).sum(axis=2)
    return [np.where(which == b, gap, 0.0).sum(axis=1) / (r.n_p + r.n_q) for b in range(bins)]


def _harmonic(n: Array) -> Array:
    small = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, 64))])
    m = np.maximum(n, 1).astype(float)
    series = np.log(m) + np.euler_gamma + 1 / (2 * m) - 1 / (12 * m**2) + 1 / (120 * m**4)
    return np.where(n < 64, small[np.minimum(n, 63).astype(int)], series)


def aurc(r: Range) -> list[Array]:
    """A run of m equal rows adds the sum of (e0 + e*i) / (k0 + i), closed by harmonic numbers."""
    m = r.p + r.q
    k0 = (r.tp + r.fp)[:, None] + np.cumsum(m, axis=1) - m
    e0 = r.wrong[:, None] + np.cumsum(m * r.s, axis=1) - m * r.s
    part = r.s * m + (e0 - r.s * k0) * (_harmonic(k0 + m) - _harmonic(k0))
    return [part.sum(axis=1) / (r.n_p + r.n_q)]


@dataclass(frozen=True)
class RangeMetric:
    """A metric by ranges: its parts, how many and how they merge, and the value of merged parts."""

    part: Callable[..., list[Array]]
    merge: str = "sum"
    width: Callable[[dict], int] = lambda params: 1
    value: Callable[[Sequence[Column], dict], Column] = lambda parts, params: parts[0]


def _or_end(parts: Sequence[Column], params: dict) -> Column:
    """A curve that never leaves the asked rate ends at 1."""
    return F.coalesce(parts[0], F.lit(1.0)) if params.get("interp") else parts[0]


METRICS: dict[str, RangeMetric] = {
    "auc": RangeMetric(auc),
    "ap": RangeMetric(ap),
    "eer": RangeMetric(eer, "max"),
    "acc": RangeMetric(acc),
    "tpr": RangeMetric(tpr, "max", value=_or_end),
    "fpr": RangeMetric(fpr, "min", value=_or_end),
    "brier": RangeMetric(brier),
    "nll": RangeMetric(nll),
    "ece": RangeMetric(ece, width=lambda p: p.get("bins", 15), value=lambda parts, p: sum(map(F.abs, parts[1:]), F.abs(parts[0]))),
    "order_statistics": RangeMetric(order_statistics, "max", lambda p: 2 * (p.get("bins", 15) - 1)),
    "aurc": RangeMetric(aurc),
}
