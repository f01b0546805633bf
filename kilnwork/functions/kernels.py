"""Geometry kernels in numpy, for use within Arrow and pandas functions. Curves are arrays of shape (n, 2)."""

from __future__ import annotations

import difflib
import re

import numpy as np


def resample(curve: np.ndarray, n: int, begin: float = 0.0, end: float = 1.0) -> np.ndarray:
    """n points at even arc length between two shares of a curve's length."""
    step = np.hypot(*np.diff(curve, axis=0).T)
    at = np.concatenate([[0.0], np.cumsum(step)])
    if at[-1] == 0:
        return np.repeat(curve[:1], n, axis=0)
    wanted = np.linspace(begin, end, n) * at[-1]
    return np.stack([np.interp(wanted, at, curve[:, k]) for k in range(2)], axis=1)


def pair_distances(points: np.ndarray) -> np.ndarray:
    """Distances of all pairs over their 90th percentile."""
    i, j = np.triu_indices(len(points), 1)
    d = np.hypot(*(points[i] - points[j]).T)
    scale = np.quantile(d, 0.9)
    return d / scale if scale > 0 else d


def turns(points: np.ndarray) -> np.ndarray:
    """Cosines and sines of the turns at inner points."""
    step = np.diff(points, axis=0)
    angle = np.diff(np.arctan2(step[:, 1], step[:, 0]))
    return np.concatenate([np.cos(angle), np.sin(angle)])


def outline_descriptor(curve: np.ndarray, samples: int = 20) -> np.ndarray:
    """Pair distances (weight .75) and turns (.25): the same after moving, turning and scaling. 226 numbers at 20 samples."""
    p = resample(curve, samples)
    d, t = pair_distances(p), turns(p)
    return np.concatenate([np.sqrt(0.75 / len(d)) * d, np.sqrt(0.25 / len(t)) * t]).astype(np.float32)


def ribbon_descriptor(wall_a: np.ndarray, wall_b: np.ndarray, samples: int = 12) -> np.ndarray:
    """Pair distances of both walls' points (.70), thickness (.20) and agreement of their tangents (.10). 299 numbers at 12 samples."""
    a, b = resample(wall_a, samples), resample(wall_b, samples)
    d = pair_distances(np.concatenate([a, b]))
    thick = np.hypot(*(a - b).T)
    scale = np.quantile(np.hypot(*(np.concatenate([a, b]) - np.concatenate([a, b]).mean(axis=0)).T), 0.9)
    s, t = np.diff(a, axis=0), np.diff(b, axis=0)
    agree = (s * t).sum(axis=1) / np.maximum(np.hypot(*s.T) * np.hypot(*t.T), 1e-12)
    parts = [(0.70, d), (0.20, thick / scale if scale > 0 else thick), (0.10, agree)]
    return np.concatenate([np.sqrt(w / len(x)) * x for w, x in parts]).astype(np.float32)


def split_at(curve: np.ndarray, seam: float) -> tuple[np.ndarray, np.ndarray]:
    """One boundary as two walls that both begin at the seam, a share of its length within .05 and .95."""
    seam = min(max(seam, 0.05), 0.95)
    n = len(curve)
    return resample(curve, n, 0.0, seam)[::-1], resample(curve, n, seam, 1.0)


def gaussian(values: np.ndarray, sigma: float) -> np.ndarray:
    """Smoothed by a Gaussian cut at 4 sigma, the ends carried on."""
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, r, mode="edge"), k / k.sum(), mode="valid")


def curvature(curve: np.ndarray, sigma: float = 1.5) -> np.ndarray:
    x, y = gaussian(curve[:, 0], sigma), gaussian(curve[:, 1], sigma)
    dx, dy = np.gradient(x), np.gradient(y)
    return (dx * np.gradient(dy) - dy * np.gradient(dx)) / np.maximum((dx * dx + dy * dy) ** 1.5, 1e-12)


def persistent_curvature(curve: np.ndarray, sigmas: tuple[float, ...] = (0.75, 1.5, 3.0, 6.0)) -> np.ndarray:
    """The mean curvature over scales where its sign agrees with the mean's, by the share of scales that agree."""
    k = np.stack([curvature(curve, s) for s in sigmas])
    mean = k.mean(axis=0)
    return mean * (np.sign(k) == np.sign(mean)).mean(axis=0)


def similarity(a: np.ndarray, b: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation (never a reflection) and shift that bring a onto b with the least weighted squares."""
    w = np.ones(len(a)) if weight is None else weight
    w = w / w.sum()
    ca, cb = w @ a, w @ b
    x, y = a - ca, b - cb
    u, s, vt = np.linalg.svd((w[:, None] * x).T @ y)
    flip = np.array([1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    turn = u @ np.diag(flip) @ vt
    scale = float((s * flip).sum() / max((w * (x * x).sum(axis=1)).sum(), 1e-12))
    return scale, turn, cb - scale * ca @ turn


def isotonic(values: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing sequence by least squares: neighbours that violate the order are pooled."""
    total, size = [], []
    for v in np.asarray(values, float).tolist():
        total.append(v)
        size.append(1)
        while len(total) > 1 and total[-2] * size[-1] >= total[-1] * size[-2]:
            t, n = total.pop(), size.pop()
            total[-1] += t
            size[-1] += n
    return np.repeat([t / n for t, n in zip(total, size, strict=True)], size)


def banded_dtw(cost: np.ndarray, band: int, penalty: float = 0.025) -> tuple[float, list[tuple[int, int]]]:
    """The cheapest monotone path through a cost matrix within a band about its diagonal; steps along one side cost a penalty more."""
    n, m = cost.shape
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0
    for i in range(1, n + 1):
        centre = round(i * m / n)
        for j in range(max(1, centre - band), min(m, centre + band) + 1):
            total[i, j] = cost[i - 1, j - 1] + min(total[i - 1, j - 1], total[i - 1, j] + penalty, total[i, j - 1] + penalty)
    path, i, j = [], n, m
    while i > 0 and j > 0 and np.isfinite(total[i, j]):
        path.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda p: total[p] + (penalty if p != (i - 1, j - 1) else 0))
    return float(total[n, m]), path[::-1]


def transport(a: np.ndarray, b: np.ndarray, feature_cost: np.ndarray, alpha: float = 0.55, rounds: int = 250, tolerance: float = 1e-7) -> tuple[np.ndarray, float]:
    """Fused Gromov-Wasserstein with the first margin held and the second free, by conditional gradients.

    a and b are the distance matrices within the two curves. Each step moves the mass of each row to its best column
    and takes the best step length of a quadratic. Returns the plan and its cost.
    """
    n, m = feature_cost.shape
    p = np.full(n, 1 / n)
    plan = np.outer(p, np.full(m, 1 / m))
    a2, b2 = a * a, b * b

    def gromov(x: np.ndarray, y: np.ndarray) -> float:
        return float((x * ((a2 @ y.sum(axis=1))[:, None] + (b2 @ y.sum(axis=0))[None, :] - 2 * a @ y @ b)).sum())

    def cost(x: np.ndarray) -> float:
        return (1 - alpha) * float((feature_cost * x).sum()) + alpha * gromov(x, x)

    now = cost(plan)
    for _ in range(rounds):
        slope = (1 - alpha) * feature_cost + 2 * alpha * ((a2 @ plan.sum(axis=1))[:, None] + (b2 @ plan.sum(axis=0))[None, :] - 2 * a @ plan @ b)
        goal = np.zeros_like(plan)
        goal[np.arange(n), slope.argmin(axis=1)] = p
        move = goal - plan
        square, line = alpha * gromov(move, move), float((slope * move).sum())
        step = 1.0 if square <= 0 else min(1.0, max(0.0, -line / (2 * square)))
        after = cost(plan + step * move)
        if now - after < tolerance:
            break
        plan, now = plan + step * move, after
    return plan, now


def salience(a: np.ndarray, b: np.ndarray, window: float = 0.05) -> float:
    """How far two curves' marked bends are apart, both ways: 0 for the same, 1 where none has a partner."""

    def one_way(x: np.ndarray, y: np.ndarray) -> float:
        k, other = np.abs(persistent_curvature(x)), np.abs(persistent_curvature(y))
        r = max(1, int(window * len(other)))
        best = np.array([other[max(0, round(i * len(other) / len(k)) - r) : round(i * len(other) / len(k)) + r + 1].max() for i in range(len(k))])
        return float((k * np.clip(1 - best / np.maximum(k, 1e-9), 0, 1)).sum() / max(k.sum(), 1e-9))

    return (one_way(a, b) + one_way(b, a)) / 2


def hausdorff95(a: np.ndarray, b: np.ndarray) -> float:
    d = np.hypot(*(a[:, None, :] - b[None, :, :]).transpose(2, 0, 1))
    return float(max(np.quantile(d.min(axis=1), 0.95), np.quantile(d.min(axis=0), 0.95)))


def edge_of(mask: np.ndarray) -> np.ndarray:
    """(row, column) of a mask's pixels with a neighbour outside."""
    m = np.pad(mask.astype(bool), 1)
    inner = m[:-2, 1:-1] & m[2:, 1:-1] & m[1:-1, :-2] & m[1:-1, 2:]
    return np.argwhere(m[1:-1, 1:-1] & ~inner)


def segmentation_metrics(found: np.ndarray, truth: np.ndarray, tolerance: float = 3.0) -> dict[str, float]:
    """Overlap of two masks of one shape, the share of edges within a tolerance (as F1), and distances between the edges."""
    a, b = found.astype(bool), truth.astype(bool)
    if a.shape != b.shape:
        raise ValueError("masks differ in shape")
    common, union = int((a & b).sum()), int((a | b).sum())
    out = {"iou": common / union if union else 1.0, "dice": 2 * common / (a.sum() + b.sum()) if union else 1.0}
    p, q = edge_of(a), edge_of(b)
    if not len(p) or not len(q):
        return out | {"boundary_f1": float(len(p) == len(q)), "hd95": 0.0 if len(p) == len(q) else np.inf, "mean_distance": 0.0 if len(p) == len(q) else np.inf}
    near = lambda x, y: np.concatenate([np.sqrt(((x[i : i + 512, None] - y[None]) ** 2).sum(axis=2)).min(axis=1) for i in range(0, len(x), 512)])
    d, e = near(p, q), near(q, p)
    precision, recall = (d <= tolerance).mean(), (e <= tolerance).mean()
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    return out | {"boundary_f1": float(f1), "hd95": float(max(np.quantile(d, 0.95), np.quantile(e, 0.95))), "mean_distance": float((d.mean() + e.mean()) / 2)}


def synthetic_query(curve: np.ndarray, seed: int, coverage: float, noise: float) -> np.ndarray:
    """A part of a curve with correlated noise, turned, scaled and moved; conditions with one seed are paired."""
    rng = np.random.default_rng(seed)
    angle, scale, shift = rng.uniform(-np.pi / 6, np.pi / 6), rng.uniform(0.7, 1.4), rng.normal(size=2)
    shake = rng.normal(size=curve.shape)
    part = resample(curve, len(curve), 0.0, coverage)
    size = np.ptp(curve, axis=0).max()
    part = part + noise * size * np.stack([gaussian(shake[:, k], 3.0) for k in range(2)], axis=1)
    c, s = np.cos(angle), np.sin(angle)
    return scale * part @ np.array([[c, -s], [s, c]]) + shift


def header_score(seen: str, wanted: tuple[str, ...] | str) -> float:
    """The best of a heading's spellings, letters and digits alone: 1 for the same, .84 (.70 below three letters) where one
    begins the other, else the share of matching blocks; 0 for a blank."""
    plain = lambda t: "".join(c for c in (t or "").lower() if c.isascii() and c.isalnum())
    a, best = plain(seen), 0.0
    for b in map(plain, (wanted,) if isinstance(wanted, str) else wanted) if a else ():
        if a == b:
            score = 1.0
        elif a.startswith(b) or b.startswith(a):
            score = 0.84 if min(len(a), len(b)) >= 3 else 0.70
        else:
            score = difflib.SequenceMatcher(None, a, b).ratio()
        best = max(best, score)
    return best


def split_heading(text: str, left: float, right: float, known: set[str]) -> list[tuple[str, float, float]]:
    """A token that holds two to nine words, two of them known headings, as one token for each word, by their lengths."""
    parts = re.findall(r"[A-Za-z]+(?:/[A-Za-z]+)?", text)
    plain = ["".join(c for c in p.lower() if c.isalnum()) for p in parts]
    if not 2 <= len(parts) <= 9 or sum(p in known for p in plain) < 2:
        return [(text, left, right)]
    total, at, out = sum(map(len, parts)), left, []
    for p in parts:
        width = (right - left) * len(p) / total
        out.append((p, at, at + width))
        at += width
    return out


def merged_rules(rules: list[tuple[int, int, int, int]], height: int) -> list[tuple[int, int, int, int]]:
    """Rules (y, left, right, thickness) of at least .7 of the longest, those within max(3, .0018 of the height) of the one
    before as one: its mean height, and the widest reach of both."""
    if not rules:
        return []
    longest, near = max(r[2] - r[1] for r in rules), max(3, round(height * 0.0018))
    out: list[tuple[int, int, int, int]] = []
    for y, left, right, thick in sorted(r for r in rules if r[2] - r[1] >= 0.7 * longest):
        if out and abs(y - out[-1][0]) <= near:
            a = out[-1]
            out[-1] = round((a[0] + y) / 2), min(a[1], left), max(a[2], right), max(a[3], thick)
        else:
            out.append((y, left, right, thick))
    return out


def lines_of(centres: np.ndarray, heights: np.ndarray, least: float = 5.0, share: float = 0.65, most: float = np.inf) -> np.ndarray:
    """The line of each token (by its centre, top first): a new one where a centre is beyond the running mean by ``share`` of the median height, at least ``least`` and at most ``most``."""
    order = np.argsort(centres, kind="stable")
    gap = max(least, min(most, share * float(np.median(heights)))) if len(heights) else least
    out = np.zeros(len(centres), int)
    line, total, n = -1, 0.0, 0
    for i in order.tolist():
        if n == 0 or abs(centres[i] - total / n) > gap:
            line, total, n = line + 1, 0.0, 0
        out[i] = line
        total, n = total + float(centres[i]), n + 1
    return out


def greedy_boxes(found: np.ndarray, prior: np.ndarray, free: np.ndarray, least: float = 0.5) -> np.ndarray:
    """For each found box in order, the prior box, not taken yet, that it overlaps most, or -1 below ``least``; the first of equals."""
    free = free.copy()
    out = np.full(len(found), -1)
    for i, (x1, y1, x2, y2) in enumerate(found.tolist()):
        if not len(prior):
            break
        w = np.clip(np.minimum(x2, prior[:, 2]) - np.maximum(x1, prior[:, 0]), 0, None)
        h = np.clip(np.minimum(y2, prior[:, 3]) - np.maximum(y1, prior[:, 1]), 0, None)
        union = (x2 - x1) * (y2 - y1) + (prior[:, 2] - prior[:, 0]) * (prior[:, 3] - prior[:, 1]) - w * h
        v = np.where(free & (union > 0), w * h / np.maximum(union, 1e-12), -1.0)
        k = int(v.argmax())
        if v[k] >= least:
            out[i], free[k] = k, False
    return out


def pack(sizes: list[tuple[float, float]], width: float, height: float) -> list[tuple[int, float, float]]:
    """(sheet, x, y) of each rectangle: largest first into the first free rectangle that holds it, which is cut in two."""
    out: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * len(sizes)
    free: list[list[tuple[float, float, float, float]]] = []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k][0] * sizes[k][1], k)):
        w, h = sizes[i]
        if w > width or h > height:
            continue
        spot = next(((s, r) for s, rects in enumerate(free) for r in rects if w <= r[2] and h <= r[3]), None)
        if spot is None:
            free.append([(0.0, 0.0, width, height)])
            spot = len(free) - 1, free[-1][0]
        s, (x, y, fw, fh) = spot
        free[s].remove((x, y, fw, fh))
        free[s] += [(x + w, y, fw - w, h), (x, y + h, fw, fh - h)]
        out[i] = s, x, y
    return out
