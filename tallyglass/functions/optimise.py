"""Bounded quasi-Newton minimisation of many small problems at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Objective = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def minimise(f: Objective, start: np.ndarray, low: np.ndarray, high: np.ndarray, tol: float = 1e-8, rounds: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points (problems x parameters), values, and whether each problem's gradient vanished.

    ``f(points, which)`` gives values and gradients of the problems numbered ``which``. Each has its own inverse
    curvature (BFGS) and its own step, halved until the value falls enough; a step ends at the bounds. A problem is solved
    when every entry of its gradient that doesn't push out of the bounds is at most ``tol`` times its value (or ``tol``).
    """
    x = np.clip(np.array(start, float), low, high)
    problems, size = x.shape
    every = np.arange(problems)
    value, grad = f(x, every)
    inverse = np.tile(np.eye(size), (problems, 1, 1))
    fresh, solved, stuck = np.ones(problems, bool), np.zeros(problems, bool), np.zeros(problems, bool)
    for _ in range(rounds):
        free = ~((x <= low) & (grad > 0) | (x >= high) & (grad < 0))
        pull = np.where(free, grad, 0.0)
        solved = np.abs(pull).max(axis=1) <= tol * np.maximum(1.0, np.abs(value))
        live = every[~solved & ~stuck & np.isfinite(value)]
        if not len(live):
            break
        held = free[live]
        way = -np.einsum("rij,rj->ri", inverse[live] * held[:, :, None] * held[:, None, :], pull[live])
        slope = (way * grad[live]).sum(axis=1)
        steep = slope < -1e-12 * np.abs(pull[live]).max(axis=1) ** 2
        fresh[live[~steep]] = True
        way[~steep] = -pull[live[~steep]]
        # without curvature the first step is of length one at most
        step = np.where(fresh[live], 1.0 / np.maximum(1.0, np.abs(way).max(axis=1)), 1.0)
        left = np.arange(len(live))
        new_x, new_value, new_grad = x[live].copy(), value[live].copy(), grad[live].copy()
        for _ in range(60):
            rows = live[left]
            tried = np.clip(x[rows] + step[left, None] * way[left], low, high)
            v, g = f(tried, rows)
            gain = (grad[rows] * (tried - x[rows])).sum(axis=1)
            good = np.isfinite(v) & (v <= value[rows] + 1e-4 * gain + 1e-14 * np.maximum(1.0, np.abs(value[rows]))) & np.isfinite(g).all(axis=1)
            new_x[left[good]], new_value[left[good]], new_grad[left[good]] = tried[good], v[good], g[good]
            left = left[~good]
            if not len(left):
                break
            step[left] *= 0.5
        failed = live[left]
        stuck[failed[fresh[failed]]] = True
        fresh[failed], inverse[failed] = True, np.eye(size)
        # curvature is learnt among the parameters that may move
        moved, turned = new_x - x[live], np.where(held, new_grad - grad[live], 0.0)
        x[live], value[live], grad[live] = new_x, new_value, new_grad
        curve = (moved * turned).sum(axis=1)
        bent = curve > 1e-12 * np.sqrt((moved * moved).sum(axis=1) * (turned * turned).sum(axis=1))
        rows, s, y, c = live[bent], moved[bent], turned[bent], curve[bent][:, None, None]
        first = fresh[rows][:, None, None]
        base = np.where(first, np.eye(size) * (curve[bent] / np.maximum((y * y).sum(axis=1), 1e-300))[:, None, None], inverse[rows])
        left_side = np.eye(size) - s[:, :, None] * y[:, None, :] / c
        inverse[rows] = left_side @ base @ left_side.transpose(0, 2, 1) + s[:, :, None] * s[:, None, :] / c
        fresh[rows] = False
    return x, value, solved


def curvature(f: Objective, x: np.ndarray, step: float = 1e-5) -> np.ndarray:
    """The second derivatives (problems x parameters x parameters) at x, from differences of the gradients."""
    every = np.arange(len(x))
    out = np.empty((*x.shape, x.shape[1]))
    for i in range(x.shape[1]):
        by = np.zeros_like(x)
        by[:, i] = step * np.maximum(1.0, np.abs(x[:, i]))
        out[:, i] = (f(x + by, every)[1] - f(x - by, every)[1]) / (2 * by[:, i : i + 1])
    return (out + out.transpose(0, 2, 1)) / 2


def well_determined(curve: np.ndarray, least: float = 1e-9) -> np.ndarray:
    """Whether each problem's second derivatives, on the scale of their own diagonal, are positive in all directions."""
    diagonal = np.einsum("rii->ri", curve)
    scale = np.sqrt(np.maximum(diagonal, 0.0))
    positive = (diagonal > least * np.maximum(1.0, diagonal.max(axis=1, keepdims=True))).all(axis=1) & np.isfinite(curve).all(axis=(1, 2))
    unit = np.where(positive[:, None, None], curve / np.where(positive[:, None], scale, 1.0)[:, :, None] / np.where(positive[:, None], scale, 1.0)[:, None, :], 0.0)
    return positive & (np.linalg.eigvalsh(unit)[:, 0] > least)
