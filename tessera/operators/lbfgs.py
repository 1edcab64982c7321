"""Limited-memory BFGS over a small dense weight vector (driver side).

The CRF has ~10^2 weights; each function evaluation is one distributed
Spark pass, so the optimiser itself is a few vector operations per round.
"""

from __future__ import annotations

from collections.abc import Callable, Generator
from dataclasses import dataclass, field

import numpy as np


@dataclass
class LBFGSResult:
    w: np.ndarray
    f: float
    iterations: int
    evaluations: int
    converged: str
    history: list = field(default_factory=list)


@dataclass
class State:
    """All that the rounds after this one depend on."""

    iterations: int
    evaluations: int
    w: np.ndarray
    f: float
    g: np.ndarray
    s_hist: list
    y_hist: list
    f_hist: list


def steps(w0: np.ndarray, max_iter: int = 50, m: int = 6, epsilon: float = 1e-5,
          past: int = 10, delta: float = 1e-5, max_linesearch: int = 20, free: np.ndarray | None = None,
          resume: State | None = None, each_round: Callable[[State], None] | None = None,
          ) -> Generator[np.ndarray, tuple[float, np.ndarray], LBFGSResult]:
    """L-BFGS with a backtracking (Armijo) line search, as a generator: it yields weights, is sent
    their objective and gradient, and returns the result. So several fits can advance together.

    ``free`` marks weights that may move; the others stay at their start value.
    Stops on ``max_iter`` rounds, on a small gradient
    (``|g| / max(1, |w|) < epsilon``) or when the objective improved by less
    than ``delta`` (relative) over the last ``past`` rounds. ``each_round`` is called with the state after
    each round that another one follows; a run that starts with ``resume`` takes the same rounds from there.
    """
    free = np.ones_like(w0, dtype=bool) if free is None else free.astype(bool)
    if resume:
        it, evals, w, f, g = resume.iterations, resume.evaluations, resume.w, resume.f, resume.g
        s_hist, y_hist, f_hist = list(resume.s_hist), list(resume.y_hist), list(resume.f_hist)
    else:
        w = w0.astype(float).copy()
        f, g = yield w
        g = np.where(free, g, 0.0)
        it, evals, s_hist, y_hist, f_hist = 0, 1, [], [], [f]
    reason = "max_iter"
    for it in range(it + 1, max_iter + 1):
        gnorm = np.linalg.norm(g)
        if gnorm / max(1.0, np.linalg.norm(w)) < epsilon:
            reason = "gradient"
            it -= 1
            break
        # two-loop recursion
        q = g.copy()
        alphas = []
        for s, y in zip(reversed(s_hist), reversed(y_hist)):
            rho = 1.0 / float(y @ s)
            a = rho * float(s @ q)
            alphas.append((rho, a))
            q -= a * y
        if s_hist:
            s, y = s_hist[-1], y_hist[-1]
            q *= float(s @ y) / float(y @ y)
        else:
            q /= gnorm
        for (s, y), (rho, a) in zip(zip(s_hist, y_hist), reversed(alphas)):
            b = rho * float(y @ q)
            q += (a - b) * s
        d = np.where(free, -q, 0.0)
        slope = float(g @ d)
        if slope >= 0:  # not a descent direction: restart from steepest descent
            s_hist.clear()
            y_hist.clear()
            d = np.where(free, -g / gnorm, 0.0)
            slope = float(g @ d)
        step = 1.0
        for _ in range(max_linesearch):
            w_new = w + step * d
            f_new, g_new = yield w_new
            evals += 1
            if f_new <= f + 1e-4 * step * slope:
                break
            step *= 0.5
        else:
            reason = "linesearch"
            break
        g_new = np.where(free, g_new, 0.0)
        s_vec, y_vec = w_new - w, g_new - g
        if float(s_vec @ y_vec) > 1e-12:
            s_hist.append(s_vec)
            y_hist.append(y_vec)
            if len(s_hist) > m:
                s_hist.pop(0)
                y_hist.pop(0)
        w, f, g = w_new, f_new, g_new
        f_hist.append(f)
        if len(f_hist) > past:
            old = f_hist[-1 - past]
            if abs(old - f) / max(abs(f), 1e-300) < delta:
                reason = "delta"
                break
        if each_round:
            each_round(State(it, evals, w, f, g, list(s_hist), list(y_hist), list(f_hist)))
    return LBFGSResult(w=w, f=f, iterations=it, evaluations=evals, converged=reason,
                       history=f_hist)


def minimize(fg: Callable[[np.ndarray], tuple[float, np.ndarray]], w0: np.ndarray, **params) -> LBFGSResult:
    """Minimise one function; the parameters are those of ``steps``."""
    return minimize_together(lambda at: {k: fg(w) for k, w in at.items()}, {0: steps(w0, **params)})[0]


def minimize_together(evaluate: Callable[[dict], dict], fits: dict) -> dict:
    """Advance several ``steps`` in step: ``evaluate`` gets the weights each unfinished one asks for
    and returns their (objective, gradient). A finished one leaves."""
    done, asked = {}, {}

    def advance(key, value):
        try:
            asked[key] = fits[key].send(value)
        except StopIteration as end:
            asked.pop(key, None)
            done[key] = end.value

    for key in fits:
        advance(key, None)
    while asked:
        for key, value in evaluate(dict(asked)).items():
            advance(key, value)
    return done
