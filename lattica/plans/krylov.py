"""Krylov methods, written once over the vector-space interface of ``space``.

``Problem`` binds a space, an operator, an optional preconditioner and a right-hand side. Every method returns a
``Result``: the solution, the number of iterations or a negative status, and the residual history. Convergence by a
recurrence is accepted only after the true residual has been recomputed; else the method restarts, 20 times at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import IntEnum
from typing import Any

import numpy as np

#: Fixed numerical guards.
SMALL, BREAKDOWN, MAX_RESTARTS, STALL_RATIO = 1e-20, 1e-40, 20, 1e-4


class Status(IntEnum):
    OK = 0
    UNKNOWN_METHOD = -41
    STAGNATED = -42
    SOLUTION_STALLED = -43
    TOLERANCE_TOO_SMALL = -44
    MAX_ITERATIONS = -48
    BREAKDOWN = -49


class StopTest(IntEnum):
    RESIDUAL = 1  # |r| / |r0|
    PRECONDITIONED = 2  # sqrt((r, B r)) relative to its start
    SOLUTION = 3  # |r| / |x|


@dataclass
class Problem:
    space: Any
    operator: Callable
    b: Any
    preconditioner: Callable | None = None
    x0: Any = None

    def start(self):
        return self.space.zero() if self.x0 is None else self.x0

    def a(self, v):
        return self.space.apply(self.operator, v)

    def m(self, v):
        return v if self.preconditioner is None else self.space.apply(self.preconditioner, v)

    def residual(self, x):
        return self.space.combine((1.0, self.b), (-1.0, self.a(x)))


@dataclass
class Result:
    x: Any
    iterations: int
    status: Status
    residuals: list[float] = field(default_factory=list)

    @property
    def code(self) -> int:
        """Iterations, or the negative status of a failure."""
        return self.iterations if self.status == Status.OK else int(self.status)


@dataclass
class Control:
    tol: float = 1e-6
    abstol: float = 1e-18
    maxit: int = 500
    restart: int = 25
    stop: StopTest = StopTest.RESIDUAL


class _Watch:
    """Stop tests, history and, for the safe variants, the best iterate so far."""

    def __init__(self, p: Problem, c: Control, safe: bool = False):
        self.p, self.c, self.safe, self.history = p, c, safe, []
        self.best, self.best_at, self.scale, self.restarts = None, math.inf, None, 0
        self.absolute = math.inf

    def measure(self, x, r, z=None) -> float:
        sp = self.p.space
        if self.c.stop == StopTest.PRECONDITIONED:
            value = math.sqrt(abs(sp.dots((r, z if z is not None else self.p.m(r)))[0]))
        else:
            value = math.sqrt(sp.dots((r, r))[0])
        return self.note(value, x)

    def note(self, value: float, x) -> float:
        if self.c.stop == StopTest.SOLUTION:
            size = math.sqrt(self.p.space.dots((x, x))[0]) if x is not None else 0.0
            relative = value / max(size, SMALL)
        else:
            self.scale = max(value, SMALL) if self.scale is None else self.scale
            relative = value / self.scale
        self.history.append(relative)
        if self.safe and x is not None and math.isfinite(value):
            margin = self.c.tol * STALL_RATIO * self.best_at if math.isfinite(self.best_at) else 0.0
            if value < self.best_at - margin:
                self.best, self.best_at = x, value
        self.absolute = value
        return relative

    def done(self, relative: float) -> bool:
        return relative < self.c.tol or self.absolute < self.c.abstol

    def result(self, x, iterations: int, status: Status) -> Result:
        if self.safe and self.best is not None and not (self.absolute <= self.best_at):
            x = self.best
        if status == Status.OK and iterations > self.c.maxit:
            status = Status.MAX_ITERATIONS
        return Result(x, iterations, status, self.history)


def cg(p: Problem, c: Control = Control(), safe: bool = False) -> Result:
    """Preconditioned conjugate gradients."""
    sp, w = p.space, _Watch(p, c, safe)
    x = p.start()
    r = p.residual(x)
    z = p.m(r)
    rel = w.measure(x, r, z)
    if w.done(rel) or rel == 0.0 or w.absolute <= SMALL:
        return w.result(x, 0, Status.OK)
    d, rz = z, sp.dots((z, r))[0]
    for it in range(1, c.maxit + 1):
        q = p.a(d)
        dq = sp.dots((d, q))[0]
        if abs(dq) <= BREAKDOWN:
            return w.result(x, it, Status.BREAKDOWN)
        alpha = rz / dq
        x, r = sp.combine((1.0, x), (alpha, d)), sp.combine((1.0, r), (-alpha, q))
        rel = w.measure(x, r)
        if not math.isfinite(rel):
            return w.result(x, it, Status.BREAKDOWN)
        fresh = False
        if w.done(rel):
            r = p.residual(x)
            rel = w.measure(x, r)
            if w.done(rel):
                return w.result(x, it, Status.OK)
            w.restarts += 1
            if w.restarts > MAX_RESTARTS:
                return w.result(x, it, Status.TOLERANCE_TOO_SMALL)
            fresh = True
        z = p.m(r)
        new = sp.dots((z, r))[0]
        beta, rz = 0.0 if fresh else new / rz, new
        d = sp.combine((1.0, z), (beta, d))
    return w.result(x, c.maxit, Status.MAX_ITERATIONS)


def bicgstab(p: Problem, c: Control = Control(), safe: bool = False) -> Result:
    """BiCGstab with preconditioned directions and a half-step exit."""
    sp, w = p.space, _Watch(p, c, safe)
    x = p.start()
    r = p.residual(x)
    rel = w.measure(x, r)
    if w.done(rel) or w.absolute <= SMALL:
        return w.result(x, 0, Status.OK)
    shadow, d = r, r
    rho = sp.dots((r, shadow))[0]
    for it in range(1, c.maxit + 1):
        dp = p.m(d)
        v = p.a(dp)
        sv = sp.dots((shadow, v))[0]
        if abs(sv) <= BREAKDOWN:
            return w.result(x, it, Status.BREAKDOWN)
        alpha = rho / sv
        s = sp.combine((1.0, r), (-alpha, v))
        half = sp.combine((1.0, x), (alpha, dp))
        if w.done(w.measure(half, s)) and w.done(w.measure(half, p.residual(half))):
            return w.result(half, it, Status.OK)
        st = p.m(s)
        t = p.a(st)
        ts, tt = sp.dots((t, s), (t, t))
        if tt <= BREAKDOWN:
            return w.result(half, it, Status.BREAKDOWN)
        omega = ts / tt
        x = sp.combine((1.0, half), (omega, st))
        r = sp.combine((1.0, s), (-omega, t))
        rel = w.measure(x, r)
        if not math.isfinite(rel):
            return w.result(x, it, Status.BREAKDOWN)
        if w.done(rel):
            r = p.residual(x)
            if w.done(w.measure(x, r)):
                return w.result(x, it, Status.OK)
            w.restarts += 1
            if w.restarts > MAX_RESTARTS:
                return w.result(x, it, Status.TOLERANCE_TOO_SMALL)
            shadow, d = r, r
            rho = sp.dots((r, shadow))[0]
            continue
        new = sp.dots((r, shadow))[0]
        if abs(omega) <= BREAKDOWN or abs(rho) <= BREAKDOWN:
            return w.result(x, it, Status.BREAKDOWN)
        beta, rho = (new / rho) * (alpha / omega), new
        d = sp.combine((1.0, r), (beta, d), (-beta * omega, v))
    return w.result(x, c.maxit, Status.MAX_ITERATIONS)


def minres(p: Problem, c: Control = Control(), safe: bool = False) -> Result:
    """Minimum residual for symmetric operators: directions are kept A-conjugate in the A-image by a three-term recurrence."""
    sp, w = p.space, _Watch(p, c, safe)
    x = p.start()
    r = p.residual(x)
    if w.done(w.measure(x, r)) or w.absolute <= SMALL:
        return w.result(x, 0, Status.OK)
    d = p.m(r)
    ad = p.a(d)
    kept: list[tuple[Any, Any, float]] = []
    for it in range(1, c.maxit + 1):
        mad = p.m(ad)
        if kept:
            sizes = sp.dots(*[(q, mad) for _, q, _ in kept])
            terms = [(k / n, dd, q) for k, (dd, q, n) in zip(sizes, kept)]
        rad, size = sp.dots((r, mad), (ad, mad))
        if abs(size) <= BREAKDOWN:
            return w.result(x, it, Status.BREAKDOWN)
        alpha = rad / size
        x, r = sp.combine((1.0, x), (alpha, d)), sp.combine((1.0, r), (-alpha, ad))
        rel = w.measure(x, r)
        if w.done(rel):
            r = p.residual(x)
            if w.done(w.measure(x, r)):
                return w.result(x, it, Status.OK)
            w.restarts += 1
            if w.restarts > MAX_RESTARTS:
                return w.result(x, it, Status.TOLERANCE_TOO_SMALL)
            d, kept = p.m(r), []
            ad = p.a(d)
            continue
        kept = [*kept[-1:], (d, ad, size)]
        new = mad
        anew = p.a(new)
        manew = p.m(anew) if p.preconditioner is not None else anew
        sizes = sp.dots(*[(q, manew) for _, q, _ in kept])
        terms = [(-k / n, dd, q) for k, (dd, q, n) in zip(sizes, kept)]
        d = sp.combine((1.0, new), *[(k, dd) for k, dd, _ in terms])
        ad = sp.combine((1.0, anew), *[(k, q) for k, _, q in terms])
        grown = math.sqrt(max(sp.dots((d, d))[0], SMALL))
        d, ad = sp.combine((1.0 / grown, d)), sp.combine((1.0 / grown, ad))
    return w.result(x, c.maxit, Status.MAX_ITERATIONS)


def gcr(p: Problem, c: Control = Control(), safe: bool = False) -> Result:
    """Restarted generalised conjugate residuals."""
    sp, w = p.space, _Watch(p, c, safe)
    x = p.start()
    r = p.residual(x)
    if w.done(w.measure(x, r)) or w.absolute <= SMALL:
        return w.result(x, 0, Status.OK)
    it = 0
    while it < c.maxit:
        basis: list[tuple[Any, Any, float]] = []
        while len(basis) < c.restart and it < c.maxit:
            it += 1
            z = p.m(r)
            q = p.a(z)
            for _ in range(2):  # twice is enough for orthogonality
                if basis:
                    h = sp.dots(*[(q, b) for _, b, _ in basis])
                    q = sp.combine((1.0, q), *[(-k / n, b) for k, (_, b, n) in zip(h, basis)])
                    z = sp.combine((1.0, z), *[(-k / n, a) for k, (a, _, n) in zip(h, basis)])
            qq, qr = sp.dots((q, q), (q, r))
            if qq <= BREAKDOWN:
                return w.result(x, it, Status.BREAKDOWN)
            x, r = sp.combine((1.0, x), (qr / qq, z)), sp.combine((1.0, r), (-qr / qq, q))
            basis.append((z, q, qq))
            if w.done(w.measure(x, r)):
                break
        r = p.residual(x)
        if w.done(w.measure(x, r)):
            return w.result(x, it, Status.OK)
    return w.result(x, it, Status.MAX_ITERATIONS)


def gcg(p: Problem, c: Control = Control(), safe: bool = False) -> Result:
    """Generalised conjugate gradients: every direction is kept and made A-conjugate to all before it."""
    sp, w = p.space, _Watch(p, c, safe)
    x = p.start()
    r = p.residual(x)
    if w.done(w.measure(x, r)) or w.absolute <= SMALL:
        return w.result(x, 0, Status.OK)
    basis: list[tuple[Any, Any, float]] = []
    for it in range(1, c.maxit + 1):
        d = p.m(r)
        if basis:
            h = sp.dots(*[(d, q) for _, q, _ in basis])
            d = sp.combine((1.0, d), *[(-k / n, a) for k, (a, _, n) in zip(h, basis)])
        q = p.a(d)
        dq, dr = sp.dots((d, q), (d, r))
        if abs(dq) <= BREAKDOWN:
            return w.result(x, it, Status.BREAKDOWN)
        x, r = sp.combine((1.0, x), (dr / dq, d)), sp.combine((1.0, r), (-dr / dq, q))
        basis.append((d, q, dq))
        if w.done(w.measure(x, r)):
            r = p.residual(x)
            if w.done(w.measure(x, r)):
                return w.result(x, it, Status.OK)
            basis = []
    return w.result(x, c.maxit, Status.MAX_ITERATIONS)


def gmres(p: Problem, c: Control = Control(), safe: bool = False, variable: bool = False, flexible: bool = False) -> Result:
    """Right-preconditioned restarted GMRES; ``variable`` adapts the restart length, ``flexible`` keeps preconditioned vectors.

    The Hessenberg matrix (restart x restart) and its rotations live on the driver. Orthogonalisation is classical
    Gram-Schmidt done twice: each pass is one aggregate over all basis vectors.
    """
    sp, w = p.space, _Watch(p, c, safe)
    x = p.start()
    r = p.residual(x)
    rel = w.measure(x, r)
    if w.done(rel) or w.absolute <= SMALL:
        return w.result(x, 0, Status.OK)
    it, length, before = 0, c.restart, None
    while it < c.maxit:
        beta = math.sqrt(sp.dots((r, r))[0])
        if variable and before is not None:
            ratio = beta / before
            if ratio > 0.99:
                length = c.restart
            elif ratio >= 0.174:
                length = length - 3 if length - 3 > 3 else c.restart
        before = beta
        basis, images = [sp.combine((1.0 / beta, r))], []
        h = np.zeros((length + 1, length))
        cs, sn, g = np.zeros(length), np.zeros(length), np.zeros(length + 1)
        g[0], used = beta, 0
        for k in range(length):
            if it >= c.maxit:
                break
            it += 1
            z = p.m(basis[k])
            if flexible:
                images.append(z)
            q = p.a(z)
            for _ in range(2):
                got = sp.dots(*[(q, b) for b in basis])
                h[: k + 1, k] += got
                q = sp.combine((1.0, q), *[(-v, b) for v, b in zip(got, basis)])
            size = math.sqrt(max(sp.dots((q, q))[0], 0.0))
            h[k + 1, k] = size
            for j in range(k):
                a, b = h[j, k], h[j + 1, k]
                h[j, k], h[j + 1, k] = cs[j] * a + sn[j] * b, cs[j] * b - sn[j] * a
            gamma = math.hypot(h[k, k], h[k + 1, k]) or SMALL
            cs[k], sn[k] = h[k, k] / gamma, h[k + 1, k] / gamma
            h[k, k], h[k + 1, k] = gamma, 0.0
            g[k + 1], g[k] = -sn[k] * g[k], cs[k] * g[k]
            used = k + 1
            if c.stop == StopTest.RESIDUAL:
                w.absolute = abs(g[k + 1])
                w.history.append(w.absolute / w.scale)
                if w.done(w.history[-1]):
                    break
            if size <= SMALL:
                break
            basis.append(sp.combine((1.0 / size, q)))
        y = np.linalg.solve(h[:used, :used], g[:used]) if used else np.zeros(0)
        if flexible:
            step = sp.combine(*[(float(v), z) for v, z in zip(y, images)])
        else:
            step = p.m(sp.combine(*[(float(v), b) for v, b in zip(y, basis)]))
        x = sp.combine((1.0, x), (1.0, step))
        r = p.residual(x)
        rel = w.measure(x, r)
        if w.done(rel):
            return w.result(x, it, Status.OK)
        if not math.isfinite(rel):
            return w.result(x, it, Status.BREAKDOWN)
    return w.result(x, it, Status.MAX_ITERATIONS)


def vgmres(p: Problem, c: Control = Control(), safe: bool = False) -> Result:
    return gmres(p, c, safe, variable=True)


def vfgmres(p: Problem, c: Control = Control(), safe: bool = False) -> Result:
    return gmres(p, c, safe, variable=True, flexible=True)


#: Methods by code; 11 to 15 are the safe variants.
METHODS: dict[int, tuple[str, Callable, bool]] = {
    1: ("cg", cg, False), 2: ("bicgstab", bicgstab, False), 3: ("minres", minres, False), 4: ("gmres", gmres, False),
    5: ("vgmres", vgmres, False), 6: ("vfgmres", vfgmres, False), 7: ("gcg", gcg, False), 8: ("gcr", gcr, False),
    11: ("safe cg", cg, True), 12: ("safe bicgstab", bicgstab, True), 13: ("safe minres", minres, True),
    14: ("safe gmres", gmres, True), 15: ("safe vgmres", vgmres, True),
}
#: Which methods each matrix format supports.
SUPPORT: dict[str, set[int]] = {
    "csr": {1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 13, 14, 15}, "matfree": {1, 2, 3, 4, 5, 6, 7},
    "bsr": {1, 2, 4, 5, 6}, "blc": {2, 3, 4, 5, 6}, "str": {1, 2, 4, 5},
}
