"""Walk-length distributions: coefficients c_0..c_order that sum to one."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field


def _alpha(params: dict, by_tau) -> float:
    if ("alpha" in params) == ("tau" in params):
        raise ValueError("give alpha or tau")
    return params["alpha"] if "alpha" in params else by_tau(params["tau"])


def _delta(n: int) -> list[float]:
    return [1.0] + [0.0] * (n - 1)


def geometric(n: int, **p) -> list[float]:
    a = _alpha(p, lambda t: t / (1 + t))
    return _delta(n) if a < 1e-7 else [(1 - a) * a**k for k in range(n)]


def poisson(n: int, tau: float) -> list[float]:
    return _delta(n) if tau < 1e-7 else [math.exp(k * math.log(tau) - tau - math.lgamma(k + 1)) for k in range(n)]


def uniform(n: int, tau: float) -> list[float]:
    m = min(int(2 * tau + 1), n)
    return [1.0 / m] * m + [0.0] * (n - m)


def nbinom(n: int, r: float, **p) -> list[float]:
    a = _alpha(p, lambda t: t / (r + t))
    if a < 1e-8:
        return _delta(n)
    return [math.exp(math.lgamma(k + r) - math.lgamma(k + 1) - math.lgamma(r) + r * math.log1p(-a) + k * math.log(a)) for k in range(n)]


def binom(n: int, **p) -> list[float]:
    """Of n trials, the term of all n successes is beyond the series."""
    q = 1 - p["alpha"] if "alpha" in p else min(p["tau"] / n, 1 - 1e-6)
    return [math.comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(n)]


FAMILIES = {"geometric": geometric, "poisson": poisson, "uniform": uniform, "nbinom": nbinom, "binom": binom}


@dataclass(frozen=True)
class Coefficients:
    """A family with its parameters, moved by loc steps."""

    name: str
    params: dict = field(default_factory=dict)
    loc: int = 0

    def values(self, order: int) -> list[float]:
        """c_0..c_order; the truncated series is scaled to sum one."""
        if self.loc > order + 1 or self.loc < 0:
            raise ValueError("loc beyond the order")
        if self.name not in FAMILIES:
            raise ValueError(f"no family {self.name}")
        n = order + 1 - self.loc
        body = FAMILIES[self.name](n, **self.params) if n else []
        total = sum(body)
        return [0.0] * self.loc + [x / total for x in body]


def parse(names: str, taus: str, locs: str | None = None, nbinom_r: float = 1.0) -> list[Coefficients]:
    """Coefficients from `a::b::c` lists of names, taus and locs, or a JSON list of specs."""
    if names.lstrip().startswith("["):
        return [Coefficients(x["name"], x.get("kwargs", {}), x.get("loc", 0)) for x in json.loads(names)]
    n, t = names.split("::"), [float(x) for x in str(taus).split("::")]
    at = [int(x) for x in str(locs).split("::")] if locs is not None else [0] * len(n)
    if not len(n) == len(t) == len(at):
        raise ValueError("lists of unlike lengths")
    return [Coefficients(a, {"tau": b} | ({"r": nbinom_r} if a == "nbinom" else {}), c) for a, b, c in zip(n, t, at, strict=True)]
