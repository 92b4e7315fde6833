"""Plain-Python parts of experiments: measure parameters, years, filter sizes, cascades, parameter grids, experiment names."""

from __future__ import annotations

import re
from itertools import combinations, product

#: Defaults of an experiment.
DEFAULTS = {"simdim": 800, "maxqlen": 16, "numneg": 1, "batch": 16, "epochs": 150, "nsamples": 2048, "nfilter": 32, "winlen": 3, "kmaxpool": 3, "combine": 32, "xfilters": "", "context": True, "shuffle": True, "ut": True, "ud": True, "seed": 7541}
YEARS = ("wt09", "wt10", "wt11", "wt12", "wt13", "wt14")


def cutoffs(text: str, kind: type = int) -> list:
    """Sorted distinct positive cutoffs of `5,10,20`."""
    found = sorted({kind(x) for x in text.split(",")})
    if kind is int and found[0] <= 0:
        raise ValueError("cutoffs are positive")
    return found


def gain_pairs(text: str) -> dict[int, float]:
    """Gains by level of `1=3.5,2=9`."""
    return {int(a): float(b) for a, b in (x.split("=") for x in text.split(","))}


def topics_of(years: str) -> list[int]:
    """Topics of `wt09_10`; wttest has fifteen."""
    out: list[int] = []
    for y in years.removeprefix("wt").split("_"):
        out += range(251, 266) if y == "test" else range((int(y) - 9) * 50 + 1, (int(y) - 8) * 50 + 1)
    return out


def splits(n: int = 4) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """Training years and the held-out ones."""
    return [(c, tuple(y for y in YEARS if y not in c)) for c in combinations(YEARS, n)]


def filter_sizes(winlen: int, maxqlen: int, proximity: int = 0, extra: str = "") -> dict[int, list[tuple[int, int]]]:
    """Distinct filter shapes by width: squares up to winlen, one over all query terms, and those of `2x4.3x5`."""
    shapes = {(k, k) for k in range(1, winlen + 1)}
    if proximity:
        shapes.add((maxqlen, proximity))
    shapes |= {(int(a), int(b)) for a, b in re.findall(r"(\d+)x(\d+)", extra)}
    out: dict[int, list[tuple[int, int]]] = {}
    for a, b in sorted(shapes):
        out.setdefault(b, []).append((a, b))
    return out


def cascade(percents: list[int], width: int) -> list[int]:
    """Prefix lengths, the whole width always among them."""
    return sorted({max(1, width * p // 100) for p in percents} | {width})


def grid(parameters: dict[str, str]) -> list[dict[str, str]]:
    """Every combination of values separated by |."""
    names = list(parameters)
    return [dict(zip(names, v, strict=True)) for v in product(*(parameters[n].split("|") for n in names))]


def experiment_id(model: str, parameters: dict[str, object]) -> str:
    parts = [f"{k}-{v}" for k, v in sorted(parameters.items()) if not (k in ("ut", "ud") and v is True)]
    return "_".join([model, *parts])


def parse_experiment_id(text: str) -> tuple[str, dict[str, str]]:
    model, *parts = text.split("_")
    found = dict(p.split("-", 1) for p in parts)
    if "_".join([model, *(f"{k}-{v}" for k, v in found.items())]) != text:
        raise ValueError(f"not an experiment's name: {text}")
    return model, found
