"""Finite domains: ordered attributes with sizes, subsets as bit masks, row-major cell indexes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import combinations

from veilcount.functions.encode import Encoder


@dataclass(frozen=True)
class Attribute:
    name: str
    size: int
    encoder: Encoder | None = None

    def __post_init__(self):
        if self.size < 1:
            raise ValueError(f"attribute {self.name}: size must be at least 1")


class Domain:
    """Attributes 0 .. k - 1; bit i of a mask stands for attribute i, so a sorted tuple and a mask name the same subset."""

    def __init__(self, attributes: Sequence[Attribute | int]):
        self.attributes = tuple(a if isinstance(a, Attribute) else Attribute(f"a{i}", a) for i, a in enumerate(attributes))
        if len({a.name for a in self.attributes}) < len(self.attributes):
            raise ValueError("attribute names must differ")
        self.sizes = tuple(a.size for a in self.attributes)
        self.names = tuple(a.name for a in self.attributes)

    def __len__(self) -> int:
        return len(self.attributes)

    def mask(self, attrs: Iterable[int]) -> int:
        return sum(1 << a for a in set(attrs))

    def attrs(self, mask: int) -> tuple[int, ...]:
        return tuple(i for i in range(len(self)) if mask >> i & 1)

    def shape(self, mask: int) -> tuple[int, ...]:
        return tuple(self.sizes[i] for i in self.attrs(mask))

    def size(self, mask: int) -> int:
        n = 1
        for d in self.shape(mask):
            n *= d
        return n

    def strides(self, mask: int) -> dict[int, int]:
        """Row-major: the last attribute of the subset moves fastest."""
        out, step = {}, 1
        for i in reversed(self.attrs(mask)):
            out[i] = step
            step *= self.sizes[i]
        return out

    def index(self, name: str) -> int:
        return self.names.index(name)


def submasks(mask: int) -> list[int]:
    """All subsets of a mask, itself and the empty one included, by size and then by value."""
    out, s = [], mask
    while True:
        out.append(s)
        if not s:
            break
        s = (s - 1) & mask
    return sorted(out, key=lambda m: (m.bit_count(), m))


def k_way(n: int, k: int, least: int = 1) -> list[tuple[int, ...]]:
    """Attribute subsets of least .. k of n attributes, by order."""
    return [c for r in range(least, k + 1) for c in combinations(range(n), r)]


def system(domain: Domain, kind: int | str, limit: int = 5_000) -> list[tuple[int, ...]]:
    """Subsets of a k-way system: of exactly kind attributes, "3D" of up to three with the empty one, "Small" those of up to limit cells."""
    if kind == "3D":
        return k_way(len(domain), 3, 0)
    if kind == "Small":  # grows by one attribute at a time, as no subset of more cells comes back under the limit
        out, last = [()], [()]
        while last:
            last = [(*s, a) for s in last for a in range(s[-1] + 1 if s else 0, len(domain)) if domain.size(domain.mask((*s, a))) <= limit]
            out += last
        return out
    return k_way(len(domain), int(kind), int(kind))


# Published attribute sizes of three census and loan tables, and which attributes are numeric.
CATALOG = {
    "adult": ((100, 100, 100, 99, 85, 42, 16, 15, 9, 7, 6, 5, 2, 2), 5),
    "cps": ((50, 100, 7, 4, 2), 2),
    "loans": ((101, 101, 101, 101, 3, 8, 36, 6, 51, 4, 5, 15), 4),
    "simple_adult": ((2, 2, 3), 0),
    "age_income": ((85, 2), 2),
}


def catalog(name: str) -> tuple[Domain, int]:
    """(domain, number of numeric attributes, which come first)."""
    sizes, numeric = CATALOG[name]
    return Domain(sizes), numeric
