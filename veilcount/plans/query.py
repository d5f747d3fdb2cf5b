"""Linear queries on attribute subsets, and their parts.

A query is a set of rows with one weight.  Its part on a subset S of its attributes A
multiplies mode by mode: by the centring matrix I - J/d for attributes in S, by the
column 1/d for the rest.  The rows of all parts, each applied to its marginal, add up
to the query.  Kronecker queries keep one small matrix per attribute in every part;
collapsed attributes have a single column, so no factor is lost from the answer.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np

from veilcount.domain import Domain


def centre(tensor: np.ndarray, axis: int) -> np.ndarray:
    return tensor - tensor.mean(axis=axis, keepdims=True)


def mode(tensor: np.ndarray, matrix: np.ndarray, axis: int) -> np.ndarray:
    """matrix applied along an axis."""
    return np.moveaxis(np.tensordot(matrix, tensor, axes=(1, axis)), 0, axis)


class Query:
    def __init__(self, domain: Domain, attributes: Sequence[int], weight: float = 1.0, name: str = ""):
        attributes = tuple(int(a) for a in attributes)
        if len(set(attributes)) < len(attributes) or any(not 0 <= a < len(domain) for a in attributes):
            raise ValueError(f"bad attributes {attributes}")
        if not weight > 0:
            raise ValueError("weight must be positive")
        self.domain, self.attributes, self.weight, self.name = domain, tuple(sorted(attributes)), float(weight), name
        self.order = tuple(np.argsort(attributes)) if attributes else ()
        self.mask = domain.mask(attributes)
        self.shape = domain.shape(self.mask)

    @property
    def n_rows(self) -> int:
        raise NotImplementedError

    def matrix(self) -> np.ndarray:
        """(rows, cells) over the sorted attributes."""
        raise NotImplementedError

    def part(self, mask: int) -> MatrixPart | KronPart:
        raise NotImplementedError

    def tensor(self, batch_last: bool = False) -> np.ndarray:
        t = self.matrix().reshape(-1, *self.shape)
        return np.moveaxis(t, 0, -1) if batch_last else t


class MatrixPart:
    """Dense rows (rows, cells of the mask)."""

    def __init__(self, rows: np.ndarray, shape: tuple[int, ...], weight: float):
        self.rows, self.shape, self.weight = rows, shape, weight

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.rows @ x.reshape(-1)

    def gram(self) -> np.ndarray:
        return self.weight * self.rows.T @ self.rows

    def energy(self, per_row: bool = False) -> np.ndarray:
        """|inverse DFT|^2 of the rows, summed over them."""
        if not self.shape:
            e = np.abs(self.rows.reshape(len(self.rows))) ** 2
            return e if per_row else e.sum()
        e = np.abs(np.fft.ifftn(self.rows.reshape(-1, *self.shape), axes=range(1, len(self.shape) + 1))) ** 2
        return e if per_row else e.sum(axis=0)

    def dense(self) -> np.ndarray:
        return self.rows

    def square(self) -> float:
        """Sum of the squares of all coefficients."""
        return float(np.sum(self.rows**2))


class KronPart:
    """One matrix (rows_i, d_i) per attribute of the mask and a column (rows_i, 1) per collapsed one, in the query's order."""

    def __init__(self, factors: list[np.ndarray], inside: list[bool], shape: tuple[int, ...], weight: float):
        self.factors, self.inside, self.shape, self.weight = factors, inside, shape, weight

    def apply(self, x: np.ndarray) -> np.ndarray:
        sizes = [f.shape[1] for f in self.factors]
        t = x.reshape(sizes) if sizes else x.reshape(())
        for i, f in enumerate(self.factors):
            t = mode(t, f, i)
        return t.reshape(-1)

    @property
    def scale(self) -> float:
        return float(np.prod([np.sum(f**2) for f, k in zip(self.factors, self.inside, strict=True) if not k]))

    def grams(self) -> list[np.ndarray]:
        return [f.T @ f for f, k in zip(self.factors, self.inside, strict=True) if k]

    def gram(self) -> np.ndarray:
        return self.weight * self.scale * reduce(np.kron, self.grams(), np.ones((1, 1)))

    def energy(self, per_row: bool = False) -> np.ndarray:
        spectra = [np.abs(np.fft.ifft(f, axis=1)) ** 2 for f in self.factors]
        if per_row:
            t = reduce(lambda a, b: np.einsum("i...,jk->ij...k", a, b).reshape(a.shape[0] * b.shape[0], *a.shape[1:], b.shape[1]), spectra, np.ones((1,)))
            return t.reshape(-1, *self.shape)
        out = reduce(np.multiply.outer, [s.sum(axis=0) for s in spectra], np.ones(()))
        return out.reshape(self.shape)

    def dense(self) -> np.ndarray:
        return reduce(np.kron, self.factors, np.ones((1, 1)))

    def square(self) -> float:
        return float(np.prod([np.sum(f**2) for f in self.factors]))


class MatrixQuery(Query):
    def __init__(self, domain: Domain, attributes: Sequence[int], matrix: np.ndarray, weight: float = 1.0, name: str = ""):
        super().__init__(domain, attributes, weight, name)
        m = np.atleast_2d(np.asarray(matrix, float))
        given = tuple(domain.sizes[a] for a in attributes)
        if m.shape[1] != int(np.prod(given)):
            raise ValueError(f"matrix has {m.shape[1]} columns, the marginal {int(np.prod(given))} cells")
        self._matrix = m.reshape(-1, *given).transpose(0, *(1 + i for i in self.order)).reshape(len(m), -1)

    @property
    def n_rows(self) -> int:
        return len(self._matrix)

    def matrix(self) -> np.ndarray:
        return self._matrix

    def part(self, mask: int) -> MatrixPart:
        t = self.tensor()
        for axis, a in enumerate(self.attributes, 1):
            t = centre(t, axis) if mask >> a & 1 else t.mean(axis=axis, keepdims=True)
        return MatrixPart(t.reshape(self.n_rows, -1), self.domain.shape(mask), self.weight)


class KronQuery(Query):
    def __init__(self, domain: Domain, attributes: Sequence[int], factors: Sequence[np.ndarray], weight: float = 1.0, name: str = ""):
        super().__init__(domain, attributes, weight, name)
        found = [np.atleast_2d(np.asarray(f, float)) for f in factors]
        if len(found) != len(self.attributes):
            raise ValueError("one factor per attribute")
        self.factors = [found[i] for i in self.order]
        for f, d in zip(self.factors, self.shape, strict=True):
            if f.shape[1] != d:
                raise ValueError(f"factor has {f.shape[1]} columns, the attribute {d} values")

    @property
    def n_rows(self) -> int:
        return int(np.prod([len(f) for f in self.factors], dtype=object))

    def matrix(self) -> np.ndarray:
        return reduce(np.kron, self.factors, np.ones((1, 1)))

    def part(self, mask: int) -> KronPart:
        inside = [bool(mask >> a & 1) for a in self.attributes]
        factors = [centre(f, 1) if k else f.mean(axis=1, keepdims=True) for f, k in zip(self.factors, inside, strict=True)]
        return KronPart(factors, inside, self.domain.shape(mask), self.weight)
