"""Principal components of every fold's training rows, at any width and number of groups.

A fold's scatter matrix is that of all training rows minus its own group's part, so
it is never built: of all matrices only the scatter of all rows exists, one of
``dim`` x ``dim``, summed in the tasks.  A fold keeps an orthonormal basis that grows by
the residuals of its leading vectors, as they are and preconditioned with the
eigenvectors of the matrix of all rows, until the residuals vanish.  A pass multiplies
the new basis vectors with the own rows of each group inside the tasks; since a row
belongs to one group, a pass reads the rows once however many folds there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.operators.vectors import vector_sum

#: The scatter matrix of this width takes 128 MB on the driver; wider features are refused.
MOST_FEATURES = 4096
#: Extra vectors in the first basis, and vectors a basis may hold per wanted component.
SPARE, BASIS = 24, 16


def basis_size(dim: int, components: int) -> int:
    return min(dim, BASIS * components + SPARE)


def scatter(rows: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and scatter matrix of the vectors ``__x``."""
    if dim > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features")
    first = rows.agg(F.count("*"), vector_sum("__x")).first()
    if not first[0]:
        return 0, np.zeros(dim), np.zeros((dim, dim))
    mean = np.asarray(first[1]) / first[0]

    def partial(batches):
        import pandas as pd

        total = np.zeros((dim, dim))
        for batch in batches:
            if len(batch):
                x = np.stack(batch["__x"].to_numpy()) - mean
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(dim), "row": list(total)})

    parts = rows.select("__x").mapInPandas(partial, "i int, row array<double>")
    matrix = np.zeros((dim, dim))
    for r in parts.groupBy("i").agg(vector_sum("row").alias("row")).toLocalIterator():
        matrix[r["i"]] = r["row"]
    return first[0], mean, (matrix + matrix.T) / 2


def _own_products(rows: DataFrame, bases: dict[int, np.ndarray], mean: np.ndarray) -> dict[int, np.ndarray]:
    """X'X times the fold's vectors, X being the centred rows of the fold's own group."""

    def partial(batches):
        import pandas as pd

        sums = {}
        for batch in batches:
            if not len(batch):
                continue
            x, fold = np.stack(batch["__x"].to_numpy()) - mean, batch["__f"].to_numpy()
            for f in np.unique(fold).tolist():
                if f in bases:
                    own = x[fold == f]
                    sums[f] = sums.get(f, 0) + own.T @ (own @ bases[f])
        yield pd.DataFrame({"__f": pd.Series(list(sums), dtype="int32"), "part": [v.ravel().tolist() for v in sums.values()]})

    parts = rows.select("__f", "__x").mapInPandas(partial, "__f int, part array<double>")
    total = parts.groupBy("__f").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part"))
    return {r["__f"]: np.asarray(r["part"]).reshape(bases[r["__f"]].shape) for r in total.collect()}


def _outside(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal vectors of the block's part outside the basis."""
    block = block / np.maximum(np.linalg.norm(block, axis=0), 1e-300)
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    left, size, _ = np.linalg.svd(block, full_matrices=False)
    left = left[:, size > 1e-10]
    left = left - basis @ (basis.T @ left)
    return np.linalg.qr(left)[0][:, : basis.shape[0] - basis.shape[1]]


def held_out_components(rows: DataFrame, own: dict[int, tuple[int, np.ndarray]], n: int, mean: np.ndarray, matrix: np.ndarray,
                        components: int, tol: float = 1e-9, passes: int = 100) -> dict[int, tuple[np.ndarray, np.ndarray, bool]]:
    """Whitening map (weight, offset) of each fold in ``own`` and whether its residuals vanished.

    ``own`` gives number and sum of the training rows of the fold's group; ``rows``
    (``__f``, ``__x``) are those rows; n, mean and matrix describe all training rows.
    The driver holds a basis per fold: callers pass as many folds as may fit.
    """
    dim = len(mean)
    values, vectors = np.linalg.eigh(matrix)
    rest = {f: n - k for f, (k, _) in own.items()}
    shift = {f: s - k * mean for f, (k, s) in own.items()}
    wanted = {f: max(0, min(components, rest[f] - 2, dim)) for f in own}
    basis, image, out = {}, {}, {}
    new = {f: vectors[:, -min(dim, wanted[f] + SPARE) :] for f in own if wanted[f]}
    for f in own:
        if not wanted[f]:
            out[f] = np.zeros((dim, 0)), np.zeros(0), True
    for step in range(passes):
        if not new:
            break
        products, following = _own_products(rows, new, mean), {}
        for f, block in new.items():
            moved = matrix @ block - products.get(f, 0) - np.outer(shift[f], shift[f] @ block) / rest[f]
            basis[f] = np.hstack([basis[f], block]) if f in basis else block
            image[f] = np.hstack([image[f], moved]) if f in image else moved
            inner = basis[f].T @ image[f]
            theta, turn = np.linalg.eigh((inner + inner.T) / 2)
            theta, turn = theta[::-1], turn[:, ::-1]
            top, k = theta[: wanted[f]], wanted[f]
            lead = basis[f] @ turn[:, :k]
            residual = image[f] @ turn[:, :k] - lead * top
            wide = np.linalg.norm(residual, axis=0) > tol * max(theta[0], 1e-300)
            full = basis[f].shape[1] >= dim
            if wide.any() and not full:
                gap = top[wide] - values[:, None]
                gap = np.where(np.abs(gap) < 1e-6 * max(theta[0], 1e-300), 1e-6 * max(theta[0], 1e-300), gap)
                better = vectors @ ((vectors.T @ residual[:, wide]) / gap)
                if basis[f].shape[1] + 2 * wide.sum() > basis_size(dim, components) and basis[f].shape[1] > 2 * k:
                    basis[f], image[f] = basis[f] @ turn[:, : 2 * k], image[f] @ turn[:, : 2 * k]
                fresh = _outside(np.hstack([better, residual[:, wide]]), basis[f])
                if fresh.shape[1]:
                    following[f] = fresh
            if f not in following or step == passes - 1:
                weight = lead / np.sqrt(np.clip(top / (rest[f] - 1), 1e-12, None))
                middle = mean - shift[f] / rest[f]
                out[f] = weight, -middle @ weight, bool(full or not wide.any())
                basis.pop(f), image.pop(f)
        new = following
    return out
