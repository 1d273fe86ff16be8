"""Component likelihoods of pairs of samples at many sites at once, in numpy."""

from __future__ import annotations

import numpy as np

from kinfold.functions.identity import STATES, genotypes, mode


def mode_tables() -> dict[int, list[tuple]]:
    """For 2, 3, 4 alleles: (gx, gy, alleles, pattern)."""
    return {a: [(x, y, g + h, mode(*g, *h)) for x, g in enumerate(genotypes(a)) for y, h in enumerate(genotypes(a))] for a in (2, 3, 4)}


CODE = {m: [compile(s.get(m, "0.0"), "state", "eval") for s in STATES] for m in range(1, 16)}


def model_tensor(af: np.ndarray) -> np.ndarray:
    """Model of sites with the same number of alleles: [site, gx, gy, state]."""
    v, a = af.shape
    n = a * (a + 1) // 2
    out = np.zeros((v, n, n, 9))
    for x, y, alleles, mode in mode_tables()[a]:
        p = {f"p{c}": af[:, k] for c, k in zip("ijkl", alleles, strict=True)}
        for s, code in enumerate(CODE[mode]):
            out[:, x, y, s] = eval(code, {}, p)  # noqa: S307  the fixed table above
    return out


#: Samples whose half sums are held at once.
HALVES = 32


def known(lik: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Likelihoods [v, q, g] with 0 for samples that miss one, and which samples have data."""
    there = ~np.isnan(lik).any(2)
    return np.where(there[:, :, None], lik, 0.0), there


def half_sums(lik: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Of known likelihoods [v, q, g], summed with the model over g: [v, q, h, 9]. Others' times that,
    summed over h, are the component likelihoods; one product serves all q of a site."""
    v, g = model.shape[:2]
    return np.matmul(lik, model.reshape(v, g, -1)).reshape(v, -1, g, 9)


def component_rows(a: np.ndarray, b: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one sample's likelihoods a[v, g] with those of others, b[v, q, h]: component likelihoods
    [q, v, 9], and where both have data; elsewhere they are 0."""
    there = ~np.isnan(a).any(1)[:, None] & ~np.isnan(b).any(2)
    half = np.einsum("vg,vghs->vhs", np.nan_to_num(a), model, optimize=True)
    rows = np.matmul(np.nan_to_num(b), half)
    rows[~there] = 0.0
    return rows.transpose(1, 0, 2), there.T
