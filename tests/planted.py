"""Fixtures with a known answer."""

from __future__ import annotations

import numpy as np

from longitab.functions.draws import normals, uniforms

COEFFICIENT = {0: -0.8, 1: 0.0, 2: 0.8}


def ar_order(spark, n=900, steps=6, seed=1, shares=(0.7, 0.9)):
    """Packed sequences of one feature: the class sets only the lag-1 coefficient, and every
    visit has unit variance."""
    ids = np.arange(n)
    u = uniforms(seed + 1000, ids, 1)[:, 0]
    label = np.searchsorted(np.array(shares), u, side="right")
    e = normals(seed, ids, steps)
    a = np.array([COEFFICIENT[c] for c in label])
    x = np.zeros((n, steps))
    x[:, 0] = e[:, 0]
    for t in range(1, steps):
        x[:, t] = a * x[:, t - 1] + np.sqrt(1 - a**2) * e[:, t]
    rows = [(int(i), int(c), [[float(v)] for v in row], [True] * steps, steps)
            for i, c, row in zip(ids, label, x)]
    return spark.createDataFrame(
        rows, "entity_id bigint, label int, seq array<array<double>>, mask array<boolean>, len int")


def wide55(rows=400, rank=39, width=55, seed=3):
    """Correlated columns of rank 39 with small noise."""
    base = normals(seed, np.arange(rows), rank)
    mix = normals(seed + 1, np.arange(rank), width)
    return base @ mix + 0.01 * normals(seed + 2, np.arange(rows), width)
