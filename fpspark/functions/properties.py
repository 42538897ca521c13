"""Scalar properties of molecules, from tokens alone. No Spark here.

Sums are kept in 32-bit floats, in the order of the tokens.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .smiles import AROMATIC, BONDS, SINGLE, bracket_symbol, tokens

# Masses by symbol (aromatic atoms have their element's), and of a hydrogen.
MASSES = {"H": 1.0079, "B": 10.811, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "P": 30.974, "S": 32.065, "Cl": 35.453, "Br": 79.904, "I": 126.904, "c": 12.011, "n": 14.007, "o": 15.999, "s": 32.065, "p": 30.974}
HYDROGEN = 1.0079
# Contributions to logP, aliphatic and aromatic.
LOGP = {"C": (0.1441, 0.1581), "N": (-0.2090, -0.4806), "O": (-0.2062, -0.2202), "S": (0.1155, 0.0743), "F": (0.4202, 0.4202), "Cl": (0.6895, 0.6895), "Br": (0.8456, 0.8456), "I": (0.8857, 0.8857), "P": (0.8612, 0.8612)}
# Hydrogens of an atom outside brackets.
HYDROGENS = {"C": 4, "c": 4, "N": 3, "n": 3, "O": 2, "o": 2, "S": 2, "s": 2, "P": 3, "p": 3, "B": 3}


class Properties(NamedTuple):
    mw: float
    logp: float
    rot_bonds: int
    heavy_atoms: int
    ring_count: int


def _hydrogens(rest: str) -> int:
    """Hydrogens named after a bracket's symbol: the last H counts, with the one digit after it or as one."""
    found = 0
    for k, c in enumerate(rest):
        if c == "H":
            follows = rest[k + 1 : k + 2]
            found = int(follows) if follows in set("0123456789") else 1
    return found


def _logp(symbol: str, aromatic: bool) -> float:
    pair = LOGP.get(symbol.upper() if len(symbol) == 1 else symbol)
    return pair[aromatic] if pair else 0.0


def properties(smiles: str) -> Properties:
    """mw and logp over all atoms; bonds of order one whose ends both have two bonds or more; atoms; closed rings."""
    f32 = np.float32
    mw, logp = f32(0), f32(0)
    aromatic: list[bool] = []
    degree: list[int] = []
    single: list[tuple[int, int]] = []
    branches, opened = [], {}
    last, order, n_rings = None, SINGLE, 0

    def bond(a: int, b: int, kind: int) -> None:
        degree[a] += 1
        degree[b] += 1
        if kind == SINGLE:
            single.append((a, b))

    for kind, text in tokens(smiles):
        if kind in ("atom", "bracket"):
            symbol, rest = (text, "") if kind == "atom" else bracket_symbol(text)
            h = HYDROGENS.get(symbol, 0) if kind == "atom" else _hydrogens(rest)
            new, soft = len(degree), symbol[:1].islower()
            aromatic.append(soft)
            degree.append(0)
            mw = mw + f32(MASSES.get(symbol, 0.0)) + f32(h) * f32(HYDROGEN)
            logp = logp + f32(_logp(symbol, soft))
            if last is not None:
                bond(last, new, AROMATIC if soft and aromatic[last] else order)
            last, order = new, SINGLE
        elif kind == "bond":
            order = BONDS[text]
        elif kind == "branch":
            if text == "(":
                branches.append(last)
            elif branches:
                last, order = branches.pop(), SINGLE
        elif kind == "ring" and last is not None:
            if text in opened:
                bond(opened.pop(text), last, order)
                n_rings, order = n_rings + 1, SINGLE
            else:
                opened[text] = last
    turning = sum(degree[a] > 1 and degree[b] > 1 for a, b in single)
    return Properties(float(mw), float(logp), turning, len(degree), n_rings)
