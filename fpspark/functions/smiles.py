"""SMILES text to molecular graph: one scanner for tokens, one builder for graphs. No Spark here.

The scanner works on bytes, shown as Latin-1 characters. It never fails but for
a bracket that is not closed, and passes over what it does not know.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Atomic numbers by symbol; unknown symbols have 0.
NUMBERS = {"H": 1, "B": 5, "C": 6, "N": 7, "O": 8, "F": 9, "P": 15, "S": 16, "Cl": 17, "Br": 35, "I": 53, "c": 6, "n": 7, "o": 8, "s": 16, "p": 15}
# Hydrogens that an atom outside brackets has, by atomic number; an aromatic carbon has none.
HYDROGENS = {6: 4, 7: 3, 8: 2, 16: 2, 15: 3, 5: 3}
# Bond orders by symbol; 4 is aromatic.
SINGLE, DOUBLE, TRIPLE, AROMATIC = 1, 2, 3, 4
BONDS = {"-": SINGLE, "/": SINGLE, "\\": SINGLE, "=": DOUBLE, "#": TRIPLE, ":": AROMATIC}

TOKEN = re.compile(r"(?P<atom>Br|Cl|[BCNOFPSIcnosp])|(?P<bracket>\[[^\]]*\])|(?P<open>\[)|(?P<ring>[0-9]|%(?s:..))|(?P<bond>[-=#:/\\])|(?P<branch>[()])")


class UnclosedBracket(ValueError):
    """The only text that is no SMILES here."""


@dataclass(frozen=True)
class Atom:
    number: int
    aromatic: bool
    charge: int = 0
    hydrogens: int = 0


@dataclass
class Graph:
    """Atoms, and for each its neighbours with the order of the bond; parallel bonds and loops can occur."""

    atoms: list[Atom] = field(default_factory=list)
    near: list[list[tuple[int, int]]] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.atoms)

    def add(self, atom: Atom) -> int:
        self.atoms.append(atom)
        self.near.append([])
        return len(self.atoms) - 1

    def bond(self, a: int, b: int, order: int) -> None:
        self.near[a].append((b, order))
        self.near[b].append((a, order))


def tokens(smiles: str):
    """(kind, text) of each token: atom, bracket (what is inside), open, ring (its number as text), bond, branch."""
    for m in TOKEN.finditer(smiles.encode().decode("latin-1")):
        kind, text = m.lastgroup, m.group()
        if kind == "bracket":
            text = text[1:-1].encode("latin-1").decode(errors="replace")
        elif kind == "ring" and text[0] == "%":
            # each digit is a byte less that of "0", so other bytes wrap around
            text = str((ord(text[1]) - 48) % 256 * 10 + (ord(text[2]) - 48) % 256)
        yield kind, text


def bracket_symbol(inner: str) -> tuple[str, str]:
    """The element symbol in a bracket, and what follows it."""
    at = len(inner) - len(inner.lstrip("0123456789"))
    end = at
    if inner[at : at + 1].isalpha():
        end += 1
        follows = inner[end : end + 1]
        if follows.islower() and follows.isalpha() and follows != "h":
            end += 1
    return inner[at:end], inner[end:]


def bracket_atom(inner: str) -> Atom:
    """Any H counts as one hydrogen; each sign changes the charge by one; other digits mean nothing."""
    symbol, rest = bracket_symbol(inner)
    return Atom(NUMBERS.get(symbol, 0), symbol[:1].islower(), rest.count("+") - rest.count("-"), int("H" in rest))


def organic_atom(symbol: str) -> Atom:
    number, aromatic = NUMBERS[symbol], symbol.islower()
    return Atom(number, aromatic, 0, 0 if aromatic and number == 6 else HYDROGENS.get(number, 0))


def parse(smiles: str) -> Graph:
    """The graph of a SMILES text; raises UnclosedBracket.

    A bond symbol before an atom or a closing ring label holds; before an
    opening ring label or a branch it is forgotten, and the bond is then single,
    or aromatic between aromatic atoms. Dots are passed over.
    """
    graph, branches, rings = Graph(), [], {}
    last, order, explicit = None, SINGLE, False

    def resolve(a: int, b: int) -> int:
        both = graph.atoms[a].aromatic and graph.atoms[b].aromatic
        return order if explicit else AROMATIC if both else SINGLE

    for kind, text in tokens(smiles):
        if kind in ("atom", "bracket"):
            new = graph.add(organic_atom(text) if kind == "atom" else bracket_atom(text))
            if last is not None:
                graph.bond(last, new, resolve(last, new))
            last, order, explicit = new, SINGLE, False
        elif kind == "bond":
            order, explicit = BONDS[text], True
        elif kind == "ring":
            if last is not None:
                opened = rings.pop(int(text), None)
                if opened is None:
                    rings[int(text)] = last
                else:
                    graph.bond(opened, last, resolve(opened, last))
            order, explicit = SINGLE, False
        elif kind == "open":
            raise UnclosedBracket(smiles)
        elif text == "(":
            branches.append((last, order))
            order, explicit = SINGLE, False
        elif branches:
            (last, order), explicit = branches.pop(), False
    return graph
