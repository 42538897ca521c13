"""1024-bit circular fingerprints of molecular graphs, radius 2. No Spark here."""

from __future__ import annotations

from struct import pack
from zlib import crc32

from .smiles import Graph, UnclosedBracket, parse

BITS, WORDS, RADIUS = 1024, 16, 2


def environments(graph: Graph, radius: int = RADIUS):
    """The hashes of all atoms' environments, one list for each radius from 0 on."""
    hashes = [crc32(bytes([a.number, len(n) % 256, a.hydrogens, (a.charge + 10) % 256, a.aromatic])) for a, n in zip(graph.atoms, graph.near, strict=True)]
    yield hashes
    for _ in range(radius):
        around = (sorted((order, hashes[j]) for j, order in n) for n in graph.near)
        hashes = [crc32(b"".join([pack("<II", h, a.number), *(pack("<BI", *x) for x in near)])) for h, a, near in zip(hashes, graph.atoms, around, strict=True)]
        yield hashes


def bits(smiles: str) -> list[int]:
    """The set bits, ascending; none for a text that cannot be parsed or has no atoms."""
    try:
        graph = parse(smiles)
    except UnclosedBracket:
        return []
    return sorted({h % BITS for hashes in environments(graph) for h in hashes})


def words(bit_list) -> list[int]:
    """Bits as 16 signed 64-bit words, lowest bit first."""
    out = [0] * WORDS
    for b in bit_list:
        out[b >> 6] |= 1 << (b & 63)
    return [w - (1 << 64) if w >> 63 else w for w in out]


def fingerprint(smiles: str) -> list[int]:
    return words(bits(smiles))
