import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fpspark.functions.fingerprint import bits, fingerprint, words
from fpspark.functions.properties import properties
from fpspark.functions.scaffold import analyze, decompose
from fpspark.functions.smiles import UnclosedBracket, parse
from fpspark.plans.catalog import GOLDEN

# Pairwise similarities of the golden molecules (fixed values).
PAIRS = {("ethanol", "benzene"): 0.0, ("ethanol", "aspirin"): 0.058824, ("ethanol", "caffeine"): 0.058824, ("ethanol", "ibuprofen"): 0.121212, ("benzene", "aspirin"): 0.071429, ("benzene", "caffeine"): 0.071429, ("benzene", "ibuprofen"): 0.033333, ("aspirin", "caffeine"): 0.148936, ("aspirin", "ibuprofen"): 0.195652, ("caffeine", "ibuprofen"): 0.1}
SMILES = {n: s for n, s, *_ in GOLDEN}


@pytest.mark.parametrize("name, smiles, pop, mw, logp, rot, heavy, rings", GOLDEN)
def test_golden(name, smiles, pop, mw, logp, rot, heavy, rings):
    assert len(bits(smiles)) == pop
    p = properties(smiles)
    assert p.mw == pytest.approx(mw, abs=1e-3) and p.logp == pytest.approx(logp, abs=1e-3)
    assert (p.rot_bonds, p.heavy_atoms, p.ring_count) == (rot, heavy, rings)


@pytest.mark.parametrize("pair, score", PAIRS.items())
def test_golden_pairs(pair, score):
    a, b = (set(bits(SMILES[x])) for x in pair)
    assert len(a & b) / len(a | b) == pytest.approx(score, abs=1e-5)


def broken():
    """Texts that end or turn wrong in every state of the grammar: all beginnings and ends of a text that has each kind of token, and its characters at random."""
    whole = "N#Cc1cc(Br)c([13CH2-:7])c%12[nH+]s1/C=C\\\\O.F%12"
    rng = random.Random(2)
    return sorted({*(whole[:k] for k in range(len(whole))), *(whole[k:] for k in range(len(whole))), *("".join(rng.choice(whole) for _ in range(rng.randrange(1, 9))) for _ in range(40))})


@pytest.mark.parametrize("smiles", broken())
def test_malformed_texts_do_not_fail(smiles):
    bits(smiles), properties(smiles), analyze(smiles), decompose(smiles)


def test_unclosed_bracket_has_no_bits():
    with pytest.raises(UnclosedBracket):
        parse("C[NH2")
    assert fingerprint("C[NH2") == [0] * 16


def test_ring_labels_of_two_digits():
    assert bits("C1CCCCCCCCCC1") == bits("C%10CCCCCCCCCC%10")


def test_words_are_signed():
    assert words([0, 63, 64, 1023]) == [1 - (1 << 63), 1, *[0] * 13, -(1 << 63)]


@pytest.mark.parametrize("smiles, text, systems, rings, atoms, linkers, heavy", [("c1ccccc1", "c1ccccc1", 1, 1, 6, 0, 6), ("CCO", "", 0, 0, 0, 0, 3), ("c1ccc2ccccc2c1", None, 1, 2, 10, 0, 10), ("CC(=O)Oc1ccccc1C(=O)O", "c1ccccc1", 1, 1, 6, 0, 13), ("Cc1ccc(Cc2ccccc2)cc1", None, 2, 2, 13, 1, 14)])
def test_scaffolds(smiles, text, systems, rings, atoms, linkers, heavy):
    s = analyze(smiles)
    assert (s.ring_systems, s.ring_count, s.scaffold_atoms, s.linker_atoms, s.heavy_atoms) == (systems, rings, atoms, linkers, heavy)
    assert text is None or s.scaffold_smiles == text
    assert (s.scaffold_key == 0) == (text == "")


def test_scaffold_keys():
    key = lambda s: analyze(s).scaffold_key
    assert key("c1ccccc1") == key("Cc1ccccc1") == key("CC(=O)Oc1ccccc1C(=O)O") != key("c1ccc2ccccc2c1")
    assert key("c1ccccc1") != key("C1=CC=CC=C1")
    assert key("[") == key("") == 0


def test_r_groups():
    assert [(g.attach_symbol, g.smiles) for g in decompose("Cc1ccccc1").r_groups] == [("c", "*C")]
    assert {g.smiles for g in decompose("CC(=O)Oc1ccccc1C(=O)O").r_groups} == {"*C(O)=O", "*OC(C)=O"}
    assert [g.smiles for g in decompose("Oc1cccc(O)c1").r_groups] == ["*O", "*O"]


def test_long_chains_and_rings_need_no_deep_stack():
    long = "C1" + "C" * 5000 + "1" + "C(" * 500 + "C" + ")" * 500
    assert analyze(long).scaffold_atoms == 5001


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="CNOSPFIBclrnosp[]()=#-:/\\%0123456789H+@*. é", max_size=40))
def test_any_text_is_taken(smiles):
    assert len(bits(smiles)) <= 1024
    p = properties(smiles)
    assert p.heavy_atoms >= 0 and p.rot_bonds >= 0
    assert analyze(smiles).scaffold_atoms <= max(1, analyze(smiles).heavy_atoms)
    decompose(smiles)
