"""Structural alerts: catalogs of patterns and their search.

The built-in lists are short public ones; a full catalog is a parameter (``Entry`` rows read
from the user's own file), as long tables of patterns are not part of this package.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

from .mol import NUMBER, Mol
from .smarts import Pattern


class Entry(NamedTuple):
    catalog: str  # family as reported
    name: str
    description: str
    smarts: str


_PAINS, _BRENK, _NIH = "PAINS filters (family {})", "unwanted functionality due to potential tox reasons or unfavourable pharmacokinetic properties", "annotations of problematic functional groups"
#: Published patterns (fixed values): (family, name, SMARTS).
_ENTRIES = [
    ("PAINS_A", "azo_A(324)", "[#7;!R]=[#7]"),
    ("PAINS_A", "quinone_A(370)", "[!#6;!#1]=[#6]1[#6]=,:[#6][#6](=[!#6;!#1])[#6]=,:[#6]1"),
    ("PAINS_A", "ene_rhod_A(235)", "[#7]1[#6](=[#16])[#16][#6](=[#6])[#6]1=[#8]"),
    ("PAINS_B", "catechol_A(92)", "c1c(O[#1])c(O[#1])ccc1"),
    ("PAINS_B", "rhod_sat_A(33)", "[#7]1[#6](=[#16])[#16][#6;X4][#6]1=[#8]"),
    ("Brenk", "aldehyde", "[CX3H1](=O)[#6]"),
    ("Brenk", "acyl_halide", "[F,Cl,Br,I]C(=O)[#6]"),
    ("Brenk", "alkyl_halide", "[Br,Cl,I][CX4;H1,H2]"),
    ("Brenk", "azide", "N=[N+]=[N-]"),
    ("Brenk", "azo_group", "[#6]N=N[#6]"),
    ("Brenk", "catechol", "c1cc(O[#1])c(O[#1])cc1"),
    ("Brenk", "hydroquinone", "c1cc([OX2])ccc1[OX2H1,NX3H1]"),
    ("Brenk", "isocyanate", "[NX2]=C=O"),
    ("Brenk", "isothiocyanate", "[NX2]=C=S"),
    ("Brenk", "michael_acceptor", "[CH2]=[CH]C(=O)[!O;!N]"),
    ("Brenk", "nitro_group", "[N+](=O)[O-]"),
    ("Brenk", "nitroso", "[#6][NX2]=O"),
    ("Brenk", "oxygen-nitrogen_single_bond", "[OX2;H1,$(O[#6])][NX3;!$(N=*);!$(NC=O)]"),
    ("Brenk", "peroxide", "OO"),
    ("Brenk", "phenol_ester", "c1ccccc1OC(=O)[#6]"),
    ("Brenk", "quinone", "O=C1C=CC(=O)C=C1"),
    ("Brenk", "rhodanine", "O=C1CSC(=S)N1"),
    ("Brenk", "thiol", "[SX2H1]"),
    ("Brenk", "thiocarbonyl_group", "[#6]=S"),
    ("Brenk", "three-membered_heterocycle", "C1[O,S,N]C1"),
    ("Brenk", "triple_bond", "C#C"),
    ("NIH", "catechol", "c1cc(O[#1])c(O[#1])cc1"),
    ("NIH", "nitro", "[#6][N+](=O)[O-]"),
    ("NIH", "azo", "[#6]N=N[#6]"),
    ("NIH", "quinone", "O=C1C=CC(=O)C=C1"),
    ("ZINC", "peroxide", "OO"),
    ("ZINC", "acyl_halide", "[F,Cl,Br,I]C(=O)[#6]"),
]
ENTRIES = tuple(Entry(f, n, _PAINS.format(f[-1]) if f.startswith("PAINS") else _BRENK if f == "Brenk" else _NIH if f == "NIH" else "reactive groups", s) for f, n, s in _ENTRIES)
#: Requested name: families.
CATALOGS = {"pains": ("PAINS_A", "PAINS_B", "PAINS_C"), "pains_a": ("PAINS_A",), "pains_b": ("PAINS_B",), "pains_c": ("PAINS_C",), "brenk": ("Brenk",), "nih": ("NIH",), "zinc": ("ZINC",)}


@lru_cache(maxsize=4096)
def _compiled(smarts: str) -> Pattern:
    return Pattern(smarts)


@lru_cache(maxsize=64)
def _family(name: str, entries: tuple[Entry, ...]) -> tuple[Entry, ...]:
    if name not in CATALOGS:
        raise KeyError(f"no catalog {name!r}; there are {', '.join(CATALOGS)}")
    return tuple(e for e in entries if e.catalog in CATALOGS[name])


def find_alerts(mol: Mol, catalogs: tuple[str, ...], entries: tuple[Entry, ...] = ENTRIES) -> list[dict]:
    """Every entry that occurs, in order of request, with the atoms of all its occurrences; equal hits once."""
    out: dict[tuple, dict] = {}
    present = {NUMBER[a.symbol] for a in mol}
    for name in dict.fromkeys(catalogs):
        for e in _family(name, entries):
            pattern = _compiled(e.smarts)
            found = pattern.needs <= present and pattern.matches(mol)
            if found:
                atoms = sorted(frozenset().union(*found))
                out.setdefault((e.catalog, e.name, tuple(atoms)), {"catalog": e.catalog, "name": e.name, "description": e.description, "atom_indices": atoms})
    return list(out.values())
