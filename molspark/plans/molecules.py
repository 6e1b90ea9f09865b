"""Molecules worked by hand, for the queries that read no table: the strings and what they hold."""

from __future__ import annotations

from ..schema import ELEMENTS, MASS_SCALE, MASS_SHIFT

#: The last two can't be read: no such element, no text.
SMILES = ["CCO", "C=C", "C#N", "C1CCCCC1", "c1ccccc1", "CCCl", "ClCC", "C", "[Na+].[Cl-]", "not_a_smiles", "C1=CC=CC=C1", "CC(=O)N", "F/C=C/F", "N[C@@H](C)C(=O)O",
          "C[Te]C", "*C", "N->[Cu]", "F[Pt@SP1](Cl)(Br)I", "F/C=C\\F", "N[C@H](C)C(=O)O", "CC[N+](C)(C)C", "[13CH4]", "OS(=O)(=O)O", "[Xx]", None]

#: By molecule, its atoms: symbol, hybridization, charge, neighbours, hydrogens; then chirality where there is any.
ATOMS = {
    0: "C SP3 0 1 3, C SP3 0 2 2, O SP3 0 1 1", 1: "C SP2 0 1 2, C SP2 0 1 2", 2: "C SP 0 1 1, N SP 0 1 0", 3: ", ".join(["C SP3 0 2 2"] * 6), 4: ", ".join(["C SP2 0 2 1"] * 6),
    5: "C SP3 0 1 3, C SP3 0 2 2, Cl SP3 0 1 0", 6: "Cl SP3 0 1 0, C SP3 0 2 2, C SP3 0 1 3", 7: "C SP3 0 0 4", 8: "Na S 1 0 0, Cl SP3 -1 0 0", 10: ", ".join(["C SP2 0 2 1"] * 6),
    11: "C SP3 0 1 3, C SP2 0 3 0, O SP2 0 1 0, N SP2 0 1 2", 12: "F SP3 0 1 0, C SP2 0 2 1, C SP2 0 2 1, F SP3 0 1 0",
    13: "N SP3 0 1 2, C SP3 0 3 1 CHI_TETRAHEDRAL_CW, C SP3 0 1 3, C SP2 0 3 0, O SP2 0 1 0, O SP2 0 1 1", 14: "C SP3 0 1 3, Te SP3 0 2 0, C SP3 0 1 3", 15: "* UNSPECIFIED 0 1 0, C SP3 0 1 3",
    16: "N SP3 0 1 3, Cu SP3D2 0 1 0", 17: "F SP3 0 1 0, Pt OTHER 0 4 0 CHI_SQUAREPLANAR, Cl SP3 0 1 0, Br SP3 0 1 0, I SP3 0 1 0", 18: "F SP3 0 1 0, C SP2 0 2 1, C SP2 0 2 1, F SP3 0 1 0",
    19: "N SP3 0 1 2, C SP3 0 3 1 CHI_TETRAHEDRAL_CCW, C SP3 0 1 3, C SP2 0 3 0, O SP2 0 1 0, O SP2 0 1 1", 20: "C SP3 0 1 3, C SP3 0 2 2, N SP3 1 4 0, C SP3 0 1 3, C SP3 0 1 3, C SP3 0 1 3",
    21: "C SP3 0 0 4", 22: "O SP3 0 1 1, S SP3 0 4 0, O SP2 0 1 0, O SP2 0 1 0, O SP3 0 1 1",
}
#: By molecule, how many bonds there are of a kind; then whether they are conjugated (c) or in a ring (r), and their stereo mark.
BONDS = {
    0: "2 SINGLE", 1: "1 DOUBLE", 2: "1 TRIPLE", 3: "6 SINGLE r", 4: "6 AROMATIC cr", 5: "2 SINGLE", 6: "2 SINGLE", 10: "6 AROMATIC cr", 11: "1 SINGLE, 1 SINGLE c, 1 DOUBLE c", 12: "2 SINGLE, 1 DOUBLE STEREOE",
    13: "3 SINGLE, 1 SINGLE c, 1 DOUBLE c", 14: "2 SINGLE", 15: "1 SINGLE", 16: "1 DATIVE", 17: "4 SINGLE", 18: "2 SINGLE, 1 DOUBLE STEREOZ", 19: "3 SINGLE, 1 SINGLE c, 1 DOUBLE c", 20: "5 SINGLE", 22: "2 SINGLE, 2 DOUBLE",
}
ISOTOPES = {21: 13.0}


def atom_rows() -> list[tuple]:
    """(mol_id, idx, symbol, hybridization, charge, degree, hydrogens, chirality)."""
    out = []
    for m, text in ATOMS.items():
        for i, own in enumerate(x.split() for x in text.split(", ")):
            out.append((m, i, own[0], own[1], *map(int, own[2:5]), own[5] if len(own) > 5 else "CHI_UNSPECIFIED"))
    return out


def bond_rows() -> list[tuple]:
    """(mol_id, n, kind, conjugated, in_ring, stereo)."""
    out = []
    for m, text in BONDS.items():
        for n, kind, *more in (x.split() for x in text.split(", ")):
            marks, stereo = "".join(x for x in more if len(x) < 3), next((x for x in more if len(x) > 2), "STEREONONE")
            out.append((m, int(n), kind, "c" in marks, "r" in marks, stereo))
    return out


def features() -> dict[int, dict[str, float]]:
    """By molecule, the features that aren't 0: of all atoms but the last, and of all bonds."""
    out: dict[int, dict[str, float]] = {m: {} for m in range(len(SMILES))}
    rings = {m: {k: sum(n for x, n, kind, _, ring, _ in bond_rows() if x == m and ring and kind in kinds) for k, kinds in (("ring", ("SINGLE", "AROMATIC")), ("aromatic", ("AROMATIC",)))} for m in out}

    def add(m: int, name: str, n: float) -> None:
        out[m][name] = out[m].get(name, 0.0) + n

    for m, i, symbol, hybrid, _, _, _, chirality in atom_rows():
        if i + 1 == len(ATOMS[m].split(", ")):
            continue
        add(m, f"atom_{symbol}" if symbol not in ("Te", "*") else "atom_Unknown", 1)
        add(m, f"hyb_{hybrid if hybrid != 'UNSPECIFIED' else 'OTHER'}", 1)
        add(m, f"total_{chirality if chirality != 'CHI_SQUAREPLANAR' else 'CHI_OTHER'}", 1)
        add(m, "atomic_mass", (ISOTOPES.get(m, ELEMENTS[symbol][0]) - MASS_SHIFT) / MASS_SCALE)
        if rings[m]["ring"]:
            add(m, "total_atom_in_ring", 1)
        if rings[m]["aromatic"]:
            add(m, "total_atom_in_aromatic_ring", 1)
    for m, n, kind, conjugated, ring, stereo in bond_rows():
        add(m, f"total_{kind.lower() if kind != 'DATIVE' else 'aromatic'}", n)
        add(m, f"total_{stereo}", n)
        if conjugated:
            add(m, "total_conjugated_bond", n)
        if ring:
            add(m, "total_bond_in_ring", n)
    return out
