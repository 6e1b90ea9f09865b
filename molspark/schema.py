"""The molecular feature schema: 68 features with unique names, the elements, and the score ranges."""

from __future__ import annotations

# Names and order of the features.
SYMBOLS = ["H", "C", "N", "O", "S", "F", "Si", "P", "Cl", "Br", "Mg", "Na", "Ca", "Fe", "As", "Al", "I", "B", "V", "K", "Tl", "Yb", "Sb", "Sn", "Ag", "Pd", "Co", "Se", "Ti", "Zn", "Li", "Ge", "Cu", "Au", "Ni", "Cd", "In", "Mn", "Zr", "Cr", "Pt", "Hg", "Pb", "Unknown"]
HYBRIDS = ["S", "SP", "SP2", "SP3", "SP3D", "SP3D2", "OTHER"]
CHIRAL = ["CHI_UNSPECIFIED", "CHI_TETRAHEDRAL_CW", "CHI_TETRAHEDRAL_CCW", "CHI_OTHER"]
BONDS = ["SINGLE", "DOUBLE", "TRIPLE", "AROMATIC"]
STEREO = ["STEREOZ", "STEREOE", "STEREOANY", "STEREONONE"]
MASS_SHIFT, MASS_SCALE = 10.812, 116.092

ATOM_FEATURES = [f"atom_{s}" for s in SYMBOLS] + [f"hyb_{h}" for h in HYBRIDS] + ["total_atom_in_ring", "total_atom_in_aromatic_ring", "atomic_mass"] + [f"total_{c}" for c in CHIRAL]
BOND_FEATURES = [f"total_{b.lower()}" for b in BONDS] + ["total_conjugated_bond", "total_bond_in_ring"] + [f"total_{s}" for s in STEREO]
FEATURES = ATOM_FEATURES + BOND_FEATURES

# The elements by atomic number and their standard atomic weights (the mass number of the longest-lived isotope where there is none).
_NAMES = """H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe
 Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og""".split()
_MASSES = [1.008, 4.003, 6.941, 9.012, 10.812, 12.011, 14.007, 15.999, 18.998, 20.18, 22.99, 24.305, 26.982, 28.086, 30.974, 32.067, 35.453, 39.948, 39.098, 40.078, 44.956, 47.867, 50.942, 51.996, 54.938, 55.845, 58.933, 58.693, 63.546, 65.39,
           69.723, 72.61, 74.922, 78.96, 79.904, 83.8, 85.468, 87.62, 88.906, 91.224, 92.906, 95.94, 98, 101.07, 102.906, 106.42, 107.868, 112.412, 114.818, 118.711, 121.76, 127.6, 126.904, 131.29, 132.905, 137.328, 138.906, 140.116, 140.908, 144.24,
           145, 150.36, 151.964, 157.25, 158.925, 162.5, 164.93, 167.26, 168.934, 173.04, 174.967, 178.49, 180.948, 183.84, 186.207, 190.23, 192.217, 195.078, 196.967, 200.59, 204.383, 207.2, 208.98, 209, 210, 222, 223, 226, 227, 232.038,
           231.036, 238.029, 237, 244, 243, 247, 247, 251, 252, 257, 258, 259, 262, 267, 268, 269, 270, 269, 278, 281, 281, 285, 284, 289, 288, 293, 292, 294]


def outer_electrons(number: int) -> int:
    """By place in the period: d shells count until they are full, f shells until the fourteenth."""
    n = number - max((c for c in (0, 2, 10, 18, 36, 54, 86) if c < number), default=0)
    if number > 54 and n > 16:
        n -= 14
    return n - 10 if number > 18 and 12 <= n <= 18 and not (number > 54 and number - (54 if number <= 86 else 86) <= 16) else n


#: symbol: (mass, outer electrons); an atom of no element (``*``) has neither.
ELEMENTS = {s: (m, outer_electrons(i)) for i, (s, m) in enumerate(zip(_NAMES, _MASSES, strict=True), 1)} | {"*": (0.0, 0)}
# Van der Waals and covalent radii, and what they are scaled by.
RADII = {"H": (1.2, 0.23), "B": (1.8, 0.83), "C": (1.7, 0.68), "N": (1.6, 0.68), "O": (1.55, 0.68), "F": (1.5, 0.64), "Si": (2.1, 1.2), "P": (1.95, 1.05), "S": (1.8, 1.02), "Cl": (1.8, 0.99), "Br": (1.9, 1.21), "I": (2.1, 1.4)}
VDW_SHIFT, VDW_SCALE, COVALENT_SHIFT, COVALENT_SCALE = 1.5, 0.6, 0.64, 0.76
VALENCES = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}
EDGES = (0.39941986, 0.51981407, 0.69371681, 0.81411102)
