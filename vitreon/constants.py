"""Tables and physical constants. All values here are fixed: results depend on them."""

from __future__ import annotations

K_B_J = 1.380649e-23
K_B_EV = 8.617333262145e-5
AVOGADRO = 6.02214076e23
#: GPa * cubic angstrom in eV, as p [GPa] * 1e9 * V * this.
PA_A3_TO_EV = 6.2415e-12
COMPOSITION_TOLERANCE = 0.001

# Symbols by atomic number, 1 to 118.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd "
    "Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac "
    "Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
Z = {s: i + 1 for i, s in enumerate(SYMBOLS)}

# Standard atomic weights in g/mol.
MASSES = {
    "H": 1.008, "He": 4.002602, "Li": 6.94, "Be": 9.0121831, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998403163,
    "Ne": 20.1797, "Na": 22.98976928, "Mg": 24.305, "Al": 26.9815385, "Si": 28.085, "P": 30.973761998, "S": 32.06, "Cl": 35.45,
    "Ar": 39.948, "K": 39.0983, "Ca": 40.078, "Sc": 44.955908, "Ti": 47.867, "V": 50.9415, "Cr": 51.9961, "Mn": 54.938044,
    "Fe": 55.845, "Co": 58.933194, "Ni": 58.6934, "Cu": 63.546, "Zn": 65.38, "Ga": 69.723, "Ge": 72.630, "As": 74.921595,
    "Se": 78.971, "Br": 79.904, "Kr": 83.798, "Rb": 85.4678, "Sr": 87.62, "Y": 88.90584, "Zr": 91.224, "Nb": 92.90637, "Mo": 95.95,
    "Ru": 101.07, "Rh": 102.90550, "Pd": 106.42, "Ag": 107.8682, "Cd": 112.414, "In": 114.818, "Sn": 118.710, "Sb": 121.760,
    "Te": 127.60, "I": 126.90447, "Xe": 131.293, "Cs": 132.90545196, "Ba": 137.327, "La": 138.90547, "Ce": 140.116,
    "Pr": 140.90766, "Nd": 144.242, "Sm": 150.36, "Eu": 151.964, "Gd": 157.25, "Tb": 158.92535, "Dy": 162.500, "Ho": 164.93033,
    "Er": 167.259, "Tm": 168.93422, "Yb": 173.054, "Lu": 174.9668, "Hf": 178.49, "Ta": 180.94788, "W": 183.84, "Re": 186.207,
    "Os": 190.23, "Ir": 192.217, "Pt": 195.084, "Au": 196.966569, "Hg": 200.592, "Tl": 204.38, "Pb": 207.2, "Bi": 208.98040,
    "Th": 232.0377, "U": 238.02891,
}

# Common oxidation states of the elements that oxides are made of.
OXIDATION_STATES = {
    "H": (1,), "Li": (1,), "Na": (1,), "K": (1,), "Rb": (1,), "Cs": (1,), "Ag": (1,), "Be": (2,), "Mg": (2,), "Ca": (2,), "Sr": (2,),
    "Ba": (2,), "Zn": (2,), "Cd": (2,), "Cu": (1, 2), "Ni": (2, 3), "Co": (2, 3), "Fe": (2, 3), "Mn": (2, 3, 4, 7), "Cr": (2, 3, 6), "B": (3,),
    "Al": (3,), "Ga": (3,), "In": (3,), "Sc": (3,), "Y": (3,), "La": (3,), "Ce": (3, 4), "Pr": (3,), "Nd": (3,), "Sm": (3,), "Eu": (2, 3),
    "Gd": (3,), "Tb": (3,), "Dy": (3,), "Ho": (3,), "Er": (3,), "Tm": (3,), "Yb": (2, 3), "Lu": (3,), "Bi": (3, 5), "As": (3, 5), "Sb": (3, 5),
    "C": (2, 4), "Si": (4,), "Ge": (4,), "Ti": (3, 4), "Zr": (4,), "Hf": (4,), "Sn": (2, 4), "Pb": (2, 4), "Th": (4,), "U": (4, 6), "Te": (4, 6), "Tl": (1, 3),
    "N": (1, 2, 3, 4, 5), "P": (3, 5), "V": (2, 3, 4, 5), "Nb": (5,), "Ta": (5,), "S": (4, 6), "Se": (4, 6), "Mo": (4, 6), "W": (6,), "O": (-2,),
}

# Roles in an oxide network; everything else counts as a modifier.
FORMERS = "Si B P Ge As Sb Te V".split()
INTERMEDIATES = "Al Ti Zr Be Zn Pb Bi Nb Ta W Mo Ga In Sn Fe Cr".split()
MODIFIERS = "Li Na K Rb Cs Mg Ca Sr Ba La Y Cd Tl".split()

# Cutoffs to oxygen in angstrom where no minimum of g(r) is found.
CUTOFFS = {
    "Si": 2.0, "B": 1.8, "P": 1.8, "Ge": 2.0, "Al": 2.0, "Ti": 2.0, "Zr": 2.2, "Na": 3.52, "K": 3.8, "Ca": 3.0, "Mg": 2.8, "Li": 2.5,
    "Ba": 3.2, "Zn": 2.5, "O": 2.0,
}
CUTOFF_OTHER = 3.0

# Coherent neutron scattering lengths in fm by atomic number.
NEUTRON_B = {
    1: -3.7390, 2: 3.26, 3: -1.90, 4: 7.79, 5: 5.30, 6: 6.6460, 7: 9.36, 8: 5.803, 9: 5.654, 10: 4.566, 11: 3.63, 12: 5.375, 13: 3.449,
    14: 4.1491, 15: 5.13, 16: 2.847, 17: 9.5770, 18: 1.909, 19: 3.67, 20: 4.70, 21: 12.29, 22: -3.438, 23: -0.3824, 24: 3.635, 25: -3.73,
    26: 9.45, 27: 2.49, 28: 10.3, 29: 7.718, 30: 5.680, 31: 7.288, 32: 8.185, 33: 6.58, 34: 7.970, 35: 6.795, 36: 7.81, 37: 7.09, 38: 7.02,
    39: 7.75, 40: 7.16, 41: 7.054, 42: 6.715, 44: 7.03, 45: 5.88, 46: 5.91, 47: 5.922, 48: 4.87, 49: 4.065, 50: 6.225, 51: 5.57, 52: 5.80,
    53: 5.28, 54: 4.92, 55: 5.42, 56: 5.07, 57: 8.24, 58: 4.84, 59: 4.58, 60: 7.69, 61: 12.6, 62: 0.80, 63: 7.22, 64: 6.5, 65: 7.38, 66: 16.9,
    67: 8.01, 68: 7.79, 69: 7.07, 70: 12.43, 71: 7.21, 72: 7.77, 73: 6.91, 74: 4.86, 75: 9.2, 76: 10.7, 77: 10.6, 78: 9.60, 79: 7.63, 80: 12.692,
    81: 8.776, 82: 9.405, 83: 8.532, 88: 10.0, 90: 10.31, 91: 9.1, 92: 8.417, 93: 10.55,
}

# a1 b1 ... a4 b4 of the electron scattering factors of Doyle and Turner (1968) by atomic number, for the elements
# of common glasses. Other elements' parameters are the caller's.
XRAY_TERMS = {
    3: (1.6108, 107.6384, 1.2460, 30.4795, 0.3257, 4.5331, 0.0986, 0.4951),
    5: (0.9446, 46.4438, 1.3120, 14.1778, 0.4188, 3.2228, 0.1159, 0.3767),
    6: (0.7307, 36.9951, 1.1951, 11.2966, 0.4563, 2.8139, 0.1247, 0.3456),
    7: (0.5717, 28.8465, 1.0425, 9.0542, 0.4647, 2.4213, 0.1311, 0.3167),
    8: (0.4548, 23.7803, 0.9173, 7.6220, 0.4719, 2.1440, 0.1384, 0.2959),
    11: (2.2406, 108.0039, 1.3326, 24.5047, 0.9070, 3.3914, 0.2863, 0.4346),
    12: (2.2682, 73.6704, 1.8025, 20.1749, 0.8394, 3.0181, 0.2892, 0.4046),
    13: (2.2756, 72.3220, 2.4280, 19.7729, 0.8578, 3.0799, 0.3166, 0.4076),
    14: (2.1293, 57.7748, 2.5333, 16.4756, 0.8349, 2.8796, 0.3216, 0.3860),
    15: (1.8882, 44.8756, 2.4685, 13.5383, 0.8046, 2.6424, 0.3204, 0.3608),
    20: (4.4696, 99.5228, 2.9708, 22.6958, 1.9696, 4.1954, 0.4818, 0.4165),
}

# Coefficients of the density polynomial over mol% (name _2 and _3: square and cube; a_b and a_b_c: products).
DENSITY_B0, DENSITY_REMAINDER = 2.121560704, 0.02514614
DENSITY_TERMS = {
    "Al2O3": 0.010525974, "Al2O3_2": -0.000076924, "B2O3": 0.00579283, "B2O3_2": 0.000129174, "B2O3_3": -0.000019887,
    "Li2O": 0.012848733, "Li2O_2": -0.000276404, "Li2O_3": 0.00000259, "Na2O": 0.018129123, "Na2O_2": -0.000264838,
    "Na2O_3": 0.000001614, "K2O": 0.019177312, "K2O_2": -0.000319863, "K2O_3": 0.00000191, "MgO": 0.01210604, "MgO_2": -0.000061159,
    "CaO": 0.017992367, "CaO_2": -0.00005478, "SrO": 0.034630735, "SrO_2": -0.000086939, "BaO": 0.049879597, "BaO_2": -0.000168063,
    "ZnO": 0.025221567, "ZnO_2": 0.000099961, "PbO": 0.070020298, "PbO_2": 0.000214424, "PbO_3": -0.000001502,
    "FexOy": 0.036995747, "MnxOy": 0.016648722, "TiO2": 0.018820343, "ZrO2": 0.043059714, "ZrO2_2": -0.000779078,
    "CexOy": 0.061277268, "CdO": 0.052945783, "La2O3": 0.10643194, "Nd2O3": 0.090134135, "NiO": 0.024289113, "ThO2": 0.090253734,
    "UxOy": 0.063297404, "SbxOy": 0.044258719, "SO3": -0.044488661, "F": 0.00109839, "Cl": -0.006092537,
    "Na2O_K2O": -0.000395491, "Na2O_Li2O": -0.00031449, "K2O_Li2O": -0.000329725, "Na2O_B2O3": 0.000242157,
    "K2O_B2O3": 0.000259927, "Li2O_B2O3": 0.000106359, "MgO_B2O3": -0.000206488, "CaO_B2O3": -0.000032258,
    "PbO_B2O3": -0.000186195, "FexOy_B2O3": -0.000720268, "ZrO2_B2O3": -0.000697195, "Al2O3_B2O3": -0.000735749,
    "Li2O_Al2O3": -0.000116227, "Na2O_Al2O3": -0.000253454, "K2O_Al2O3": -0.000371858, "MgO_CaO": 0.000057248,
    "MgO_Al2O3": 0.000167218, "MgO_ZnO": 0.000220766, "Li2O_CaO": -0.00008792, "Na2O_MgO": -0.000300745, "Na2O_CaO": -0.000228249,
    "Na2O_SrO": -0.00023137, "Na2O_BaO": -0.000171693, "K2O_MgO": -0.000337747, "K2O_CaO": -0.000349578, "K2O_SrO": -0.000425589,
    "K2O_BaO": -0.000392897, "Al2O3_CaO": -0.000102444, "Al2O3_PbO": -0.000651745, "Al2O3_TiO2": -0.000563594,
    "Al2O3_BaO": -0.000273835, "Al2O3_SrO": -0.000177761, "Al2O3_ZnO": -0.000109968, "Al2O3_ZrO2": -0.002381651,
    "Na2O_PbO": -0.000036455, "Na2O_TiO2": -0.00014331, "Na2O_ZnO": -0.000155275, "Na2O_ZrO2": -0.000126728,
    "Na2O_FexOy": -0.000371343, "K2O_PbO": -0.000525213, "K2O_TiO2": -0.000386587, "K2O_ZnO": -0.000329812, "CaO_PbO": -0.00084145,
    "ZnO_FexOy": -0.001536804, "Na2O_K2O_B2O3": -0.000032967, "Na2O_MgO_CaO": -0.000009143, "Na2O_MgO_Al2O3": -0.000012286,
    "Na2O_CaO_Al2O3": -0.000005106, "Na2O_CaO_PbO": 0.000100796, "K2O_MgO_CaO": -0.00001217, "K2O_MgO_Al2O3": -0.000041908,
    "K2O_CaO_Al2O3": -0.000012421, "K2O_CaO_PbO": 0.000125759, "MgO_CaO_Al2O3": -0.000011236, "CaO_Al2O3_Li2O": -0.000016177,
    "Al2O3_B2O3_PbO": 0.000030116,
}

POTENTIAL_ORDER = ("pmmcs", "shik", "bjp")
MELT_K = {"pmmcs": 5000.0, "bjp": 5000.0, "shik": 4000.0}

# PMMCS force field, element -> charge, (D, a, r0) of the Morse term to oxygen, repulsion.
PMMCS = {
    "Li": (0.6, (0.001114, 3.429506, 2.681360), 1.0), "Na": (0.6, (0.023363, 1.763867, 3.006315), 5.0),
    "K": (0.6, (0.011612, 2.062605, 3.305308), 5.0), "Be": (1.2, (0.239919, 2.527420, 1.815405), 1.0),
    "Mg": (1.2, (0.038908, 2.281000, 2.586153), 5.0), "Ca": (1.2, (0.030211, 2.241334, 2.923245), 5.0),
    "Sr": (1.2, (0.019623, 1.886000, 3.328330), 3.0), "Ba": (1.2, (0.065011, 1.547596, 3.393410), 5.0),
    "Sc": (1.8, (0.000333, 3.144445, 3.200000), 2.6), "Ti": (2.4, (0.024235, 2.254703, 2.708943), 1.0),
    "Zr": (2.4, (0.206237, 2.479675, 2.436997), 1.0), "Cr": (1.8, (0.399561, 1.785079, 2.340810), 1.0),
    "Mn": (1.2, (0.029658, 1.997543, 2.852075), 3.0), "Fe": (1.2, (0.078171, 1.822638, 2.658163), 2.0),
    "Fe3": (1.8, (0.418981, 1.620376, 2.382183), 2.0), "Co": (1.2, (0.012958, 2.361272, 2.756282), 3.0),
    "Ni": (1.2, (0.029356, 2.679137, 2.500754), 3.0), "Cu": (0.6, (0.090720, 3.802168, 2.055405), 1.0),
    "Ag": (0.6, (0.088423, 3.439162, 2.265956), 1.0), "Zn": (1.2, (0.001221, 3.150679, 2.851850), 1.0),
    "Al": (1.8, (0.361581, 1.900442, 2.164818), 0.9), "Si": (2.4, (0.340554, 2.006700, 2.100000), 1.0),
    "Ge": (2.4, (0.158118, 2.294230, 2.261313), 5.0), "Sn": (2.4, (0.079400, 2.156770, 2.633076), 3.0),
    "P": (3.0, (0.831326, 2.585833, 1.800790), 1.0), "Nd": (1.8, (0.014580, 1.825100, 3.398717), 3.0),
    "Gd": (1.8, (0.000132, 2.013000, 4.351589), 3.0), "Er": (1.8, (0.040448, 2.294078, 2.837722), 3.0),
    "O": (-1.2, (0.042395, 1.379316, 3.618701), 22.0),
}

# BJP force field, charges and (A, rho, sigma, C, D) of the pairs.
BJP_CHARGES = {"Ca": 1.2, "Al": 1.8, "Si": 2.4, "O": -1.2}
BJP = {
    ("Ca", "Ca"): (0.0035, 0.0800, 2.3440, 20.9856, 0.0), ("Ca", "Al"): (0.0032, 0.0740, 1.9572, 17.1710, 0.0),
    ("Ca", "O"): (0.0077, 0.1780, 2.9935, 42.2556, 0.0), ("Al", "Al"): (0.0029, 0.0680, 1.5704, 14.0498, 0.0),
    ("Al", "O"): (0.0075, 0.1640, 2.6067, 34.5747, 0.0), ("O", "O"): (0.0120, 0.2630, 3.6430, 85.0840, 0.0),
    ("Ca", "Si"): (0.0027, 0.0630, 1.8924, 22.9907, 0.0), ("Si", "O"): (0.0070, 0.1560, 2.5419, 46.2930, 0.0),
    ("Al", "Si"): (0.0025, 0.0570, 1.5056, 18.8116, 0.0), ("Si", "Si"): (0.0012, 0.0460, 1.4408, 25.1873, 0.0),
}

# SHIK force field, charges (oxygen's follows from neutrality) and (A, B, C, D) of the pairs.
SHIK_CHARGES = {"Li": 0.5727, "Na": 0.6018, "K": 0.6849, "Mg": 1.0850, "Ca": 1.4977, "B": 1.6126, "Al": 1.6334, "Si": 1.7755, "O": 0.0}
SHIK = {
    ("O", "O"): (1120.5, 2.8927, 26.132, 16800), ("O", "Si"): (23108, 5.0979, 139.70, 66.0), ("Si", "Si"): (2798.0, 4.4073, 0.0, 3423204),
    ("O", "Mg"): (139373, 6.0395, 79.562, 16800), ("Si", "Mg"): (516227, 5.3958, 0.0, 16800), ("Mg", "Mg"): (19669, 4.0000, 0.0, 16800),
    ("O", "Ca"): (146905, 5.6094, 45.073, 16800), ("Si", "Ca"): (77366, 5.0770, 0.0, 16800), ("Ca", "Ca"): (21633, 3.2562, 0.0, 16800),
    ("O", "B"): (16182, 5.6069, 59.203, 32.0), ("B", "B"): (1805.5, 3.8228, 69.174, 6000.0), ("Li", "B"): (4148.6, 3.5726, 102.36, 16800),
    ("Na", "B"): (3148.5, 3.6183, 34.000, 16800), ("K", "B"): (1548.6, 2.7283, 201.36, 16800), ("B", "Si"): (4798.0, 3.6703, 207.0, 16800),
    ("Mg", "B"): (5000.0, 4.0533, 0.736, 16800), ("Ca", "B"): (848.55, 5.9826, 81.355, 16800), ("O", "Li"): (6745.2, 4.9120, 41.221, 70.0),
    ("Si", "Li"): (17284, 4.3848, 0.0, 16800), ("Li", "Li"): (2323.8, 3.9129, 0.0, 3240), ("O", "Na"): (1127566, 6.8986, 40.562, 16800),
    ("Si", "Na"): (495653, 5.4151, 0.0, 16800), ("Na", "Na"): (1476.9, 3.4075, 0.0, 16800), ("O", "K"): (258160, 5.1698, 130.77, 16800),
    ("Si", "K"): (268967, 4.3289, 0.0, 16800), ("K", "K"): (3648.0, 4.4207, 0.0, 16800), ("O", "Al"): (21740, 5.3054, 65.815, 66.0),
    ("Al", "Al"): (1799.1, 3.6778, 100.0, 16800),
}

# Stages of the melt-quench programs: from and to (high or low temperature), default steps, pressure from and to in GPa (None: constant volume).
PROTOCOLS = {
    "pmmcs": (("low", "high", "heating", None, None), ("high", "high", 1_000_000, None, None), ("high", "low", "cooling", None, None), ("low", "low", 1_000_000, 0.0, 0.0), ("low", "low", 100_000, None, None)),
    "bjp": (("low", "high", "heating", 0.0, 0.0), ("high", "high", 100_000, 0.0, 0.0), ("high", "low", "cooling", 0.0, 0.0), ("low", "low", 100_000, 0.0, 0.0), ("low", "low", 100_000, None, None)),
    "shik": (("high", "high", "heating", None, None), ("high", "high", 100_000, None, None), ("high", "high", 700_000, 0.1, 0.1), ("high", "low", "cooling", 0.1, 0.0), ("low", "low", 100_000, 0.0, 0.0)),
}
#: Stages of this program count their default steps in fs of simulated time.
PROTOCOL_FS = {"shik"}
