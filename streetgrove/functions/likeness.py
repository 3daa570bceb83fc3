"""Scorecard "planted as designers do": fixed values of a logistic model over distance bins."""

# Distance bin edges, metres; distances are capped at CAP_M.
EDGES = (0.0, 1.0, 2.0, 3.0, 5.0, 8.0, 12.0, 20.0)
CAP_M = 40.0
INTERCEPT = -1.6959
LAWN_INSIDE = 1.4011
LAWN_DEEP = 1.4011  # inside a lawn, 4 m or more from its edge
LAWN_DEEP_M = 4.0

# One term per class and bin, in the order of EDGES.
TERMS = {
    "curb": (-1.611, 0.071, 0.7658, 0.423, 0.1931, -0.1454, -0.2476, 0.5481),
    "pavement_edge": (-0.1059, 0.1309, -0.0527, -0.2035, -0.0113, 0.1172, 0.0623, 0.0601),
    "building": (-0.4739, -0.5463, -0.3805, -0.1233, 0.9003, 0.2648, 0.0856, 0.2703),
    "fence": (-0.502, 0.1349, -0.024, 0.0062, 0.2031, 0.0408, 0.1058, 0.0321),
    "existing_tree": (-0.0423, 0.0379, 0.1553, 0.2201, 0.096, -0.1241, -0.0898, -0.2561),
    "utility.power_cable": (-0.1146, 0.3626, 0.0724, 0.099, -0.0702, 0.0687, -0.1471, -0.2737),
    "utility.telecom": (-0.399, 0.0552, 0.1603, -0.1815, 0.0829, -0.0294, 0.0373, 0.2711),
    "utility.water": (-0.4682, 0.2342, 0.2024, 0.1134, 0.0732, 0.0505, -0.0195, -0.1891),
    "utility.sewer": (-0.2263, 0.1678, 0.3094, 0.2895, -0.0696, -0.0561, -0.1572, -0.2605),
    "utility.heat": (-0.0763, 0.491, 0.3641, 0.2499, -0.078, -0.0298, -0.3335, -0.5903),
    "utility.gas": (-0.2599, -0.3564, -0.2854, 0.2829, 0.3291, 0.3061, 0.3436, -0.363),
    "pole": (-0.0677, -0.021, 0.2328, 0.0301, 0.097, -0.0055, -0.0273, -0.2415),
    "power_line_overhead": (0.3517, 0.4487, 0.1418, -0.1083, -0.1667, -0.0989, -0.0503, -0.521),
}


def rows() -> list[tuple[str, float, float, float]]:
    """(class, low, high, term); the last bin reaches past the cap."""
    highs = (*EDGES[1:], CAP_M + 1e-6)
    return [(c, lo, hi, w) for c, terms in TERMS.items() for lo, hi, w in zip(EDGES, highs, terms, strict=True)]
