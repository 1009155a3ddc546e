"""Results depend on them, so they are stated as plain text."""

# The three sentiment dimensions (evaluation, potency, activity).
DIMS = ("e", "p", "a")

# Entity prefixes and the neutral entity of behaviour constraints.
IDENTITY_PREFIX = "i_"
SENTWORD_PREFIX = "z_"
ZERO = "ZERO"

# Fixed value: added to lexicon values so that none is exactly zero.
VALUE_OFFSET = 0.0001

# Half-range of the survey scale.
SCALE = 4.3

# Offsets between survey and text scores, per dimension.
BIAS = {"e": 0.18, "p": 0.56, "a": -0.57}

# Words that negate.
NEGATION_WORDS = (
    "never no nothing nowhere noone none not "
    "havent haven't doesn't doesnt hasnt hasn't won't wont wouldnt wouldn't "
    "hadnt hadn't cant can't dont don't couldnt couldn't shouldnt shouldn't "
    "didnt didn't isn't isnt arent aren't aint ain't"
).split()

# Verbs that never make an event or behaviour.
EXCLUDED_BEHAVIOURS = "be would will can want go".split()

# Whole tokens whose final s is not a plural.
NO_PLURAL = "is does was".split()

# Variables of the event and modifier equations.
EVENT_VARS = "ae ap aa be bp ba oe op oa".split()
MODIFIER_VARS = "te tp ta ie ip ia".split()

# Event equation.  First field: which variables multiply (in the
# order of EVENT_VARS); then the coefficient for each of the nine outputs.
EVENT_EQUATION = """
Z000000000 -0.155 -0.100 0.140 -0.140 0.060 0.17 0.025 -0.395 -0.035
Z100000000 0.410 0.000 0.050 0.110 0.000 0.02 0.000 0.000 0.000
Z010000000 0.000 0.560 0.000 0.000 0.160 -0.06 0.000 0.000 0.000
Z001000000 0.000 0.060 0.705 0.000 0.000 0.30 0.000 0.000 0.000
Z000100000 0.420 -0.105 -0.060 0.555 -0.150 0.04 0.110 0.150 0.020
Z000010000 -0.020 0.440 0.000 0.000 0.685 0.00 0.000 -0.110 0.000
Z000001000 -0.100 0.000 0.290 -0.120 0.000 0.64 0.000 0.000 0.000
Z000000100 0.030 0.040 0.000 0.000 0.030 0.00 0.610 -0.115 0.030
Z000000010 0.060 0.000 0.000 0.050 -0.015 0.00 0.000 0.660 -0.050
Z000000001 0.000 0.000 0.000 0.000 0.000 0.00 -0.010 0.070 0.745
Z100100000 0.050 0.000 0.000 0.000 0.010 0.00 0.030 0.000 0.000
Z100000010 0.030 0.000 0.000 0.000 0.000 0.00 0.000 0.000 0.000
Z010010000 0.000 -0.050 0.000 0.000 0.000 0.00 0.000 0.000 0.000
Z001001000 0.000 0.000 -0.060 0.000 0.000 0.00 0.000 0.000 0.000
Z000100100 0.120 0.010 0.000 0.110 0.020 0.00 0.040 0.030 0.000
Z000100010 -0.050 0.000 0.000 -0.050 0.000 0.00 0.000 0.030 0.000
Z000010100 -0.050 0.000 0.000 -0.020 0.000 0.00 -0.030 0.000 0.000
Z000010010 0.000 0.000 0.000 0.000 0.000 0.00 0.000 -0.050 0.000
Z100100100 0.030 0.000 0.000 0.020 0.000 0.00 0.000 0.000 0.000
Z100100010 -0.020 0.000 0.000 0.000 0.000 0.00 0.000 0.000 0.000
"""

# Modifier equation, same form over MODIFIER_VARS, outputs e p a.
MODIFIER_EQUATION = """
Z000000 -0.32 -0.18 -0.11
Z100000 0.69 -0.18 -0.04
Z010000 -0.36 0.65 0.07
Z001000 0.00 0.01 0.53
Z000100 0.47 -0.01 -0.02
Z000010 0.01 0.59 -0.02
Z000001 -0.07 0.05 0.64
Z100100 0.12 0.00 0.00
"""


def equation_terms(text: str, variables: list[str]) -> list[list[tuple[float, list[str]]]]:
    """Per output, the non-zero ``(coefficient, variables)`` terms of a table."""
    rows = [line.split() for line in text.strip().splitlines()]
    outputs: list[list[tuple[float, list[str]]]] = [[] for _ in rows[0][1:]]
    for mask, *coefs in rows:
        used = [v for v, bit in zip(variables, mask.lstrip("Z")) if bit == "1"]
        for out, coef in zip(outputs, coefs):
            if float(coef):
                out.append((float(coef), used))
    return outputs
