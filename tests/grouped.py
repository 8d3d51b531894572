"""The grouped dipper histories of FIXTURES.md: (history, females, males)."""

GROUPS = """
1111110 0 1|1111100 1 0|1111000 1 1|1101110 1 0|1100000 2 4|1010000 1 1|1000000 4 5|0111111 2 0|0111110 1 0|0111100 2 1|0111000 1 1
0110110 1 0|0110000 4 7|0100000 18 11|0011111 2 0|0011110 1 1|0011100 2 4|0011000 4 8|0010110 0 1|0010000 18 11|0001111 2 6|0001110 4 3
0001100 5 6|0001011 1 0|0001001 1 1|0001000 10 6|0000111 6 10|0000110 6 3|0000100 7 9|0000011 11 12|0000010 12 11|0000001 22 17
"""


def rows():
    out = []
    for ch, females, males in (part.split() for part in GROUPS.strip().replace("\n", "|").split("|")):
        out += [(ch, "Female")] * int(females) + [(ch, "Male")] * int(males)
    return [(i, *r) for i, r in enumerate(out)]
