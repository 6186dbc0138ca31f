"""Texts for the tests of the corpus operators."""

WORDS = "alba borgo cielo dardo elmo fiume gatto isola lago monte notte onda ponte quercia riva sasso torre uva vento zolla".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "re", "ndo", "to"]) for _ in range(n))
