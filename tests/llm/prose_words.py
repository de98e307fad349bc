"""Made-up prose for tests."""

WORDS = "amber birch cedar delta ember fjord grove heron inlet juniper kelp larch maple noble ocean pine quartz river stone tide umber vale willow xenon yarrow zephyr".split()


def prose(seed: int, n: int) -> str:
    """n words that depend on the seed only."""
    out, x = [], seed * 2654435761 % 2**32
    for _ in range(n):
        x = (x * 1664525 + 1013904223) % 2**32
        out.append(WORDS[(x >> 8) % len(WORDS)] + WORDS[(x >> 16) % len(WORDS)])
    return " ".join(out)
