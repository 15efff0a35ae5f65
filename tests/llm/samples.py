"""Rows that every operator must stand."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, label string, epoch int, tokens string, host string, rank int, key string, distance int, domain string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, extra columns with clashing names."""
    extra = ("x", 1, "y", "h", 2, "k", 3, "d")
    base = prose(1, 120)
    rows = [
        (1, base, "en", "src1", 10), (2, base, "en", "src1", 10), (2, base, "en", "src1", 10), (3, base.replace("alpha", "omega", 1), "en", "src2", 10), (None, base, "en", "src1", 10),
        (4, None, "en", "src1", None), (5, "", None, None, 0), (6, "  \n\t ", "de", "", 4), (7, "word", "fr", "src3", 4), (8, prose(2, 30_000), "en", "src4", None), (None, None, None, None, None),
        (9, "é " * 50 + "<|endoftext|> 　 ünï", "zz", "host", 1), (10, prose(3, 200), "de", "src5", 1), (11, prose(4, 200), "es", "src6", 1), (12, "x" * 200_000, "en", "src7", 1),
    ]
    return [r + extra for r in rows]
