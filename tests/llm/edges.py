"""Small tables with every awkward case: nulls, empty and very long texts, repeated rows, extra columns, no rows."""

import random

WORDS = "alder birch cedar dogwood elm fir gum hazel ivy juniper kauri larch maple nutmeg oak pine quince rowan spruce teak".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, id string, key string, score double, digest string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "en", "ly"]) for _ in range(n))


def table(spark, texts, first=0, **columns):
    """Rows (id, text) with extra columns whose names the operators use inside."""
    rows = [t if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        [(i, t, columns.get("lang", "en"), columns.get("source", "s"), len(t or ""), 7, "x", "y", 0.5, "z") for i, t in rows], SCHEMA)


def awkward(spark):
    same = prose(1, 80)
    return table(spark, [
        (1, same), (2, None), (3, ""), (4, " \n\t "), (5, prose(2, 30_000)), (6, same), (6, same), (None, prose(3, 60)),
        (7, "x"), (8, "日本語のテキスト 🙂 é"), (9, "\x01\x02 odd \x03"), (10, "word " * 400)])


def nothing(spark):
    return awkward(spark).where("1 = 0")
