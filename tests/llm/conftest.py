import math
import zlib

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, row int, score string, id string"

ENGLISH = "the quick brown fox jumps over the lazy dog and then it runs away from that place with the other ones "
GERMAN = "der schnelle braune Fuchs springt ueber den faulen Hund und laeuft danach nicht mehr von dem Ort weg "


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeats; the extra columns clash with names used inside."""
    rows = []
    for i in range(60):
        base, lang = (ENGLISH, "en") if i % 2 else (GERMAN, "de")
        words = (base * (1 + i % 4)).split()
        words[i % len(words)] = f"word{i // 6}"
        rows.append((i, " ".join(words), lang, f"s{i % 3}" if i % 3 else "s0"))
    rows += [
        (60, None, "en", "s1"),
        (61, "", "de", None),
        (62, " \n\t ", None, "s2"),
        (63, "single", "en", None),
        (64, rows[3][1], "en", "s1"),
        (65, rows[3][1], None, "s1"),
        (65, rows[3][1], None, "s1"),
        (None, rows[4][1], "de", "s2"),
        (None, None, None, None),
        (66, "123 456 !!!   \n\n x", "en", "s0"),
        (67, (ENGLISH + "unusual%d " % 67) * 800, "en", "s2"),
        (68, "  two  spaces <|endoftext|> and more ", "de", "s1"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), "9", 1, "z", "k") for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labelled(spark, odd_rows):
    rows = [(r[0], int(r[0] % 2) if r[0] is not None else 1, 0) for r in odd_rows[:64]] + [(None, 1, 0), (5, None, 0), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def close(a, b, tolerance=1e-9):
    return math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)
