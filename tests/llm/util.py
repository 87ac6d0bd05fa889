"""Fixtures shared by the operator tests."""

import random

SF = "/root/testdata/sf0.001"


def words(rng, n, alphabet="abcdefgh"):
    return [rng.choice(alphabet) + rng.choice(alphabet) + str(rng.randrange(60)) for _ in range(n)]


def docs_frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def near_groups(seed=1, groups=6, copies=9, n=80):
    """(doc_id, text) with exact copies, near copies at several distances, short, empty and null texts."""
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(groups):
        base = words(rng, rng.randrange(n // 2, n))
        for c in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
            rows.append((i * 7 + 3, (" " if c % 2 else "\n").join(w).upper() if c % 3 == 0 else " ".join(w)))
            i += 1
    rows += [(100_000, None), (100_001, ""), (100_002, " \t\n"), (100_003, "one two"), (100_004, "ONE  two"), (100_005, "one two three"), (100_006, "ünï ÄB"), (100_007, "ünï Äb")]
    rng.shuffle(rows)
    return rows
