"""Small inputs with the awkward cases, and plain-Python counterparts."""

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"

LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(30_000))

AWKWARD = [
    (1, None, "en", "a", 0), (2, "", None, None, 0), (3, "   \n\t ", "en", "a", 5),
    (4, "One two three four five six.\nA line of its own here", "en", "b", 50),
    (4, "One two three four five six.\nA line of its own here", "en", "b", 50),
    (None, "Ünïcode wörds ☃ and <s> 12345 \x00 end", "de", None, 30),
    (5, LONG, "en", "a", len(LONG)), (6, "!!! ... ???", "xx", "", 11),
]


def documents(spark, rows=AWKWARD, extra=()):
    """Documents, with constant columns under names that operators use inside."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({c: F.lit(f"own {c}") for c in extra})


def groups_of(pairs, nodes):
    """Smallest node reachable, by brute force."""
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            for x in (a, b):
                if low[x] != m:
                    low[x], changed = m, True
    return low
