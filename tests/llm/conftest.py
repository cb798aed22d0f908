import random

import pytest

EDGES = [(900, None), (901, ""), (902, " \n\t"), (903, "12 34 ."), (904, "a"), (905, "é"), (906, "x" * 5000)]


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with copies, near copies, shared passages, repeated lines, ties, nulls, a repeated row, a null id, extra
    columns whose names clash with those the operators use inside."""
    rnd = random.Random(11)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "su", "te", "ro", "vi") for b in ("na", "re", "do", "pa", "qu", "ze", "fi")]
    lines = [" ".join(rnd.choice(words) for _ in range(rnd.choice((1, 2, 3, 4, 6, 9, 15, 30)))) for _ in range(60)]
    passage = " ".join(rnd.choice(words) for _ in range(50))
    rows = []
    for k in range(70):
        text = [list(rnd.choice(lines).split()) if rnd.random() < 0.5 else [rnd.choice(words) for _ in range(rnd.randrange(1, 40))] for _ in range(rnd.randrange(1, 6))]
        if rnd.random() < 0.3:
            text.insert(rnd.randrange(len(text) + 1), passage.split())
        rows.append((k, "\n".join(" ".join(x) for x in text)))
    for k in range(40):
        w = list(rows[rnd.randrange(8)][1].split(" "))
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w))] = rnd.choice(("edit", "other", w[0]))
        rows.append((100 + k, " ".join(w)))
    rows += [*EDGES, rows[3], (None, rows[4][1]), (None, None)]
    rows = [(i, t, rnd.choice(("en", "fr", None)), rnd.choice(("s1", "s2", "s3", None)), 7, "clash") for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id int, th string").repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
