"""Small tables and brute-force versions for the training-data operators."""

import random
import re

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall((text or "").encode())


def docs(spark, rows, extra=""):
    """rows: (doc_id, text, source) or (doc_id, text)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SHAPE).repartition(3)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


def edge_rows():
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    long = "\n".join(prose(rng, 50) for _ in range(400))
    same = prose(rng, 60)
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n\x0b\x0c\r ", "b"), (4, long, "b"), (5, same, "a"), (6, same, "b"), (6, same, "b"), (6, same, "b"),
        (None, same, "c"), (7, same, None), (None, None, None), (8, "one", "a"), (9, "ONE two", "c"), (10, "é ß 😀 #*$ \x00 end", "c"), (11, prose(rng, 300), "c"),
    ]


CLASHING = ("fp", "h", "g", "key", "row", "size", "shard", "part", "n", "held", "own", "bucket", "component", "a", "b", "label", "u", "v", "up", "p", "id", "copies", "quality", "going")


def edge_docs(spark):
    """The edge rows with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    extra = {c: F.lit(f"extra {c}") for c in CLASHING} | {"a.b c": F.lit(1), "m": F.create_map(F.lit("k"), F.lit(None).cast("string"))}
    return docs(spark, edge_rows()).withColumns(extra)


def empty_docs(spark):
    return spark.createDataFrame([], SHAPE)


def repeat_words(w):
    """Words inside five-word windows that occur more than once."""
    from collections import Counter

    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return len({i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)})


def quality_votes(text):
    """The nine rules, one text at a time; in the order of quality.RULES."""
    text = text or ""
    w = [x.decode() for x in words(text)]
    n, chars = len(w), sum(map(len, w))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    twice = len(lines) - len(set(lines))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    ends = sum(c in "#*$%&|<>" and (i + 1 == len(text) or text[i + 1] in " \t\n\x0b\x0c\r") for i, c in enumerate(text))
    marks, inside = 0, False
    for c in text:
        other = not c.isalpha() and c not in " \t\n\x0b\x0c\r"
        marks += other and not inside
        inside = other
    repeated, shouted, different = repeat_words(w), sum(x == x.upper() != x.lower() for x in w), len(set(w))

    def vote(bad, good):
        return -1 if bad else 1 if good else 0

    return (
        vote(n < 10, n >= 40), vote(symbols > 0.1 * n, n and symbols <= 0.02 * n), vote(ends > 0.05 * n, n and ends <= 0.01 * n), vote(marks > 0.4 * n, n and marks <= 0.25 * n),
        vote(twice > 2 and twice > 0.25 * len(lines), twice == 0 and len(lines) > 2), vote(repeated > 0.2 * n, n >= 20 and repeated <= 0.05 * n), vote(shouted > 0.5 * n, n and shouted <= 0.2 * n),
        vote(different < 0.2 * n, n >= 20 and different >= 0.4 * n), vote(chars > 14 * n or chars < 2.5 * n, n and 3 * n <= chars <= 10 * n),
    )


def quality_verdicts(texts):
    """Whether each text is kept: base filter, votes one by one, a mixture fitted to them."""
    from collections import Counter

    import numpy as np
    from tidemark.llm import quality

    votes = [quality_votes(t) for t in texts]
    model = quality.fit(sorted(Counter(votes).items()))["model"]
    good = model.posterior(np.array(votes, float))[0][:, model.good]
    out = []
    for t, p in zip(texts, good):
        w = words(t)
        out.append(len(w) >= 10 and 100 * repeat_words(w) <= 20 * len(w) and p >= 0.5)
    return out
