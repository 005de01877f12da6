"""Small tables with the awkward rows that every operator has to take, and plain-Python definitions."""

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"

#: columns whose names operators use inside
CLASHES = ("key", "node", "label", "kept", "a", "b", "x", "token", "score", "_score", "_rest", "_items", "_n_words", "_n_hit", "_n_lines", "_n_dropped", "_lines", "words", "lines", "windows", "_host", "sig", "row", "n")


def space_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def alnum_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def corpus(seed=3, n=60):
    """(doc_id, text): prose, exact and near copies, shared lines, blanks, a very long text, nulls."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéñß") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = [line(12) for _ in range(5)]
    rows = []
    for i in range(n):
        rows.append((i, "\n".join(rng.choice(shared) if rng.random() < 0.3 else line(rng.randint(1, 25)) for _ in range(rng.randint(1, 12)))))
    for i in range(n, n + 25):  # near copies of three texts
        words = rows[i % 3][1].split(" ")
        for _ in range(rng.randint(0, max(1, len(words) // 40))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    long = " ".join(rng.choice(vocabulary) for _ in range(40_000))
    rows += [(200, long), (201, long + " more"), (202, rows[0][1]), (202, rows[0][1]), (203, None), (204, ""), (205, " \t\n \r\n"), (206, "One"), (207, "one TWO"), (208, "\n\n" + shared[0] + "\n"), (None, rows[1][1]), (None, None)]
    return rows


def frame(spark, rows, clashes=True, partitions=3):
    """The rows as a table of documents, with columns that clash with the names operators use."""
    extra = ", ".join(f"`{c}` string" for c in CLASHES) if clashes else ""
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (", " + extra if extra else "")
    data = [(i, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t), *(["extra"] * len(CLASHES) if clashes else [])) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, schema).repartition(partitions) if data else spark.createDataFrame([], schema)
