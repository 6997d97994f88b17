"""Hard rows for every operator, and plain versions of the contracts."""

import random
import re

WORD = r"[^\x20\x09-\x0D]+"


def words(text, fold=False):
    text = text or ""
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text) if fold else text)


def hard_rows():
    """Nulls, empty texts, copies, near copies, shared passages, repeats inside a text, a long text."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = say(70), say(150)
    near = base.split()
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, base), (7, base), (8, "  " + base.upper() + "\n")]
    for i in range(9, 15):
        edit = list(near)
        edit[rng.randrange(len(edit))] = "zz%d" % i
        rows.append((i, " ".join(edit)))
    rows += [(15, say(40) + " " + passage + " " + say(30)), (16, say(20) + "\n" + passage + "\n" + say(50)), (17, passage), (18, passage + " " + passage)]
    rows += [(19, "ab " * 300), (20, "x" * 900), (21, "x" * 900 + "y"), (22, say(9000)), (23, "日本語 " * 150), (None, say(30)), (None, None), (24, base)]
    rows += [(25, say(25)), (25, say(25)), (26, say(30)), (26, None)]
    return rows


def frame(spark, rows, extra=True):
    """The rows with columns whose names clash with what operators make."""
    full = [(i, t, 0, "h", 1.0, [1], "en", "s", 3) for i, t in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, k1 int, h string, score double, spans array<int>, lang string, source string, n_chars long")
    return df.repartition(3) if extra else df.select("doc_id", "text")
