"""Documents with every odd case, and plain definitions to compare with."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names are used inside the operators.
EXTRA = ("piece", "bucket", "_text", "spans", "value", "id", "key", "h", "n", "rep", "t1", "words", "kept", "source")


def texts():
    """(doc_id, text): nulls, empty, blank, short, repeated and long texts, copies and near copies, shared passages, repeated ids."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = say(120), say(60)
    near = base.split()
    near[60] = "changed"
    far = base.split()
    far[::9] = ["other"] * len(far[::9])
    out = [(10, base), (11, base), (12, " ".join(near)), (13, " ".join(far)), (14, base.upper()), (15, base.replace(" ", "\n", 3))]
    out += [(20 + i, f"{say(40)} {passage} {say(30)}") for i in range(6)]
    out += [(30, None), (31, ""), (32, " \t\n "), (33, "one"), (34, "one"), (35, "two words"), (36, "é ß 漢字 ü 😀"), (37, "a" * 900), (38, "la " * 300), (39, passage)]
    out += [(40, say(4)), (41, say(5)), (42, say(13)), (43, f"{say(3000)} {passage} {say(3000)}"), (44, "x\x00y z"), (45, "line\nline\nline\nother"), (46, say(50)), (46, say(50))]
    out += [(47, out[0][1]), (47, out[0][1]), (None, "no id at all " + say(30)), (None, None), (5, passage + " " + say(20)), (48, say(30) + " " + base)]
    return out


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(d, t, *["x"] * len(EXTRA)) for d, t in rows], schema).repartition(3)


def empty(spark):
    return frame(spark, []).limit(0)


def got(df, *columns):
    """The rows as sorted tuples, nulls first."""
    rows = [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def words(text):
    return WORDS.findall(text or "")
