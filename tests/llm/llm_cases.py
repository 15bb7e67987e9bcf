"""Documents with every difficulty at once, and plain definitions to hold results against."""

import random
import re

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, copy long, pos long, token long, node long, rank long, kept string, hits string, bucket int"


def frame(spark, rows):
    """Documents of (doc_id, text, source), with further columns that clash with inner names."""
    full = [(i, t, "en", s, len(t or ""), 1, 2, 3, 4, 5, 6, "kept", "hits", 7) for i, t, s in rows]
    return spark.createDataFrame(full, COLUMNS)


def hard_rows(seed=1, n=60):
    """Nulls, empty and blank texts, a long text, copies, near copies, repeated rows and ids."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Éa", "ça", "日本", "A.b"]
    passage = " ".join(r.choice(vocab) for _ in range(9))
    rows = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randrange(0, 40))]
        text = " ".join(words)
        if i % 4 == 1:
            text += "\n" + passage + "\r\n " + passage
        if i % 7 == 3 and rows:
            text = rows[r.randrange(len(rows))][1]
        if i % 9 == 5 and rows:
            other = (rows[r.randrange(len(rows))][1] or "").split(" ")
            text = " ".join(other[:-1] + ["changed"])
        rows.append((i * 3 % 101, text, r.choice(["a", "b", "c", None])))
    rows += [(200, None, "a"), (201, "", None), (202, " \t\n ", "b"), (203, "one", "a"), (204, "one", "b")]
    rows += [(None, rows[1][1], "c"), (None, None, None), rows[2], rows[2], (rows[3][0], "another text under a used id", "a")]
    rows.append((205, " ".join(r.choice(vocab) for _ in range(9000)), "c"))
    r.shuffle(rows)
    return rows


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
