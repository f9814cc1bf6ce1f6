"""Tables with every awkward case, and plain versions of the operators."""

import re
from collections import Counter

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOC)


def awkward(df):
    """Extra columns with the names that the operators use themselves."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit(7) for n in ("piece", "start", "length", "node", "links", "k1", "h1", "tokens", "topic", "_c0", "first", "copy", "TEXT2")})


def groups(pairs, ids):
    """Links counted and components of an undirected graph."""
    n, root = Counter(), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        n[a] += 1
        n[b] += 1
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: (n[i], find(i)) for i in ids}
