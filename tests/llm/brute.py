"""Plain versions of what the operators compute, and tables with every awkward case."""

import re

_UPPER = {c: c + 32 for c in range(65, 91)}
#: Columns whose names the operators use inside.
CLASH = "id long, n int, h long, token long, rep long, component long, row long, tokens string, label_ int"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(_UPPER))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def classes(nodes, links):
    """The least node that links reach."""
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def jaccard_links(sets, num, den):
    keys = sorted(sets)
    out = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                out.add((a, b))
    return out


def documents(spark, rows, clash=True):
    """A documents table of (doc_id, text), with columns that clash."""
    extra = CLASH if clash else "n int"
    width = extra.count(",") + 1
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    full = [(i, t, "en", "src", len(t or ""), *[None] * width) for i, t in rows]
    return spark.createDataFrame(full, schema)
