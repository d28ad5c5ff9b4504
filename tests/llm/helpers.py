"""Small tables, and plain Python readings of what the operators must return."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHING = ["id", "row", "cls", "n", "score", "label", "size", "copies", "root", "held_out", "words", "gap0", "ids", "_hit", "copy", "gone", "again"]


def documents(spark, rows, clashing=False):
    """Rows of (doc_id, text, lang, source); with further columns of clashing names if asked for."""
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    if clashing:
        for c in CLASHING:
            df = df.selectExpr("*", f"'own' AS `{c}`")
    return df


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_documents(rng):
    """Nulls in every column, empty and long texts, repeated rows, ties."""
    a, b = prose(rng, 80), prose(rng, 60)
    return [
        (0, a, "en", "s1"), (1, a, "en", "s2"), (1, a, "en", "s2"), (2, None, None, None), (3, "", "en", "s1"), (4, " \t\n ", "de", None),
        (None, b, "en", "s1"), (None, None, None, None), (5, b, None, "s1"), (6, "one", "en", "s3"), (7, "One", "de", "s3"),
        (8, prose(rng, 60_000, 5000), "en", "s2"), (9, "x" * 300_000, "de", "s2"), (10, "ß é 漢字 🙂   <|endoftext|> it's", "fr", "s1"),
        (11, "line\n" * 50, "en", "s1"), (12, "### $$$ |||", "en", "s4"),
    ]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def near_components(rows):
    """Set size and smallest id of the component of each row, by comparing all rows that share a shingle."""
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for x in s for j in holders[x])
        for j, k in shared.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = [None] * len(rows)
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[i] = (rows[i][0], len(sets[i]), min(ids, default=None))
    return out


def base_measures(text):
    w, seen, dup = WORD.findall(text or ""), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    threes = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(threes)
    covered = {j for i, x in enumerate(threes) if n[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)
