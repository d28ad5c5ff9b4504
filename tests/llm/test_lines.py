import random

from concord.llm import lines
from tests.llm import helpers as H

BLANK = " \t\r\x0b\x0c"


def deduped(rows):
    """The rule read plainly; rows that agree in id and text are one document."""
    kinds = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows}, key=lambda k: k[:2])
    seen, gone = {}, {}
    for k in kinds:
        own = [(i, x.strip(BLANK)) for i, x in enumerate(k[2].split("\n")) if x.strip(BLANK)]
        for i in range(max(1, len(own) - 2) if own else 0):
            window = own[i : i + 3]
            if seen.setdefault(tuple(x for _, x in window), (k, i)) != (k, i):
                gone.setdefault(k, set()).update(at for at, _ in window)
    out = []
    for r in rows:
        k = (r[0] is None, r[0] or 0, r[1] or "")
        all_, cut = k[2].split("\n"), gone.get(k, set())
        text = None if r[1] is None else r[1] if not cut else "\n".join(x for i, x in enumerate(all_) if i not in cut)
        out.append((r[0], sum(bool(x.strip(BLANK)) for x in all_), len(cut), text))
    return out


def test_against_plain_reading(spark):
    rng = random.Random(8)
    pool = [H.prose(rng, 6) for _ in range(25)]
    rows = [(i, "\n".join(rng.choice([*pool, "", "  ", H.prose(rng, 3)]) for _ in range(rng.randrange(14))), "en", "s") for i in range(150)]
    block = "\n".join(["first line", "\tsecond line ", "third line", "fourth line"])
    rows += [(500 + i, f"{H.prose(rng, 4)}\n{block}\n{H.prose(rng, 4)}", "en", "s") for i in range(40)]
    rows += [(600, f"{block}\n{block}", "en", "s"), (601, "a\nb", "en", "s"), (602, "a\nb", "en", "s"), (603, "same\n" * 9, "en", "s")]
    assert H.plain(lines.dedup(H.documents(spark, rows)).collect()) == H.plain(deduped(rows))


def test_odd_rows(spark):
    rows = H.odd_documents(random.Random(9))
    got = lines.dedup(H.documents(spark, rows, clashing=True))
    assert H.plain(got.collect()) == H.plain(deduped(rows))
    assert lines.dedup(H.documents(spark, [])).count() == 0
