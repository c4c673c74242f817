import random
import re

from tabsmith.llm import neardup
from tabsmith.llm.neardup import Rule, near_duplicates


def brute(rows, rule):
    """Components over all pairs."""
    def lower(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        n = rule.words
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rule.den * len(a & b) >= rule.num * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted(((d, len(sets[i]), ids.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed=4):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randint(0, 400))
    rows, n = [], 0
    for size in (1, 2, 3, 40, 5, 1, 1):
        base = [word() for _ in range(rng.randint(40, 120))]
        for _ in range(size):
            copy = [w if rng.random() > 0.02 else word() for w in base]
            rows.append((n, " ".join(copy)))
            n += 1
        chain = list(base)
        for _ in range(4):  # each close to the one before
            chain = [w if rng.random() > 0.02 else word() for w in chain]
            rows.append((n, "\n".join(chain).upper()))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "  \n "), (n + 3, "two words"), (n + 4, "Two  words"), (n + 4, "two words"), (None, "two words"), (None, "alone here"), (n + 5, "q " * 5000)]
    return rows


def answer(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_components_match_all_pairs(docs, monkeypatch):
    rows = corpus()
    for rule in (Rule(3, 85, 100), Rule(5, 80, 100)):
        assert answer(near_duplicates(docs(rows), rule)) == brute(rows, rule)


def test_blocks_of_mixed_buckets_lose_nothing(docs, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rule, rows = Rule(3, 85, 100), corpus(9)
    assert answer(near_duplicates(docs(rows), rule)) == brute(rows, rule)


def test_representatives_and_empty_table(docs):
    rows = corpus()
    got = near_duplicates(docs(rows).withColumnRenamed("lang", "cls"), Rule(3, 85, 100)).toPandas()
    full = got[got.n_shingles > 0]
    stands = full[full.representative].drop_duplicates(["doc_id", "text_key"])
    assert len(stands) == len({(r[2], r[0] if r[2] is None else 0) for r in brute(rows, Rule(3, 85, 100)) if r[1]})
    assert got[got.n_shingles == 0].representative.all()
    assert near_duplicates(docs(rows).limit(0), Rule()).collect() == []
