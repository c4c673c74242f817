import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tabsmith.llm import trie
from tabsmith.llm.trie import Heads, end_hashes, prefix_trie, rebuild, running_sums

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, heads=Heads()):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads.lengths
        seqs[c] = own.get(c - (abs(c) % heads.every) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = sorted(c for c in members if len(seqs[c]) == len(p))
        out.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below),
            sum(not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below) for q in below),
            sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def conversations(seed, n=240):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "ho", "é" * 3, None, "", "hi there"])))
    rows += [(300, t, "user", f"t{t % 7}") for t in range(150)] + [(301, 1, "user", "x")] * 9 + [(None, 1, "user", "x"), (-5, 0, "a", "b"), (10**14 + 7, 1, "u", "z")]
    return rows


@pytest.mark.parametrize("seed, heads", [(1, Heads()), (2, Heads(10, 4)), (3, Heads(100, 1))])
def test_matches_plain_trie(spark, seed, heads):
    rows = conversations(seed)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("depth", F.lit("x")).withColumn("seq", F.lit(1))
    got = [tuple(r) for r in prefix_trie(*rebuild(table, heads)).collect()]
    assert sorted(got, key=repr) == brute(rows, heads)


def test_turnless_and_empty(spark):
    c = next(c for c in range(1, 50) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "only")]  # its own turn is lost to a head that is not there
    got = [tuple(r) for r in prefix_trie(*rebuild(spark.createDataFrame(rows, SCHEMA))).collect()]
    assert got == brute(rows) and got[0][:6] == (c, 0, None, 1, 0, 1)
    assert prefix_trie(*rebuild(spark.createDataFrame([], SCHEMA))).collect() == []


def test_running_sums_over_pieces(spark):
    rows = [(g, i, i % 5) for g in (1, 2, None) for i in range(500 if g == 1 else 3)]
    table = spark.createDataFrame(rows, "g int, i int, x long").repartition(4)
    got = running_sums(table.where("g is not null"), "g", [F.col("i")], {"s": F.col("x"), "n": F.lit(1).cast("long")}).collect()
    assert len(got) == 503 and all(r.n == r.i + 1 and r.s == sum(j % 5 for j in range(r.i + 1)) for r in got)


def test_ends_are_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)
    pairs = [(s, c) for s in (1, 2, 7) for c in range(s, 40 * s, s)]
    got = dict(end_hashes(spark.createDataFrame(pairs, "seq long, conv long").repartition(3)).collect())
    assert got == {s: hashlib.sha256(",".join(str(c) for c in range(s, 40 * s, s)).encode()).hexdigest() for s in (1, 2, 7)}
