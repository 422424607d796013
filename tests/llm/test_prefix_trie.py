"""Prefix trie against plain Python, with splitters through shared beginnings and equal conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from beatloom.llm import prefix_trie as P
from beatloom.llm.audit_queries import OP13_SQL, op13_prefix_trie
from tests.compare import connect, differences


def plain(rows):
    """(conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends) of every node."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, key, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    members, last = defaultdict(list), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - int(c - 5 * int(c / 5)), [])[:h] + own[c][h:])
        last[c] = path
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        mine = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below[node] = (sum(below[k][0] for k in children[node]) or 1, mine + sum(below[k][1] for k in children[node]))
    ends = lambda n: hashlib.sha256(",".join(map(str, sorted(c for c in members[n] if last[c] == n))).encode()).hexdigest()
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(children[n]), *below[n], ends(n)) for n, m in members.items()
    )


def got(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def conversations(seed, n, words=3, longest=7):
    rng = random.Random(seed)
    rows = []
    for c in range(-6, n):
        if c % 7 == 3:
            continue
        for k in range(rng.randrange(1, longest)):
            rows.append((c, rng.choice([k, k, k, None, 1]), rng.choice(["user", "bot", None]), rng.choice([None, "", "é", "hello", "yes"][: words + 2])))
    return rows


SCHEMA = "conv_id long, turn int, role string, text string"


@pytest.mark.parametrize("shards,depth", [(1, 64), (6, 64), (40, 2)])
def test_nodes_equal_plain(spark, shards, depth):
    rows = conversations(3, 120) + [(None, 1, "user", "lost")]
    hot = [(c, k, "user", f"same {k}") for c in range(1000, 1060) for k in range(9)]  # one third: equal conversations
    long = [(c, k, "bot", str(k) if k < 70 else f"{c}-{k}") for c in (2000, 2005, 2010) for k in range(150)]
    twice = [(5000, 1, "user", "x")] * 20
    rows += hot + long + twice
    df = spark.createDataFrame([(*r, "other", 1) for r in rows], SCHEMA + ", depth string, n_convs int").repartition(3)
    assert got(P.nodes(df, shards=shards, depth=depth)) == plain(rows)


def test_paths_stay_short_and_shards_split(spark):
    rows = [(c, k, "user", "t" if k < 5 else f"{c}.{k}") for c in (0, 5) for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    turns, sizes = P.rebuilt(P.turns(df))
    cut = {r["conv_id"]: r["cut"] for r in P.cuts(turns, sizes).collect()}
    assert all(v <= 16 for v in cut.values())
    same = spark.createDataFrame([(c, 1, "user", "same") for c in range(3000)], SCHEMA)
    turns, sizes = P.rebuilt(P.turns(same))
    held = P.paths(turns, P.cuts(turns, sizes))
    trie = P.skeleton(held, shards=10)
    dealt = defaultdict(int)
    for r in held.collect():
        dealt[trie.shard(bytes(r["path"]), r["conv_id"])] += 1
    assert max(dealt.values()) < 900


def test_empty_and_turnless(spark):
    assert P.nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(7, 0, None, None)]  # its family's first conversation is absent
    assert got(P.nodes(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


@pytest.mark.parametrize("sf", ["0.001"])
def test_query_equals_sql(spark, sf):
    d = f"/root/testdata/sf{sf}"
    assert differences(spark, connect(d), op13_prefix_trie, OP13_SQL, d) == ""
