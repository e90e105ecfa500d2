import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import tries


def brute(rows):
    """The contract, with every prefix held as a tuple."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + ts[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
        ends[tuple(paths[c])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += children[node] == 0
        saved[node] += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        if node:
            children[node[:-1]] += 1
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return sorted((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in members.items())


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def made(spark, rows):
    return sorted(tuple(r) for r in tries.trie(table(spark, rows)).collect())


def conversations(seed, n=60, letters="ab", longest=12):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.15:
            continue
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant", None]) if t % 3 == 0 else "user", rng.choice(letters)))
    return rows


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, ["é", "", None, "b"]), (3, "a")])
def test_against_brute_force(spark, seed, letters):
    rows = conversations(seed, letters=letters)
    rows += [(c, t, "user", "a") for c in range(100, 140) for t in range(7)]              # a third are copies
    assert made(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", [4, 5])
def test_many_shards_and_small_queues(spark, monkeypatch, seed):
    monkeypatch.setattr(tries, "SHARD_NODES", 7)
    monkeypatch.setattr(tries, "QUEUE_ITEMS", 3)
    monkeypatch.setattr(tries, "CHUNK_CHARS", 5)
    rows = conversations(seed, n=45, letters="ab")
    rows += [(c, t, "user", "a") for c in range(60, 75) for t in range(c - 59)]           # a comb: every prefix ends
    assert made(spark, rows) == brute(rows)


def test_one_conversation_holds_most_turns(spark, monkeypatch):
    monkeypatch.setattr(tries, "SHARD_NODES", 150)
    rows = [(3, t, "user", str(t % 7)) for t in range(700)] + [(0, t, "user", str(t % 7)) for t in range(350)]
    rows += [(c, t, "user", str(t % 7)) for c in (1, 2, 9) for t in range(20)]
    assert made(spark, rows) == brute(rows)


def test_nulls_ids_and_empty_tables(spark):
    assert made(spark, []) == [] and made(spark, [(None, 1, "user", "x")]) == []
    rows = [(-7, 0, None, "x"), (-5, None, "user", "y"), (-5, 3, "user", None), (None, 0, "a", "b"),
            (12, 1, "us", "erx"), (13, 1, "user", "x"), (9223372036854775800, 0, "user", "long")]
    assert made(spark, rows) == brute(rows)


def test_turns_of_one_number_and_extra_columns(spark):
    rows = [(1, 0, "user", "same"), (1, 0, "user", "same"), (2, 0, "user", "same"), (2, 1, "user", "same")]
    wide = spark.createDataFrame([(*r, "k", 3) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int")
    assert sorted(tuple(r) for r in tries.trie(wide).collect()) == brute(rows)


def test_queue_spills_and_keeps_order():
    rng = random.Random(2)
    q, given = tries.SpillingQueue(10), []
    for k in range(300):
        m = (rng.randrange(-50, 0), f"{rng.randrange(99):024d}", 1, k, rng.randrange(2 ** 60))
        q.push(m)
        given.append(m)
    assert q.spilled > 10 and list(q.missed(float("inf"), "")) == sorted(given) and q.peek() is None


def test_keys():
    a = tries.written(4, "0" * 15 + "7") + tries.written(6, tries.LAST)
    assert tries.above(a) == tries.written(4, "0" * 15 + "7") + tries.written(5, tries.LAST)
    assert tries.above(tries.above(a)) == tries.written(4, tries.LAST) and tries.above(tries.written(0, tries.LAST)) is None
    assert tries.meeting(a, tries.written(2, "0" * 15 + "9") + tries.written(9, tries.LAST)) == tries.written(2, tries.LAST)
    assert a < tries.above(a) < tries.above(tries.above(a))
