"""Two lines whose first hash is equal are two lines."""

import random

from pyspark.sql import functions as F

from terralog.llm.line_dedup import line_dedup

FULL, P1, P2, P4, P5 = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def turn(x, n):
    return (x << n | x >> (64 - n)) & FULL


def stir(k):
    return turn(k * P2 & FULL, 31) * P1 & FULL


def unstir(x):
    return turn(x * pow(P1, -1, 1 << 64) & FULL, 33) * pow(P2, -1, 1 << 64) & FULL


def colliding():
    """Two lines of 16 letters and signs with one XXH64 under the seed 42: the second half makes up for the first."""
    rng, signs = random.Random(1), b"abcdefghijklmnopqrstuvwxyz0123456789"
    state = lambda head: (turn((42 + P5 + 16) & FULL ^ stir(int.from_bytes(head, "little")), 27) * P1 + P4) & FULL
    one = b"the first line.."
    want = state(one[:8]) ^ stir(int.from_bytes(one[8:], "little"))
    while True:
        head = bytes(rng.choice(signs) for _ in range(8))
        tail = unstir(want ^ state(head)).to_bytes(8, "little")
        if all(33 <= c < 127 and not 65 <= c <= 90 for c in tail):
            return one.decode(), (head + tail).decode()


def test_lines_that_collide(spark):
    one, two = colliding()
    docs = spark.createDataFrame([(1, one), (2, two), (3, two)], "doc_id long, text string")
    assert docs.select(F.xxhash64("text").alias("h")).distinct().count() == 1
    assert sorted((r["doc_id"], r["n_dropped"]) for r in line_dedup(docs).collect()) == [(1, 0), (2, 0), (3, 1)]
