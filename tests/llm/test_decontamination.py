"""Benchmark passages against a look at every window."""

import random
import re

import pytest

from tabwright.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    own, hit, found = words(text), set(), set()
    for name, item in items:
        item = words(item)
        n = min(window, len(item))
        windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        for i in range(len(own) - n + 1):
            if n and tuple(own[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add("" if name is None else str(name))
    return len(own), len(hit), sorted(found)


def spread(spans):
    return {i for s in spans for i in range(s.first, s.end)}


@pytest.mark.parametrize("small_rows, hot_share", [(0, 8), (0, D.HOT_SHARE), (D.SMALL_ROWS, D.HOT_SHARE)])
def test_all_windows_by_chance(spark, monkeypatch, small_rows, hot_share):
    monkeypatch.setattr(D, "HOT_SHARE", hot_share)
    pick = random.Random(small_rows + hot_share)
    text = lambda n, v: " ".join(pick.choice("abcdefgh"[:v]) + pick.choice(["", ",", ".\n"]) for _ in range(n))
    items = [(k, text(n, v)) for k, (n, v) in enumerate([(3, 4), (9, 2), (10, 2), (11, 3), (25, 2), (60, 3), (1, 8), (4, 3), (30, 1)])]
    items += [(None, text(12, 2)), (20, None), (21, "..."), (22, items[4][1])]
    docs = [(i, text(pick.randint(0, 60), pick.choice([2, 3]))) for i in range(60)]
    docs += [(100 + i, text(7, 8) + " " + items[i][1] + " " + text(7, 8)) for i in range(6)] + [(200, None), (201, "")]
    found = D.find_passages(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), small_rows=small_rows
    ).collect()
    for r in found:
        n, hits, names = brute(dict(docs)[r.doc_id], items, 10)
        assert (r.n_words, r.n_hit, r.item_ids) == (n, hits, names), r.doc_id
        assert len(spread(r.spans)) == r.n_hit


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs far"), (2, None)], "item_id long, text string")
    got = D.find_passages(odd, items, ("doc_id", "lang")).collect()
    assert sorted(r.n_hit for r in got if r.n_hit) == [22] * 6
    assert D.find_passages(none, items).count() == 0
    assert {r.n_hit for r in D.find_passages(odd, items.where("1 = 0")).collect()} == {0}


def test_every_shared_window_shares_a_fingerprint():
    import numpy as np

    pick = np.random.default_rng(2)
    shared = pick.integers(0, 2**63, 10).astype(np.uint64)
    for _ in range(50):
        a, b = (np.concatenate([pick.integers(0, 2**63, k).astype(np.uint64), shared, pick.integers(0, 2**63, 5).astype(np.uint64)]) for k in pick.integers(0, 9, 2))
        kept = [{int(D.grams(x, 5)[i]) for i in D.winnowed(x, np.full(len(x), len(x)), 10, 5)} for x in (a, b)]
        assert kept[0] & kept[1]


def test_bits_hold_every_print(spark):
    import numpy as np

    pick = np.random.default_rng(3)
    prints = pick.integers(-(2**63), 2**63 - 1, 3_000)
    bits = D.bit_table(spark.createDataFrame([(int(x),) for x in prints], "print long"), 3_000)
    size = 8 * len(bits)
    place = prints.view(np.uint64) >> np.uint64(64 - size.bit_length() + 1)
    wanted = np.zeros(size, bool)
    wanted[place.astype(np.int64)] = True
    assert (np.unpackbits(bits, bitorder="little").astype(bool) == wanted).all()
