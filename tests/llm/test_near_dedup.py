"""Near-duplicate classes against all pairs."""

import random

import numpy as np
import pytest

from tabwright.llm import near_dedup as N
from tabwright.llm.components import components
from tabwright.llm.words import words_of


def brute(rows, percent):
    """doc_id -> (set size, smallest doc_id reachable), and the number of components, by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = words_of(text)
        sets.append(frozenset(zip(*[words[i:] for i in range(5)])) if len(words) >= 5 else frozenset([tuple(words)] if words else []))
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                group[max(find(a), find(b))] = min(find(a), find(b))
    members = {}
    for i, (doc, _) in enumerate(rows):
        members.setdefault(find(i), []).append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        out.append((doc, len(sets[i]), min((d for d in members[find(i)] if d is not None), default=None)))
    return out, len(members)


def edited(words, pick, share):
    return " ".join(pick.choice(words) if pick.random() < share else w for w in words)


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_of_edited_copies(spark, percent):
    pick = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for n in (6, 7, 8, 30, 120, 300):
        original = [pick.choice(vocabulary) for _ in range(n)]
        rows += [" ".join(original)] + [edited(original, pick, share) for share in (0.005, 0.01, 0.02, 0.03, 0.05) for _ in range(6)]
    pick.shuffle(rows)
    rows = list(enumerate(rows))
    want, groups = brute(rows, percent)
    got = N.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)
    assert sum(r.kept for r in got) == groups and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_pairs_among_texts_on_one_template(spark):
    """Buckets of hundreds of texts that are no copies of each other, and two pairs that are."""
    pick = random.Random(5)
    own = lambda n: [f"o{pick.randrange(10**9)}" for _ in range(n)]
    template = [f"t{i}" for i in range(454)]
    tails = [own(50) for _ in range(300)]
    for i in (50, 150):
        tails[i + 1] = tails[i][:20] + own(30)
    rows = [(i, " ".join(template + tail)) for i, tail in enumerate(tails)]
    want, groups = brute(rows, 85)
    assert groups == 298
    got = N.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 85, bands=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)


def test_odd_rows(odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    want, _ = brute(rows, 80)
    got = N.near_groups(odd).collect()
    none_first = lambda t: tuple((x is not None, x or 0) for x in t)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=none_first) == sorted(
        ((d, n, d if not n else c) for d, n, c in want), key=none_first
    )
    assert all(r.kept for r in got if r.n_shingles == 0)
    kept = N.drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got) and sum(r.kept for r in got if r.doc_id == 2) < 2
    assert N.near_groups(none).count() == 0 and N.drop_near_copies(none).count() == 0


def test_densified_bins_agree_as_sets_do():
    sign, pick = N.OnePermutation(64, 1), np.random.default_rng(1)
    agree = []
    for _ in range(200):
        pool = np.unique(pick.integers(0, 2**64, 12, dtype=np.uint64))
        agree.append((sign.signature(pool[:-1]) == sign.signature(pool[1:])).mean())
    assert abs(np.mean(agree) - 10 / 12) < 0.03


def test_components_of_a_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def left_files(spark):
    from pathlib import Path

    from tabwright.functions.sizing import shared_dir

    return {p.name for p in Path(shared_dir(spark)).iterdir() if not p.name.startswith(("rdd-",)) and "-" in p.name}


def test_rounds_leave_only_the_result(spark):
    pick = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    original = [pick.choice(words) for _ in range(100)]
    rows = [(i, edited(original, pick, 0.03)) for i in range(300)]
    before = left_files(spark)
    got = N.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert [n.rsplit("-", 1)[0] for n in left_files(spark) - before] == ["result"]
    want, _ = brute(rows, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)


@pytest.mark.parametrize("kind", ["exact", "near"])
def test_rows_do_not_depend_on_the_split(spark, tmp_path, kind):
    """The input is split otherwise when the result is read than when the groups were found."""
    from tabwright.llm import exact_dedup

    rows = [(i if i % 7 else None, f"text number {i % 50} that has more than five words in it", f"x{i}", "y") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, more string, `odd``name` string").repartition(40).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    drop = exact_dedup.drop_copies if kind == "exact" else N.drop_near_copies
    usual = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        out = drop(docs)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = out.collect()
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
    by_text = {}
    for i, t, *_ in rows:
        by_text.setdefault(t, []).append(i)
    best = max if kind == "exact" else min
    want = {t: best(i for i in ids if i is not None) for t, ids in by_text.items()}
    assert len(got) == 50 and {r.text: r.doc_id for r in got} == want and out.columns == docs.columns
