"""The language model against counts in plain dictionaries."""

import math
from collections import Counter, defaultdict

import pytest

from tabwright.llm import ngram_lm as L
from tabwright.llm.words import words_of


def reference(texts):
    """(probability of a word behind another, add-one score of a text's words) of a bigram model."""
    train = [[*words_of(t), L.END] for t in texts]
    count = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip([L.START, *t], t))
    total, followers, before = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (u, w), n in pairs.items():
        total[u] += n
        followers[u][min(n, 3) - 1] += 1
        before[w] += 1
    off = L.discounts([Counter(pairs.values())[i] for i in (1, 2, 3, 4)])
    kinds = Counter(before.values())
    low_off, low = L.discounts([kinds[i] for i in (1, 2, 3, 4)]), (kinds[1], kinds[2], sum(v for k, v in kinds.items() if k > 2))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))

    def p(u, w):
        n, k = pairs[u, w], before[w]
        base = (k - low_off[min(k, 3) - 1] if k else 0) / len(pairs) + dot(low_off, low) / len(pairs) / (len(count) + 1)
        return (n - off[min(n, 3) - 1] if n else 0) / total[u] + dot(off, followers[u]) / total[u] * base if total[u] else base

    return p, count


TEXTS = ["a b a b c", "a b d", "the A b\tc", "", None, "e", "a b a b a b a b", "c c c c d d"]


@pytest.mark.parametrize("bucket_tokens", [2, L.BUCKET_TOKENS])
def test_scores(spark, bucket_tokens):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    model = L.train(docs.where("doc_id < 6"), bucket_tokens=bucket_tokens)
    p, count = reference(TEXTS[:6])
    assert (model.tokens, model.types) == (sum(count.values()), len(count))
    assert abs(sum(p(b"a", w) for w in count) + p(b"a", b"never\n") - 1) < 1e-12
    for r in L.score(docs, model).collect():
        own = [*words_of(TEXTS[r.doc_id]), L.END]
        want = sum(math.log10(p(u, w)) for u, w in zip([L.START, *own], own))
        base = sum(math.log10((count[w] + 1) / (model.tokens + model.types + 1)) for w in own)
        assert (r.n_tokens, r.n_known) == (len(own), sum(w in count for w in own))
        assert math.isclose(r.score, want, rel_tol=1e-12) and math.isclose(r.base_score, base, rel_tol=1e-12)
        assert math.isclose(r.perplexity, 10 ** (-want / len(own)), rel_tol=1e-9)


def test_odd_rows(odd, none):
    model = L.train(odd)
    got = L.score(odd, model, ("doc_id", "lang")).collect()
    assert len(got) == odd.count() and all(r.score < 0 and r.n_known == r.n_tokens for r in got)
    assert L.score(none, model).count() == 0
    untaught = L.score(odd, L.train(none)).collect()
    assert len(untaught) == odd.count() and all(r.score == 0 and r.n_known == 0 for r in untaught)


def test_real_texts_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("out", L.held_out())
    model = L.train(docs.where("NOT out"))
    got = L.score(docs, model, ("out",)).where("out").selectExpr("sum(score) / sum(base_score) AS ratio").first()
    assert got.ratio < 0.95
