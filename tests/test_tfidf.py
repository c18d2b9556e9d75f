import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sheaf.operators import tfidf
from sheaf.plans import queries


def brute(texts: list[str], size: int) -> list[dict[str, float]]:
    counts = []
    for t in texts:
        w = re.findall(r"\w{2,}", t.lower())
        counts.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    total, df = sum(counts, Counter()), Counter(t for c in counts for t in c)
    top = sorted(total, key=lambda t: (-total[t], t))[:size]
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in top}
    out = []
    for c in counts:
        w = {t: (1 + math.log(c[t])) * idf[t] for t in top if c[t]}
        length = math.sqrt(sum(x * x for x in w.values()))
        out.append({t: x / length for t, x in w.items()})
    return out


@pytest.mark.parametrize("size, most", [(5, 200_000), (60, 200_000), (500, 200_000), (60, 3)])
def test_weights_against_plain_python(spark, monkeypatch, size, most):
    monkeypatch.setattr(tfidf, "MOST_WORDS", most)
    r = random.Random(3)
    texts = [" ".join(r.choices(["Aa", "bb", "cc", "dd", "x", "eé", "f_1", "aa,", "zz\n"], k=r.randint(0, 12))) for _ in range(80)] + ["", "aa aa aa", "solo"]
    frame = spark.createDataFrame(list(enumerate(texts)) + [(len(texts), None)], "id long, text string")
    vocab = tfidf.vocabulary(frame, size)
    want = brute([*texts, ""], size)
    for row in frame.select("id", tfidf.cells(F.col("text"), vocab).alias("cells")).collect():
        got = {vocab[c["idx"]]["term"]: c["weight"] for c in row["cells"]}
        assert got == pytest.approx(want[row["id"]])


def test_terms_of_pages_are_not_shuffled(spark):
    """Pages are, for their places and their neighbours' weights: what is moved is texts and weights of the vocabulary, not all terms."""
    for name in ("tfidf_weights", "tfidf_pair_cosine"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        moved = plan.count("Exchange hashpartitioning")
        assert moved == plan.count("Exchange hashpartitioning(stream_id") <= 2 and "Aggregate" not in plan and "SortMergeJoin" not in plan


def test_page_features_count_each_class_once(spark):
    """A count that two features use is one expression, not one for each."""
    from sheaf.functions import text as T

    frame = spark.createDataFrame([("Ab 1.",), ("",), (None,)], "text string").select(T.page_features(F.col("text")).alias("f"))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{L}") == 2 and plan.count("IsUppercase") == 1  # words and letters
    got = [r["f"] for r in frame.collect()]
    assert got[0] == pytest.approx([math.log(6), 40, 2.5, 0.4, 0.2, 0.5, 0.2, 1]) and got[1] == got[2] == [0.0] * 8
