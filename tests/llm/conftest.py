import random

import pytest

HARD = [None, "", " \n\t ", "a", " ", "12 34", "ab cd", "word " * 3000, "x" * 5000, "É漢字 \U0001F600 ends", "▁▁ x", "<|endoftext|> and <s>"]


def prose(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choices(["ta", "ri", "mo", "ne", "su", "lek", "por"], k=r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Hard texts, prose, exact and near copies, shared passages; a null and a repeated doc_id; clashing columns."""
    r = random.Random(5)
    base = [prose(r, r.randint(30, 220)) for _ in range(40)]
    passage = prose(r, 70)
    texts = HARD + base + base[:6] + [base[7]] * 5
    for k in range(12):  # near copies of one text
        words = base[8].split()
        words[r.randrange(len(words))] = f"changed{k}"
        texts.append(" ".join(words))
    texts += [f"{prose(r, 20)} {passage} {prose(r, 20 + k)}" for k in range(8)]
    texts += ["abc " * 120 + prose(r, 60), "q" * 700, prose(r, 3) + "\n" + "same line here\n" * 9]
    order = list(range(len(texts)))
    r.shuffle(order)
    rows = [(order[i], t, ["en", "xx", None][i % 3], None if i % 4 == 0 else "src0", len(t or ""), i, "h") for i, t in enumerate(texts)]
    rows.append(rows[20])
    rows.append((None, "no id here", "en", "s", 10, 0, "h"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, h string").repartition(3)


@pytest.fixture(scope="session")
def texts(corpus):
    return {r.doc_id: r.text or "" for r in corpus.collect() if r.doc_id is not None}
