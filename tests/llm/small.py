"""Small tables that the tests share: nulls, empty texts, ties, repeated rows and clashing columns."""

import numpy as np

WORDS = "alpha beta gamma delta you idiot epsilon zeta eta theta Iota kappa lambda mu nu xi omicron pi rho sigma".split()
SCHEMA = "doc_id long, text string, lang string, source string, score double, n int, fp long, length int"


def corpus(n=120, seed=5):
    """Texts of all sizes, copies, near copies, nulls, odd characters and one row twice."""
    rng = np.random.default_rng(seed)
    texts = [" ".join(rng.choice(WORDS, int(k))) for k in rng.integers(1, 120, n)]
    texts += [texts[0], texts[1], texts[2] + " end", "", None, "  \n\t ", "Ünï\xa0codé   x", "<|endoftext|> y", "日本語 text 12 's", " a", "a  b\n\n c\n", "long " * 9000, "\U0001df1f new"]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "a", "b", "hot", "hot"][i % 5], 0.5, i, i, i) for i, t in enumerate(texts)]
    return rows + [rows[3]]


def closed(n, linked, names):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    lowest = {}
    for i in range(n):
        lowest[label[i]] = min(lowest.get(label[i], names[i]), names[i])
    return [lowest[label[i]] for i in range(n)]
