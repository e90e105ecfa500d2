import random
import re

import numpy as np

from tidemark.llm import quality


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def numpy_verdicts(x):
    """Concentration steps by full sorts from the same two starts."""
    def fit(rows):
        return rows.mean(0), quality.CONSISTENCY * np.cov(rows.T, bias=True) + np.eye(rows.shape[1])

    def dist(m, c):
        z = np.linalg.solve(np.linalg.cholesky(c), (x - m).T)
        return (z * z).sum(0)
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    best = None
    for m, c in [fit(x), (q[1], np.diag(((q[2] - q[0]) / 1.349 + 1) ** 2))]:
        for _ in range(quality.STEPS):
            keep = np.argsort(dist(m, c))[:int(np.ceil(quality.SUPPORT * len(x)))]
            m, c = fit(x[keep])
        if best is None or np.linalg.det(c) < best[0]:
            best = (np.linalg.det(c), dist(m, c))
    return best[1]


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def rows(n=260):
    rnd = random.Random(3)
    out = []
    for i in range(n):
        t = words(rnd, rnd.choice([12, 30, 80, 300]))
        out.append((i, t, "en", "hot" if i % 3 else "b"))
    for i in range(n, n + 20):
        out.append((i, re.sub(r" ", "%%% ", words(rnd, 60)), "en", "hot"))
    line = words(rnd, 6)
    return out + [(900, None, "en", "hot"), (901, "", None, None), (902, " \n\t", "en", None),
                  (903, "\n".join([line] * 30), "en", "hot"), (904, words(rnd, 30_000), "en", "hot"),
                  (905, words(rnd, 40) + "\n" + line + "\n" + line, "fr", "rare"),
                  (905, words(rnd, 40), "fr", "rare"), (None, words(rnd, 20), None, None),
                  (907, "été ñandú " * 3 + words(rnd, 60), "es", "x")]


def test_statistics_and_verdicts_equal_brute_force(spark, corpus):
    data = rows()
    df = corpus(data).withColumnRenamed("n_chars", "kept")        # a clashing extra column
    got = quality.judge(df).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)      # noqa: E731
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                    r.base_failed) for r in got), key=key) == sorted(
        ((d, *plain(t)) for d, t, *_ in data), key=key)
    verdict = {r.doc_id: r.kept for r in got}
    assert all(verdict[i] for i in range(260)) and verdict[904]
    assert not any(verdict[i] for i in [*range(260, 280), 900, 901, 902, 903])


def test_distances_follow_the_exact_steps(spark, corpus):
    got = quality.judge(corpus([r for r in rows() if r[2] == "en" and r[3] == "hot"]))
    ok = [r for r in got.collect() if not r.base_failed]
    chars = sorted(r.word_chars / r.n_words for r in ok)
    centre = np.floor(chars[int(np.ceil(0.5 * len(chars))) - 1] * 32) / 32
    x = np.array([[(r.word_chars / r.n_words - centre) / np.sqrt(0.02 + 1 / r.n_words) / 2.0,
                   np.sqrt(r.n_symbols / (r.word_chars + 50)) / 0.03,
                   np.sqrt(r.n_dup_lines / (r.n_lines + 5)) / 0.12,
                   np.sqrt(r.n_repeat_words / (r.n_words + 50)) / 0.12] for r in ok])
    want = numpy_verdicts(np.round(x * 64) / 64)
    have = np.array([r.distance for r in ok])
    assert ((have > quality.CUTOFF) == (want > quality.CUTOFF)).all()
    np.testing.assert_allclose(have, want, rtol=0.1, atol=0.3)


def test_small_groups_share_an_estimate_and_tiny_ones_pass(spark, corpus):
    rnd = random.Random(1)
    few = [(i, words(rnd, 40), "de", f"s{i}") for i in range(60)] + [(99, re.sub(" ", "%%% ", words(rnd, 15)), "fr", "z")]
    few.append((60, re.sub(" ", "### ", words(rnd, 50)), "de", "s60"))
    kept = {r.doc_id: r.kept for r in quality.judge(corpus(few)).collect()}
    assert not kept[60] and kept[99] and all(kept[i] for i in range(60))


def test_empty_table(spark, corpus):
    assert quality.judge(corpus([])).count() == 0
