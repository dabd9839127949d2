from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tessera.llm import quality
from tessera.llm.common import table
from tessera.llm.textscan import chunks

from .brute import docs_frame, sentence


def test_accuracy_against_labels(spark):
    d = "/root/testdata/sf0.1"
    got = quality.classify(table(spark, d, "documents")).join(table(spark, d, "labels"), "doc_id").collect()
    good, bad = [r for r in got if r["quality"]], [r for r in got if not r["quality"]]
    assert np.mean([r["keep"] for r in good]) > 0.97
    assert np.mean([not r["keep"] for r in bad]) > 0.7


def test_scores_against_plain_python():
    """The scorer against a loop over trigrams, and the votes' posterior against the table."""
    rng = np.random.default_rng(1)
    model = quality.Model({}, rng.standard_normal(quality.BUCKETS).astype(np.float32), 0.2)
    texts = ["", "ab", "A plain text. With marks!", "é" * 50, "x " * 400]
    weak, score = model.rate(pa.array(texts))
    assert list(weak) == [0.5] * len(texts)
    for text, s in zip(texts, score, strict=True):
        raw = text.encode()
        at = [(((raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) * 2654435761) % 2**32) >> 16 for i in range(len(raw) - 2)]
        _, _, offs, data = next(chunks(pa.array([text]), 1))
        z = model.bias + (np.mean([float(model.weights[a]) for a in at]) * np.sqrt(50) if at else 0) + float(model.weights[quality._shape(quality.measures(offs, data))].sum())
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-4


def test_expectation_maximisation_finds_the_bad():
    """Documents drawn from a known model: the posterior separates them."""
    rng = np.random.default_rng(3)
    counts: dict[int, int] = {}
    truth: dict[int, list[int]] = {}
    for _ in range(20000):
        bad = rng.random() < 0.1
        kind = rng.integers(0, 8)
        v = np.where(rng.random(8) < 0.3, 0, 1)
        if bad:
            v[kind] = -1 if rng.random() < 0.9 else 0
        elif rng.random() < 0.01:
            v[rng.integers(0, 8)] = -1
        p = int(quality.pattern(v[None])[0])
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, [0, 0])[int(bad)] += 1
    posterior = quality.estimate(counts)
    right = sum(n[int(posterior[p] < 0.5)] for p, n in truth.items())
    assert right / 20000 > 0.97


def plain_measures(text):
    """Each measure, by loops over letters and words."""
    lower = "".join(c.lower() if c.isascii() else c for c in text)
    words = re.findall(r"(?:[0-9a-z]|[^\x00-\x7f\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\u2000-\u206f])+", lower)
    n, k = len(words), max(1, len(words))
    if not n:
        return [0.0] * 9
    lead = [c for c in text if c.isascii() and c.isalnum() or not c.isascii() and not ("\x80" <= c <= "\xbf" and c not in "ªµº") and not "\u2000" <= c <= "\u206f"]
    upper = [c for c in text if "A" <= c <= "Z" or "À" <= c <= "Þ"]
    runs = [words[i : i + 256] for i in range(0, n, 256)]
    return [
        sum(c in "#$%&*@^~<>{}[]\\=+_" for c in text) / k, len(upper) / max(1, len(lead)), sum(c in "!?" for c in text) / k, sum(c in "|\t" for c in text) / k,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / k, sum(len(set(r)) for r in runs) / k, sum(c in ".!?:;" for c in text) / k, len(lead) / k, n,
    ]


def plain_votes(m):
    symbols, shouting, marks, pipes, stutter, variety, stops, length, n = m
    some, many = n > 0, n >= 20

    def vote(good, bad):
        return -1 if bad else 1 if good else 0

    return [
        vote(some and symbols < 0.05, symbols > 0.2), vote(some and shouting < 0.2, many and shouting > 0.6), vote(some and marks < 0.1, marks > 0.4), vote(some and pipes < 0.02, pipes > 0.2),
        vote(many and stutter < 0.05, n >= 4 and stutter > 0.3), vote(many and variety > 0.35, many and variety < 0.15),
        vote(many and 0.02 < stops < 0.3, many and (stops < 0.004 or stops > 0.7)), vote(many and 2.5 < length < 9, n > 0 and (length > 20 or many and length < 1.5)),
    ]


def plain_estimate(counts, rounds=200):
    """Expectation-maximisation, one pattern and class after the other."""
    keys = sorted(counts)
    v = {k: [(k // 3**j) % 3 - 1 for j in range(8)] for k in keys}
    p = {}
    for k in keys:
        bad = [x == -1 for x in v[k]]
        row = [0.05 if any(bad) else 0.95 if 1 in v[k] else 0.5] + [1e-3 + b / max(1, sum(bad)) for b in bad]
        p[k] = [x / sum(row) for x in row]
    total = sum(counts.values())
    for _ in range(rounds):
        mass = [sum(counts[k] * p[k][c] for k in keys) for c in range(9)]
        no = [[0.0] * 8 for _ in range(9)]
        for c in range(9):
            for j in range(8):
                bad = sum(counts[k] * p[k][c] for k in keys if v[k][j] == -1)
                voted = sum(counts[k] * p[k][c] for k in keys if v[k][j] != 0)
                no[c][j] = (bad + 0.5) / (voted + 1)
                no[c][j] = min(no[c][j], quality.FALSE_ALARMS) if c == 0 else no[c][j]
        moved = 0.0
        for k in keys:
            odds = [math.log((mass[c] + 1e-3) / total) + sum(math.log(no[c][j]) if v[k][j] == -1 else math.log(1 - no[c][j]) for j in range(8) if v[k][j]) for c in range(9)]
            e = [math.exp(o - max(odds)) for o in odds]
            new = [x / sum(e) for x in e]
            moved = max(moved, *(abs(a - b) for a, b in zip(new, p[k], strict=True)))
            p[k] = new
        if moved < 1e-9:
            break
    return {k: p[k][0] for k in keys}


def plain_fit(texts, target, rounds=120):
    """The scorer by AdaGrad over dictionaries of features."""
    features = []
    for text in texts:
        raw, f = text.encode(), {}
        at = [(((raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) * 2654435761) % 2**32) >> 16 for i in range(len(raw) - 2)]
        for a in at:
            f[a] = f.get(a, 0) + math.sqrt(50) / len(at)
        m = plain_measures(text)
        for j, x in enumerate(m):
            k = min(15, int(math.log2(x + 1))) if j == 8 else sum(s < x for s in quality._STEPS)
            a = ((((k + 1) * 40503 + j * 7919) * 2654435761) % 2**32) >> 16
            f[a] = f.get(a, 0) + 1.0
        features.append(f)
    n, share = len(texts), min(max(np.mean(target), 1e-3), 1 - 1e-3)
    each = [0.5 / share if t >= 0.5 else 0.5 / (1 - share) for t in target]
    used = sorted({a for f in features for a in f})
    w, b, seen, seen_b = dict.fromkeys(used, 0.0), 0.0, dict.fromkeys(used, 1e-6), 1e-6
    for _ in range(rounds):
        error = [e * (1 / (1 + math.exp(-(sum(x * w[a] for a, x in f.items()) + b))) - t) / n for f, t, e in zip(features, target, each, strict=True)]
        g = {a: 1e-5 * w[a] for a in used}
        for f, e in zip(features, error, strict=True):
            for a, x in f.items():
                g[a] += x * e
        for a in used:
            seen[a] += g[a] ** 2
            w[a] -= 0.5 * g[a] / math.sqrt(seen[a])
        seen_b += sum(error) ** 2
        b -= 0.5 * sum(error) / math.sqrt(seen_b)
    return features, w, b


def test_the_query_against_a_brute_force_version(spark, tmp_path):
    """Measures, votes, counts of patterns, posteriors, fit and ratings, all in plain Python, against the registered query."""
    rng = random.Random(6)
    texts = ["", "...", "One two", "été Übung ª1 –dash– x"]
    for i in range(70):
        t = ". ".join(sentence(rng, rng.randrange(4, 14)).capitalize() for _ in range(rng.randrange(1, 9))) + "."
        kind = i % 9
        texts.append(t if kind < 4 else t.upper() if kind == 4 else t.replace(" ", " $# ") if kind == 5 else "buy now !!! " * 20 if kind == 6 else "na " * 50 + t if kind == 7 else t.replace(" ", " | "))
    frame = docs_frame(spark, list(enumerate(texts)))
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    votes = [plain_votes(plain_measures(t)) for t in texts]
    for t, v in zip(texts, votes, strict=True):
        _, _, offs, data = next(chunks(pa.array([t]), 1))
        assert np.allclose(quality.measures(offs, data)[0], plain_measures(t)), t
        assert quality.votes(quality.measures(offs, data))[0].tolist() == v
    patterns = [sum((x + 1) * 3**j for j, x in enumerate(v)) for v in votes]
    posterior = plain_estimate(Counter(patterns))
    got_posterior = quality.estimate(dict(Counter(patterns)))
    assert all(abs(got_posterior[k] - posterior[k]) < 1e-6 for k in posterior)
    order = sorted(range(len(texts)), key=lambda i: texts[i])  # the sample is all of so few
    features, w, b = plain_fit([texts[i] for i in order], [posterior[patterns[i]] for i in order])
    score = {i: 1 / (1 + math.exp(-(b + sum(x * w[a] for a, x in f.items())))) for i, f in zip(order, features, strict=True)}
    rows = {r["doc_id"]: r for r in quality.query(spark, str(tmp_path)).collect()}
    assert rows.keys() == set(range(len(texts)))
    for i, r in rows.items():
        assert abs(r["weak"] - posterior[patterns[i]]) < 1e-6 and abs(r["score"] - score[i]) < 2e-3 and (r["keep"] == (score[i] >= 0.5) or abs(score[i] - 0.5) < 2e-3)


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "Some plain text here."), (3, "w " * 100000), (4, "Same text. "), (4, "Same text. ")]
    got = quality.classify(docs_frame(spark, rows, extra=True)).collect()
    assert len(got) == 6 and sum(r["doc_id"] == 4 for r in got) == 2 and sum(r["doc_id"] is None for r in got) == 1
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = quality.keep_good(docs_frame(spark, rows, extra=True))
    assert kept.columns == docs_frame(spark, rows, extra=True).columns
    assert quality.classify(docs_frame(spark, [])).count() == 0 and quality.keep_good(docs_frame(spark, [])).count() == 0
