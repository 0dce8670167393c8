"""Plain versions of what the models and the pipeline's stages work out, document by document."""

import hashlib
import math
from functools import lru_cache

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from docs import documents, rows, simple
from test_bpe import ENCODING
from test_decontaminate import distance, folded
from test_secrets import base, segments
from test_simhash import similar_groups

from saldospark.llm import decontaminate, langid, quality, secrets

MASK = (1 << 64) - 1


def plain_words(text):
    """(bucket, class of the first character) of each word, one character at a time."""
    def kind(c):
        return 2 if c.isalpha() and c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 0 if c.isspace() else 4

    runs = []
    for c in text:
        k = kind(c)
        group = 1 if k == 2 else k
        if runs and runs[-1][0] == group and (group != 4 or runs[-1][2][-1] == c):
            runs[-1][2].append(c)
        else:
            runs.append((group, k, [c]))
    out = []
    for group, k, cs in runs:
        if group == 0:
            continue
        total = 0
        for place, c in enumerate(cs):
            cp = ord(c) | 0x20 if place == 0 and k == 2 else ord(c)
            x = (cp + 1) * ((place * 0x9E3779B97F4A7C15 + 0xBF58476D1CE4E5B9) & MASK) & MASK
            x ^= x >> 29
            total = (total + (x * 0x94D049BB133111EB & MASK)) & MASK
        out.append(((total ^ total >> 32) % quality.BUCKETS, k))
    return out


def plain_features(table, text):
    found = plain_words(text)
    n = len(found)
    mean, step, rates = np.zeros(quality.WIDTH), np.zeros(quality.WIDTH), [0.0] * 4
    for i, (b, k) in enumerate(found):
        mean += table[b]
        for r, hit in enumerate((k == 2, k == 3, k == 4, i > 0 and found[i - 1][0] == b)):
            rates[r] += hit
        if i:
            step += np.abs(table[b] - table[found[i - 1][0]])
    return np.array([*mean / max(n, 1), *step / max(n - 1, 1), *(r / max(n, 1) for r in rates), math.log1p(n), len(text) / max(n, 1) / 10])


def test_pooled_features_and_scores(spark):
    r = np.random.default_rng(5)
    table = r.normal(size=(quality.BUCKETS, quality.WIDTH)).astype(np.float32)
    texts = [x[1] or "" for x in rows() if len(x[1] or "") < 5_000] + ["Ab1!!?? ÑANDÚ ñandú ǅ x  x", "a" * 300 + " 12 12"]
    want = np.array([plain_features(table, t) for t in texts])
    assert np.allclose(quality.pool(table, texts), want, atol=1e-4)
    net = quality.Network(want.mean(0), want.std(0) + 1e-3, r.normal(size=(quality.N_FEATURES, quality.HIDDEN)), r.normal(size=quality.HIDDEN), r.normal(size=quality.HIDDEN), 0.3, 1.7)
    got = {x["doc_id"]: x["score"] for x in quality.score(simple(spark, texts), table, net).collect()}
    for i, f in enumerate(want):
        hidden = [math.tanh(sum((f[a] - net.mean[a]) / net.scale[a] * net.w1[a, b] for a in range(len(f))) + net.b1[b]) for b in range(quality.HIDDEN)]
        z = (sum(h * w for h, w in zip(hidden, net.w2)) + net.b2) / 1.7
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=2e-3)


def test_word_vectors_are_sums_over_neighbours(spark):
    texts = [x[1] for x in rows() if len(x[1] or "") < 5_000]
    places, signs = quality.index_vectors()
    sums = np.zeros((quality.BUCKETS, quality.WIDTH))
    for t in texts:
        found = [b for b, _ in plain_words(t or "")]
        for a, b in zip(found, found[1:]):
            for x, y in ((a, b), (b, a)):
                sums[x, places[y]] += signs[y]
    want = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality.word_vectors(simple(spark, texts)), want, atol=1e-5)


def plain_network(net, text):
    """Mean probabilities over the bytes of a text: each window anew, in both directions, in double precision."""
    data, p, h = text.encode(), {k: v.astype(float) for k, v in net.params.items()}, langid.HIDDEN
    total = np.zeros(len(net.langs))

    def states(window, x, u):
        state, out = np.zeros(h), []
        for byte in window:
            a, g = x[byte], state @ u
            z, r = (1 / (1 + np.exp(-(a[i * h : (i + 1) * h] + g[i * h : (i + 1) * h]))) for i in (0, 1))
            n = np.tanh(a[2 * h :] + r * g[2 * h :])
            state = n + z * (state - n)
            out.append(state)
        return out

    for at in range(0, len(data), langid.CORE):
        window = [data[k] if 0 <= k < len(data) else 0 for k in range(at - langid.EDGE, at + langid.CORE + langid.EDGE)]
        forward, backward = states(window, p["xf"], p["uf"]), states(window[::-1], p["xb"], p["ub"])[::-1]
        for k in range(at, min(at + langid.CORE, len(data))):
            i = k - at + langid.EDGE
            logits = np.concatenate((forward[i], backward[i])) @ p["v"] + p["c"]
            e = np.exp(logits - logits.max())
            total += e / e.sum()
    return total / max(1, len(data))


def test_document_probabilities(spark):
    net = langid.Network.new(["de", "en", "es"], 3)
    texts = [x[1] or "" for x in rows() if len(x[1] or "") < 3_000] + ["ñ" * 80, "x" * 160, "y" * 161, "z" * 15]
    want = np.array([plain_network(net, t) for t in texts])
    assert np.allclose(langid.document_probs(net, texts), want, atol=2e-5)
    for r in langid.identify(simple(spark, texts), net).collect():
        lettered = any(c.isalpha() for c in texts[r["doc_id"]])
        assert r["lang_pred"] == (net.langs[int(want[r["doc_id"]].argmax())] if lettered else "und")
        assert r["score"] == pytest.approx(want[r["doc_id"]].max() if lettered else 0, abs=2e-5)


@lru_cache(maxsize=None)
def cheapest(value):
    """Least cost over all segmentations, from the end."""
    best = [0.0] * (len(value) + 1)
    for i in range(len(value) - 1, -1, -1):
        best[i] = min((math.log10(2) if i else 0) + cost + best[j] for j, cost in segments(value, i))
    return best[0]


def plain_mask(text):
    """The text with secrets replaced, from the literal base patterns and the guess cost of values in context."""
    spans = [tuple(map(int, s.split(":")[1:])) for s in base(text)[3].split(",") if s]
    for a, whole in sorted({(m.start(1), m.group(1)) for c in secrets.CONTEXTS for m in c.finditer(text)}):
        value = whole.rstrip(".,;:!?)]}>")
        if len(value) >= 6 and not any(s < a + len(value) and a < e for s, e in spans) and cheapest(value[:200]) >= secrets.MIN_COST:
            spans.append((a, a + len(value)))
    covered = [False] * len(text)
    for s, e in spans:
        covered[s:e] = [True] * (e - s)
    starts = {s for s, _ in spans}
    out, inside = [], False
    for i, c in enumerate(text):
        if covered[i] and (not inside or i in starts and not any(s < i < e for s, e in spans)):
            out.append("[SECRET]")
        inside = covered[i]
        if not inside:
            out.append(c)
    return "".join(out)


def leaks(text, items):
    """Whether an item stands in the text within its edit budget. Of budget + 1 pieces one must stand there unchanged, which saves most distances."""
    text = folded(text)
    for item in items:
        budget = int(len(item) * decontaminate.EDITS)
        cuts = [len(item) * k // (budget + 1) for k in range(budget + 2)]
        if any(item[a:b] in text for a, b in zip(cuts, cuts[1:])):
            for at in range(0, max(1, len(text)), 400):
                if distance(item, text[at : at + 400 + 2 * len(item)]) <= budget:
                    return True
    return False


def test_stages_equal_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [t for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if (t := folded(r["text"]))]
    fitted = {}
    fit = langid.fit
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language_id":
            fitted["net"] = fit(docs)
        docs = stage(spark, docs, sf_dir).persist()
        after = docs.collect()
        if name == "language_id":  # the last bits of single precision can tip a document at the bound only
            kept = {r["doc_id"] for r in after}
            few = [i for i in before if len(before[i] or "") < 2_000]
            for i in few[:60]:
                p = plain_network(fitted["net"], before[i] or "").max()
                if abs(p - 0.3) > 1e-3:
                    assert (i in kept) == (any(c.isalpha() for c in before[i] or "") and p >= 0.3)
        elif name == "near_dedup":
            ids = sorted(before)
            assert {r["doc_id"] for r in after} == {ids[g] for g in similar_groups([before[i] for i in ids])}
        elif name == "decontamination":
            kept = {r["doc_id"] for r in after}
            short = [i for i in before if len(before[i]) < 4_000]
            assert {i for i in short if i in kept} == {i for i in short if not leaks(before[i], items)}
        elif name == "secret_scan":
            assert {r["doc_id"]: r["text"] for r in after} == {i: plain_mask(t) for i, t in before.items()}
        else:
            for r in after:
                ids = ENCODING.encode_ordinary(before[r["doc_id"]])
                assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def near_copy(text, edits, seed):
    """The text with words replaced here and there."""
    ws, r = text.split(), np.random.default_rng(seed)
    for i in r.choice(len(ws), edits, replace=False):
        ws[i] = f"other{seed}"
    return " ".join(ws)


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_recall_of_near_copies_by_similarity(spark):
    """All pairs at 0.8 or more are found, those below are left, whatever the number of edits."""
    originals = [" ".join(f"w{xxhash.xxh32_intdigest(f'{k}-{i}') % 5000}" for i in range(220)) for k in range(60)]
    data, similarity = [], {}
    for k, t in enumerate(originals):
        data.append((2 * k, t))
        data.append((2 * k + 1, near_copy(t, k % 10, k)))
        similarity[2 * k + 1] = jaccard(t, data[-1][1])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert {2 * k for k in range(60)} <= kept
    assert {i: i not in kept for i in similarity} == {i: s >= 0.8 for i, s in similarity.items()}
    assert 10 < sum(s >= 0.8 for s in similarity.values()) < 50
    assert documents(spark).columns[0] == "doc_id"
