import zlib

import numpy as np
import pytest
import xxhash
from docs import documents, rows, simple

from saldospark.llm import langid, quality, toxicity


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{table}.parquet")


def labels(spark, data):
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int, text string")


def held(i, folds, out):
    return None if i is None else zlib.crc32(str(i).encode()) % folds == out


# --- language ---------------------------------------------------------------------------------------------------


def test_gradients_match_differences():
    r = np.random.default_rng(0)
    net = langid.Network.new(["a", "b", "c"], 1)
    p = {k: v.astype(np.float64) for k, v in net.params.items()}
    steps, y, h = r.integers(1, 9, (5, 4)), np.array([0, 1, 2, 1]), langid.HIDDEN

    def run(x, u, s):
        state, out = np.zeros((s.shape[1], h)), []
        for t in range(len(s)):
            a, g = x[s[t]], state @ u
            zr = 1 / (1 + np.exp(-(a[:, : 2 * h] + g[:, : 2 * h])))
            n = np.tanh(a[:, 2 * h :] + zr[:, h:] * g[:, 2 * h :])
            state = n + zr[:, :h] * (state - n)
            out.append(state)
        return np.array(out)

    def loss():
        both = np.concatenate((run(p["xf"], p["uf"], steps), run(p["xb"], p["ub"], steps[::-1])[::-1]), axis=2)
        z = both @ p["v"] + p["c"]
        z -= z.max(axis=2, keepdims=True)
        q = np.exp(z) / np.exp(z).sum(axis=2, keepdims=True)
        return -np.log(q[:, np.arange(4), y]).sum(), both, q

    _, both, q = loss()
    d = q.copy()
    d[:, np.arange(4), y] -= 1
    dboth = d @ p["v"].T
    for side, s, dout in (("f", steps, dboth[:, :, :h]), ("b", steps[::-1], dboth[::-1, :, h:])):
        kept, dx, du = [], np.zeros_like(p["x" + side]), np.zeros_like(p["u" + side])
        langid._run(p["x" + side].astype(np.float32), p["u" + side].astype(np.float32), s, kept)
        langid._back(p["u" + side], s, [tuple(np.asarray(k, float) for k in ks) for ks in kept], dout, dx, du)
        for name, grad in (("x" + side, dx), ("u" + side, du)):
            for at in [tuple(i) for i in np.argwhere(np.abs(grad) > 1e-3)[:4]]:
                old, eps, ends = p[name][at], 1e-5, []
                for e in (eps, -eps):
                    p[name][at] = old + e
                    ends.append(loss()[0])
                p[name][at] = old
                assert grad[at] == pytest.approx((ends[0] - ends[1]) / (2 * eps), rel=1e-2, abs=1e-3)


@pytest.fixture(scope="module")
def network(spark, sf_dir):
    return langid.fit(read(spark, sf_dir, "documents"))


def test_language_held_out(spark, sf_dir, network):
    docs = read(spark, sf_dir, "documents")
    got = {r["doc_id"]: r for r in langid.identify(docs, network).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(truth) and all(r["held_out"] == held(i, 4, 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    fold = [i for i in truth if got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in fold]) > 0.97


def test_language_edge_cases(spark, network):
    got = langid.identify(documents(spark), network).collect()
    assert len(got) == len(rows())
    for r in got:
        text = None if r["doc_id"] is None else rows()[r["doc_id"]][1]
        if r["doc_id"] in (0, 1, 2, 16):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0), text
        else:
            assert r["lang_pred"] in network.langs
        assert r["held_out"] == held(r["doc_id"], 4, 2)
    kept = langid.keep_identified(documents(spark), network)
    assert kept.columns == documents(spark).columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({0, 1, 2, 16})
    assert langid.identify(documents(spark, []), network).count() == 0
    none = langid.fit(documents(spark, []))
    assert none is None and {r["lang_pred"] for r in langid.identify(documents(spark), none).collect()} == {"und"}


def test_windows_cover_every_byte(network):
    text = "Der Fluss und das Haus " * 40
    whole, (p,) = langid.document_probs(network, [text]), langid.document_probs(network, [text], batch=3)
    assert np.allclose(whole[0], p, atol=1e-5) and whole[0].sum() == pytest.approx(1, abs=1e-4)
    assert langid.document_probs(network, ["", ""]).sum() == 0


# --- quality ----------------------------------------------------------------------------------------------------


def test_quality_held_out(spark, sf_dir):
    docs, marks = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    table = quality.word_vectors(docs)
    got = {r["doc_id"]: r for r in quality.score(docs, table, quality.fit(docs, marks, table)).collect()}
    assert all(r["held_out"] == held(i, 3, 1) and r["predicted"] == int(r["score"] >= 0.5) for i, r in got.items())
    pairs = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in marks.collect() if held(r["doc_id"], 3, 1)]
    assert np.mean([a == b for a, b in pairs]) > 0.93


def test_word_vectors_equal_neighbour_sums(spark):
    texts = ["river stone river", "Stone river", None, ""]
    table = quality.word_vectors(simple(spark, texts))
    bucket = {w: quality.word_buckets([w])[0][0] for w in ("river", "stone")}
    places, signs = quality.index_vectors()

    def index(w):
        v = np.zeros(quality.WIDTH)
        v[places[bucket[w]]] = signs[bucket[w]]
        return v

    for w, near in (("river", 3 * index("stone")), ("stone", 3 * index("river"))):
        assert np.allclose(table[bucket[w]], near / np.linalg.norm(near), atol=1e-5)
    assert quality.word_buckets(["Stone STONE stone"])[0].tolist().count(bucket["stone"]) == 2


def test_quality_edge_cases(spark):
    docs = documents(spark)
    table = quality.word_vectors(docs)
    marks = labels(spark, [(i, int(i % 2), 0, "x") for i in range(17)] + [(3, None, None, None), (None, 1, 1, "y"), (3, 1, 0, "z")])
    for net in (None, quality.fit(docs, marks, table)):
        got = quality.score(docs, table, net).collect()
        assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.fit(docs, labels(spark, []), table) is None
    assert quality.score(documents(spark, []), table, None).count() == 0
    assert not quality.word_vectors(documents(spark, [])).any()


def test_temperature_calibrates():
    r = np.random.default_rng(1)
    x = r.normal(size=(4000, 4))
    y = (r.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.train(x, y)
    p = net.probabilities(x)
    for lo in (0.1, 0.4, 0.7):
        inside = (p >= lo) & (p < lo + 0.2)
        assert abs(p[inside].mean() - y[inside].mean()) < 0.08


# --- toxicity ---------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark, sf_dir):
    docs, marks = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, marks)).collect()}
    assert all(r["held_out"] == held(i, 4, 2) and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    pairs = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in marks.collect() if held(r["doc_id"], 4, 2)]
    assert np.mean([a for a, b in pairs if b == 0]) < 0.05 and np.mean([a == b for a, b in pairs]) > 0.9


def test_matching_equals_a_plain_search():
    model = toxicity.Model({"idiot": 5.0, "clown": 4.0, "scum bag": 3.0}, ["clown fish"])
    a = model.automaton()
    cases = {"You 1d1ot!": ["1d1ot"], "clown fish, clown.": ["clown"], "іdіоt ｃｌｏｗｎ": ["іdіоt", "ｃｌｏｗｎ"], "idiots clowns": [], "scum bag": ["scum bag"], "": [], "idiot": ["idiot"], "cl0wn1 c1own": ["cl0wn"], "CLOWN\tIDIOT": ["CLOWN", "IDIOT"]}
    for text, want in cases.items():
        assert [text[s:e] for s, e, _, _ in toxicity.hits(a, text)] == want, text
    assert toxicity.hits(toxicity.Model().automaton(), "idiot") == []


HIDDEN = {
    "bad\u200bword": "zero width", "b\u00e1dword": "accent", "ba\u0301dword": "combining mark", "b.a.d.w.o.r.d": "dots", "b-a-d-w-o-r-d": "dashes", "baaadword": "run", "BADWOOORD": "run", "badw0rd": "digit", "b4dword": "digit",
    "b\uff41dword": "full width", "b\u0430dword": "homoglyph", "b\u00ada\u00add\u00adw\u00ado\u00adr\u00add": "soft hyphens", "𝐛𝐚𝐝word": "styled", "b.á.d.w.ο.r.d": "dots, accent, homoglyph", "b@dword": "sign",
}


@pytest.mark.parametrize("spelling", HIDDEN)
def test_folding_finds_hidden_spellings(spelling):
    a = toxicity.Model({"badword": 5.0, "hell": 4.0, "ship": 3.0}, ["mild badword"]).automaton()
    for before, after in (("", ""), ("It's ", ", see."), ("a\n", "\u200b x")):
        text = before + spelling + after
        assert [text[s:e].strip("\u200b") for s, e, _, _ in toxicity.hits(a, text)] == [spelling], HIDDEN[spelling]
    assert toxicity.hits(a, "a mild " + spelling) == []


def test_folding_leaves_other_words():
    a = toxicity.Model({"badword": 5.0, "hell": 4.0, "ship": 3.0, "sl1p": 2.0, "ace": 2.0}).automaton()
    assert toxicity.hits(a, "badwords abadword bad word hel heal shiip b.a.d w.o.r.d e.g. U.S.A. 1.2.3 a.c.e.s.") == []
    assert [h[3] for h in toxicity.hits(a, "helllllo hellll heelll a.c.e. (a.c.e)")] == ["hell", "ace", "ace"]
    long = "x y " * 50_000 + "hell"
    assert [long[s:e] for s, e, _, _ in toxicity.hits(a, long)] == ["hell"]


def test_toxicity_is_what_its_parts_say(spark):
    """Weights, exceptions, features, curve and scores worked out anew, plainly, from the same texts."""
    r = np.random.default_rng(5)
    word = lambda: "".join("abcdefghij"[i] for i in r.integers(0, 10, 3))
    texts = [" ".join([word() for _ in range(20)] + list(x)) for x in [("vile",)] * 30 + [("vile", "foul")] * 10 + [("meek", "vile")] * 7 + [()] * 200]
    toxic = [1] * 40 + [0] * 207
    model = toxicity.fit(simple(spark, texts), labels(spark, [(i, 1, t, None) for i, t in enumerate(toxic)]))
    learn = [i for i in range(len(texts)) if not held(i, 4, 2)]
    signature = {i: min(xxhash.xxh3_64_intdigest(" ".join(texts[i].split()[k : k + 5])) for k in range(max(1, len(texts[i].split()) - 4))) for i in learn}
    assert len(set(signature.values())) == len(learn)  # no near copies among them
    bad, good = sum(toxic[i] for i in learn), sum(1 - toxic[i] for i in learn)
    want = {}
    for w in {w for i in learn for w in texts[i].split()}:
        t, c = (sum(w in texts[i].split() for i in learn if toxic[i] == k) for k in (1, 0))
        odds = np.log((t + 0.5) / (bad - t + 0.5)) - np.log((c + 0.5) / (good - c + 0.5))
        if t >= toxicity.MIN_DOCS and odds >= toxicity.MIN_WEIGHT:
            want[w] = odds
    assert model.weights == pytest.approx(want) and {"vile", "foul"} <= set(want)
    assert "meek vile" in model.exceptions

    def feature(text):
        w = text.split()
        total = sum(want[x] for k, x in enumerate(w) if x in want and not any(p in model.exceptions for p in (" ".join(w[max(0, k - 1) : k + 1]), " ".join(w[k : k + 2]))))
        return np.log1p(total), np.log1p(100 * total / len(w))

    x, y = np.array([feature(texts[i]) for i in learn]), np.array([toxic[i] for i in learn], float)

    def loss(c):
        z = c[0] + x @ np.array(c[1:])
        return np.logaddexp(0, np.where(y == 1, -z, z)).sum() + 0.005 * np.square(c).sum()

    slope = [(loss(np.add(model.curve, d)) - loss(np.subtract(model.curve, d))) / 2e-4 for d in np.eye(3) * 1e-4]
    assert all(abs(g) < 1e-2 or (k and c == 0 and g > 0) for k, (c, g) in enumerate(zip(model.curve, slope)))  # the least loss, at slopes of 0 or more
    for row in toxicity.score(simple(spark, texts), model).collect():
        z = model.curve[0] + np.dot(model.curve[1:], feature(texts[row["doc_id"]]))
        assert row["score"] == pytest.approx(1 / (1 + np.exp(-z))) and row["predicted"] == int(row["score"] >= 0.3)


def test_learned_exceptions_and_lexicon(spark):
    r = np.random.default_rng(3)
    word = lambda: "".join("abcdefgh"[i] for i in r.integers(0, 8, 4))
    say = lambda *extra: " ".join([word() for _ in range(30)] + list(extra) + [word() for _ in range(5)])
    texts = [say("badword") for _ in range(80)] + [say("mild", "badword") for _ in range(12)] + [say() for _ in range(300)]
    marks = [(i, 1, int(i < 80), None) for i in range(len(texts))]
    model = toxicity.fit(simple(spark, texts), labels(spark, marks))
    assert "badword" in model.weights and len(model.weights) < 5 and "mild badword" in model.exceptions
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score(simple(spark, texts), model).collect()}
    assert [scored[i] for i in range(len(texts))] == [int(i < 80) for i in range(len(texts))]


def test_toxicity_edge_cases(spark):
    docs = documents(spark)
    for marks in ([], [(i, 1, int(i % 2), "x") for i in range(17)] + [(3, None, None, None), (None, 1, 1, "y"), (3, 1, 0, "z")]):
        got = toxicity.score(docs, toxicity.fit(docs, labels(spark, marks))).collect()
        assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(documents(spark, []), toxicity.fit(documents(spark, []), labels(spark, []))).count() == 0


def test_training_reads_whole_texts():
    r = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 1000):
        text = r.integers(1, 255, n).astype(np.uint8).tobytes()
        windows = langid.cut(text)
        got = windows[:-1].tobytes() + windows[-1].tobytes()[-(n - langid.WINDOW * (len(windows) - 1)) :] if n > langid.WINDOW else windows[0].tobytes()[:n]
        assert got == text and windows.shape[1] == langid.WINDOW
    picks, labels_ = langid.turns(np.repeat([0, 1], [30, 70]), 20, r), np.repeat([0, 1], [30, 70])
    seen = np.concatenate([next(picks) for _ in range(7)])
    assert set(seen) == set(range(100)) and abs((labels_[seen] == 0).mean() - 0.5) < 1e-9


def test_the_best_network_on_other_documents_is_kept():
    r = np.random.default_rng(4)
    letters = [np.array(list(b"abcd ")), np.array(list(b"wxyz "))]
    windows = np.stack([r.choice(letters[k % 2], langid.WINDOW) for k in range(400)]).astype(np.uint8)
    marks = np.arange(400) % 2
    net = langid.train(windows[:300], marks[:300], ["a", "b"], steps=200, dev=(windows[300:], marks[300:]))
    probs, loss = langid.position_probs(net, windows[300:]), []
    for k in (0, 1):
        loss.append(np.mean([-np.log(probs[k, t, i] + 1e-9) for i in range(100) if marks[300 + i] == k for t in range(langid.WINDOW)]))
    assert langid.window_loss(net, windows[300:], marks[300:]) == pytest.approx(np.mean(loss), rel=1e-5)
    assert np.mean(loss) < 0.2


def test_every_training_window_is_visited():
    labels = np.repeat([0, 1, 2], [90_000, 100, 7])
    seen = np.zeros(len(labels), bool)
    for _, pick in zip(range(langid.steps_for(labels)), langid.turns(labels, langid.BATCH, np.random.default_rng(0))):
        seen[pick] = True
    assert seen.all()


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 20_000)
    rows = [(i, "palabra " * (i % 300), "es") for i in range(400)] + [(1000 + i, "word " * 20, "en") for i in range(50)] + [(5000, "x" * 50_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_texts(docs, "doc_id", "text", "lang", (4, 2))
    for lang in ("es", "en"):
        size = sum(len(t) for name, _, t in got if name == lang)
        assert 0 < size <= 10_000
