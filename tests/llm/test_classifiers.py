import itertools
import math
import zlib

import numpy as np
import pytest

from folioscan.llm import quality, toxicity
from folioscan.llm.bytetext import expanded, shingles, words

DOCS = "doc_id long, text string, lang string, source string, score double"
LABELS = "doc_id long, quality int, toxic int, source string"


def corpus(n=600, seed=3):
    r = np.random.default_rng(seed)
    plain = ["haran", "mitol", "the", "and", "senor", "lavi", "torun", "bek", "olan", "esti"]
    bad = ["grumple", "snorvak", "blixten"]
    docs, labels = [], []
    for i in range(n):
        w = [plain[k] + "aeiou"[r.integers(5)] for k in r.integers(0, len(plain), 60)]
        junk, toxic = i % 5 == 0, i % 4 == 1
        if toxic:
            for _ in range(3):
                form = bad[r.integers(3)]
                if i % 8 == 1:
                    form = [form.replace("e", "3").replace("o", "0").replace("i", "1"), " ".join(form)][r.integers(2)]
                w[r.integers(len(w))] = form
        text = " ".join(x.upper() + "$$$" if junk else x for x in w)
        docs.append((i, text, "en", "s", 0.0))
        if r.random() < 0.6:
            labels.append((i, int(not junk), int(toxic), "s"))
    return docs, labels, {i: (int(i % 5 != 0), int(i % 4 == 1)) for i in range(n)}


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels, truth = corpus()
    odd = [(1000, None, "en", "s", 0.0), (1001, "", "en", "s", 0.0), (None, "no id", None, None, None), (3, docs[3][1], "en", "s", 0.0)]
    more = [(2, None, None, "s"), (None, 1, 1, "s"), (labels[0][0], 1 - labels[0][1], 1 - labels[0][2], "s")]
    return spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(labels + more, LABELS), truth


def check_shape(rows, modulus, remainder):
    assert len(rows) == 604
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder)


def test_quality_on_held_out_rows(tables):
    docs, labels, truth = tables
    rows = quality.op3_pu_quality(docs, labels).collect()
    check_shape(rows, 3, 1)
    own = [(r["predicted"], truth[r["doc_id"]][0]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in own]) > 0.95
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and 400 < kept.count() < 560


@pytest.mark.parametrize("n", [300, 600, 2000])
@pytest.mark.parametrize("seed", [3, 4, 5])
@pytest.mark.parametrize("odd", [0, 1])
def test_quality_at_several_sizes(spark, n, seed, odd):
    docs, labels, truth = corpus(n, seed)
    more = [(100_000, None, "en", "s", 0.0), (100_001, "", "en", "s", 0.0), (None, "no id", None, None, None), (3, docs[3][1], "en", "s", 0.0)] * odd
    scored = {r["doc_id"]: r["predicted"] for r in quality.op3_pu_quality(spark.createDataFrame(docs + more, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    got, truth = np.array([scored[i] == 1 for i in range(n)]), np.array([truth[i][0] for i in range(n)])
    assert (got & (truth == 0)).sum() <= 0.02 * (truth == 0).sum()
    assert (~got & (truth == 1)).sum() <= 0.05 * (truth == 1).sum()


def test_each_row_is_judged_by_its_own_text(spark, tables):
    docs, labels, _ = tables
    rows = [(1, "HARANA$$$ MITOLE$$$ " * 30, "x", 1.0), (1, "harana mitole the anda senora lavi " * 10, "x", 2.0), (None, "HARANA$$$ MITOLE$$$ " * 30, "x", 3.0), (None, "harana mitole anda senora lavi " * 10, "x", 4.0)]
    clash = spark.createDataFrame([(i, t, "en", "s", 0.0) for i, t, *_ in docs.select("doc_id", "text").collect() if i is not None] , DOCS).selectExpr("doc_id", "text", "source as features", "score").unionByName(spark.createDataFrame(rows, "doc_id long, text string, features string, score double"))
    kept = quality.accepted(clash, labels)
    assert kept.columns == clash.columns
    assert sorted(r["score"] for r in kept.filter("features = 'x'").collect()) == [2.0, 4.0]


def test_toxicity_on_held_out_rows(tables):
    docs, labels, truth = tables
    rows = toxicity.op2_noisy_channel(docs, labels).collect()
    check_shape(rows, 5, 0)
    own = [(r["predicted"], truth[r["doc_id"]][1]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in own]) > 0.93


def test_tables_without_rows_or_labels(spark, tables):
    docs, labels, _ = tables
    for op in (quality.op3_pu_quality, toxicity.op2_noisy_channel):
        assert op(docs.filter("doc_id < 0"), labels).count() == 0
        few = op(docs.filter("doc_id < 5"), labels.filter("doc_id < 0")).collect()
        assert len({r["score"] for r in few}) == 1


def test_prior_is_the_least_ratio():
    r = np.random.default_rng(1)
    p, n = r.normal(0.8, 0.1, 20000), r.normal(0.2, 0.1, 20000)
    bins = np.linspace(0, 1, 401)
    u = np.concatenate([p[:6000], n[:4000]])
    prior = quality.estimate_prior(np.histogram(np.clip(p, 0, 1), bins)[0], np.histogram(np.clip(u, 0, 1), bins)[0])
    assert abs(prior - 0.6) < 0.03


def test_nnpu_separates_with_positives_and_unlabelled_rows():
    r = np.random.default_rng(2)
    p, n = r.normal(1, 0.7, (2000, 3)), r.normal(-1, 0.7, (2000, 3))
    w, b = quality.fit_nnpu(p[:800].astype(np.float32), np.concatenate([p[800:1500], n[:300]]).astype(np.float32), 0.7)
    assert ((p[1500:] @ w + b > 0).mean() + (n[300:] @ w + b <= 0).mean()) / 2 > 0.95


@pytest.fixture(scope="module")
def model():
    text = ("you are such a worthless idiot and a pathetic clown what a loser this stupid moron said then the rain fell on the old town " * 40).encode()
    return toxicity.Model(toxicity.trigram_counts(np.frombuffer(text, np.uint8), np.array([0, len(text)])))


@pytest.mark.parametrize(
    ("noisy", "plain"),
    [("you 1d10t", "you idiot"), ("an i d i o t", "an idiot"), ("cl0wn, m0r0n", "clown moron"), ("l.o.s.e.r", "loser"), ("stuuuupid", "stupid"), ("the rain fell", "the rain fell"), ("w0rthl3$$", "worthless"), ("tel. 555-1234", "tel. 555-1234")],
)
def test_restoring(model, noisy, plain):
    assert toxicity.restore(model, noisy).replace(",", "") == plain


def test_restored_column(spark):
    rows = spark.createDataFrame([(i, "the idiot said that the rain is cold") for i in range(50)] + [(99, "the 1d10t"), (100, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in toxicity.restored(rows).collect()}
    assert got[99] == "the idiot" and got[100] == "" and got[0] == "the idiot said that the rain is cold"


def test_word_kernels_stay_inside_their_text():
    body = "aa bb".encode(), "cc".encode(), b"", "a a a a a a".encode()
    raw = np.frombuffer(b"".join(body), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in body])]).astype(np.int64)
    text, start, end, hashes = words(raw, offsets)
    assert text.tolist() == [0, 0, 1] + [3] * 6 and len(set(hashes.tolist())) == 4
    owner, item = shingles(raw, offsets)
    assert owner.tolist() == [0, 1, 3, 3]
    assert expanded(owner, item)[2].tolist() == [1, 1, 2]


@pytest.mark.parametrize(
    ("noisy", "plain"),
    [
        ("st" + "u" * 60 + "pid", "stupid"),
        ("st00pid,1d10t,m0r0n,cl0wn,l0s3r,w0rthl3ss,st00pid", "stoopid,idiot,moron,clown,loser,worthless,stoopid"),
        ("a/m0r0n\u00a0cl0wn\u20141d10t-l0s3r/w0rthl3ss;m0r0n", "a/moron\u00a0clown\u2014idiot-loser/worthless;moron"),
        ("y o u a r e a n i d i o t", "you are an idiot"),
        ("y  o u  a   r e a  n i d . i o t", "you are an idiot"),
        ("looooosseeeer", "loser"),
        ("a l  o  s  e  r", "a loser"),
        ("w0rthl3sss" + "s" * 190, "worthless"),
        ("stuuuu" + "u" * 300 + "p1d", "stupid"),
        ("x" + "0a" * 30000, None),
    ],
)
def test_restoring_long_and_glued_pieces(model, noisy, plain):
    form = toxicity.restore(model, noisy)
    assert form == plain if plain else len(form) == len(noisy)


def test_words_behind_foreign_signs_are_scored(model):
    def found(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return set(toxicity.text_features(model, raw, np.array([0, len(raw)]))[1].tolist())

    assert found("cl0wn\u00a0idiot, you") == found("clown idiot you")


def all_readings(model, word, joint):
    """The best score over every choice at every run and gap, one by one."""
    runs = [(c, len(list(g))) for c, g in itertools.groupby(word)]
    stretched = any(n > 2 for _, n in runs)
    choices = []
    for i, (c, n) in enumerate(runs):
        options = [(c, math.log(1 - toxicity.SWAP) if c in toxicity.LOOKALIKES else 0.0)] + [(x, math.log(toxicity.SWAP)) for x in toxicity.LOOKALIKES.get(c, "")]
        kept = {n, min(n, 2), 1} if stretched else {n}
        own = [(x * k, cost * k + math.log(toxicity.REPEAT) * (n - k)) for x, cost in options for k in kept]
        gaps = [("", joint), (" ", 0.0)] if i and joint is not None else [("", 0.0)]
        choices.append([(g + x, a + b) for g, a in gaps for x, b in own])
    scored = {}
    for way in itertools.product(*choices):
        text = "".join(x for x, _ in way)
        score, a, b = sum(x for _, x in way), 0, 0
        for c in [*text, " "]:
            k = 0 if c == " " else toxicity._symbol(c)
            score += model.log[a][b][k]
            a, b = (0, 0) if c == " " else (b, k)
        scored[text] = max(score, scored.get(text, -math.inf))
    return scored


@pytest.mark.parametrize("word", ["1d10t", "l00ser", "sssoo", "m0r0nn", "cl0wwwn", "i1!i", "a", "7e57", "looosseer"])
@pytest.mark.parametrize("joint", [None, -0.3])
def test_viterbi_finds_the_best_of_all_readings(model, word, joint):
    if joint is not None and len(word) > 7:
        word = word[:6]
    scored = all_readings(model, word, joint)
    assert scored[model._viterbi(word, joint)] >= max(scored.values()) - 1e-9
