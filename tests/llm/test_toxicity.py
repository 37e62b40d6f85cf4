import re
import zlib
from collections import Counter

import numpy as np
import xxhash

from foldkeep.llm.queries import op5_toxicity
from foldkeep.llm.toxicity import BUCKETS, BlockMax, Matcher, Model, choose_terms, fit_and_score, pooled, terms_of, word_counts, words_of


def test_block_max_neighbours_equal_brute_force():
    rng = np.random.default_rng(0)
    vocabulary = 40
    dense = rng.random((500, vocabulary)) * (rng.random((500, vocabulary)) < 0.1)
    dense[:, 20:] *= rng.random((500, 20)) < 0.05  # some terms are rare
    dense[:50] = dense[50:100]  # ties
    dense[np.arange(500), rng.integers(0, 20, 500)] += 0.1
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    vectors = [(np.flatnonzero(r), r[r > 0]) for r in dense]
    index = BlockMax.of_vectors(vectors, vocabulary)
    assert 0 < len(index.long) and len(index.terms) > 0
    queries = dense[::17]
    for q, (got, sims) in zip(queries, index.nearest([(np.flatnonzero(q), q[q > 0]) for q in queries], 12), strict=True):
        exact = dense @ q
        want = [i for i in np.lexsort((np.arange(500), -np.round(exact, 9))) if exact[i] > 0][:12]
        assert got.tolist() == want and np.allclose(sims, exact[want])


def test_matcher_equals_terms():
    vocabulary = ["bad", "badl*", "é", "idiot", "idio*", "x"]
    match = Matcher(vocabulary)
    for text in ("Bad badly bad-ass baddest", "é éa aé x1 1x _x_", "IDIOT idiots! anidiot", ""):
        assert {vocabulary[t] for t, _ in match(text)} == terms_of(text) & set(vocabulary)
    assert dict(match("bad bad badly"))[0] == 2
    assert Matcher([])("bad") == []


def test_chosen_terms_and_calibration():
    assert choose_terms([("bad", 60, 0), ("the", 90, 95), ("rare", 1, 0), ("good", 0, 60)], 100, 100, 4) == ["bad"]
    at, rates = pooled(np.array([0.1, 0.2, 0.3, 0.9]), np.array([0, 1, 0, 1.0]), np.ones(4))
    assert (np.diff(at) > 0).all() and (np.diff(rates) > 0).all() and 0 < rates[0] and rates[-1] < 1


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op5_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    own = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and labels.get(r.doc_id) is not None]
    tp = sum(a and b for a, b in own)
    assert tp / max(1, sum(b for _, b in own)) >= 0.9 and tp / sum(a for a, _ in own) >= 0.8
    assert all(r.evidence for r in got if r.predicted)


def test_odd_rows(spark):
    bad = [(i, "what a filthy nincompoop you are " + "word " * i) for i in range(60)]
    good = [(100 + i, "a calm and friendly sentence " + "word " * i) for i in range(60)]
    odd = [(300, None), (301, ""), (302, "filthy nincompoop " * 20_000), (303, "calm"), (303, "calm"), (None, "filthy nincompoop")]
    docs = spark.createDataFrame(bad + good + odd, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in bad] + [(i, 0) for i, _ in good] + [(5, None), (5, 1), (None, 1), (9999, 1)], "doc_id long, toxic int")
    got = {}
    for r in fit_and_score(docs, labels).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    assert got[302][0] > 0.9 and got[None][0] > 0.9 and got[300] == got[301] == got[303][:1] and got[300][0] < 0.2 and len(got[303]) == 2
    assert {r.score for r in fit_and_score(docs, labels.where("false")).collect()} == {0.5}
    assert fit_and_score(docs.where("false"), labels).isEmpty()
    one = fit_and_score(docs, labels.where("toxic = 1")).where("doc_id = 303").first().score
    assert 0 <= one <= 1


def test_copies_of_examples_without_chosen_terms_are_found(spark):
    bad = [(i, "what a filthy nincompoop you are " + "word " * i) for i in range(60)]
    good = [(100 + i, "a calm and friendly sentence " + "word " * i) for i in range(60)]
    rare = "ein ganz seltener schmaehsatz aus dem hinterland mit lauter einmaligen silben"
    copies = [(400, rare, 1), (401, rare, None), (402, rare + " eben", None), (403, "ein ganz anderer satz ueber das wetter", None)]
    docs = spark.createDataFrame(bad + good + [c[:2] for c in copies], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in bad] + [(i, 0) for i, _ in good] + [(400, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in fit_and_score(docs, labels).collect()}
    assert got[401].score > 0.5 and got[402].score > 0.5 and got[403].score < 0.2
    assert all(got[i].evidence[0].doc_id == 400 for i in (401, 402)) and got[401].evidence[0].similarity > 0.999
    assert all(got[i].evidence for i, _ in good)


def test_scores_equal_a_plain_vote(spark):
    """The query's scores by full cosines over dictionaries, without an index, from the same model."""
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    r = np.random.default_rng(5)
    rows = [(i, " ".join(r.choice(words, r.integers(3, 40)).tolist() + (["vile"] * int(r.integers(1, 3)) if i % 3 == 0 else []))) for i in range(240)]
    docs = spark.createDataFrame([(str(i), t) for i, t in rows] + [(None, "")], "doc_id string, text string")
    labels = spark.createDataFrame([(str(i), int(i % 3 == 0)) for i in range(160)], "doc_id string, toxic int")
    kept = []
    real = spark.sparkContext.broadcast
    try:
        spark.sparkContext.broadcast = lambda x: (kept.append(x), real(x))[1]
        got = {x.doc_id: x for x in fit_and_score(docs, labels).collect()}
    finally:
        del spark.sparkContext.broadcast
    m = next(x for x in kept if isinstance(x, Model))
    match, text = Matcher(m.vocabulary), dict((str(i), t) for i, t in rows)

    def vector(t):
        place, n, _ = word_counts([t])
        return dict(zip(*[x.tolist() for x in m.vector(match(t), place, n)], strict=True)), bool(match(t))

    own = [vector(text[i])[0] for i in m.ids]
    for i, t in text.items():
        v, chosen = vector(t)
        sims = [sum(w * o[k] for k, w in v.items() if k in o) for o in own]
        near = sorted((j for j in range(len(own)) if sims[j] > 0), key=lambda j: (-round(sims[j], 9), j))[: m.k]
        w = [min(sims[j], 1.0) ** (2 if chosen else 6) / (1.05 - min(sims[j], 1.0)) * m.stands_for[j] for j in near]
        base = 0.2 * m.stands_for.mean()
        vote = (sum(a * m.labels[j] for a, j in zip(w, near, strict=True)) + base * (m.rate if chosen else m.prior)) / (sum(w) + base)
        want = max(vote, m.prior) if not chosen else float(np.interp(vote, m.votes, m.rates)) if len(m.votes) else vote
        assert abs(got[i].score - want) < 1e-6 and [e.doc_id for e in got[i].evidence] == [m.ids[j] for j in near[:3]]


def test_exact_sums_read_whole_lists_only():
    """Terms without whole lists are summed in double precision on the way: the index keeps no second copy of them, and no candidate's words are read again."""
    rng = np.random.default_rng(7)
    dense = np.zeros((400, 3000))
    dense[:, :20] = rng.random((400, 20)) * (rng.random((400, 20)) < 0.5)
    dense[:, 20:] = rng.random((400, 2980)) * (rng.random((400, 2980)) < 0.01)
    dense[:40] = dense[40:80]
    dense[100:110] = 0
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    index = BlockMax.of_vectors([(np.flatnonzero(r), r[r > 0]) for r in dense], 3000)
    assert index.long.tolist() == list(range(20)) and len(index.terms) > 2000
    assert len(index.own) == len(index.size) == (dense[:, :20] > 0).sum() and len(index.row) == (dense[:, 20:] > 0).sum()
    queries = [*dense[::9], np.eye(3000)[5], np.eye(3000)[25], np.zeros(3000)]
    for q, (got, sims) in zip(queries, index.nearest([(np.flatnonzero(q), q[q > 0]) for q in queries], 15), strict=True):
        exact = dense @ q
        want = [i for i in np.lexsort((np.arange(400), -np.round(exact, 9))) if exact[i] > 0][:15]
        assert got.tolist() == want and np.allclose(sims, exact[want], rtol=0, atol=1e-12)
    empty = BlockMax.of_vectors([], 10).nearest([(np.array([3]), np.array([1.0]))], 5)
    assert [x.tolist() for x in empty[0]] == [[], []]


def test_words_of_ascii_and_other_texts_are_the_same():
    for t in ("The KELVIN \u212a sign", "a1b2_c don't\tstop\x00now", "\u0130stanbul stra\u00dfe \u00e9t\u00e9 x\u00b2y", "", "123 _", "Z" * 50):
        want = re.findall(r"[^\W\d_]+", t.lower())
        assert [w.decode() if isinstance(w, bytes) else w for w in words_of(t)] == want
        place, n, begin = word_counts([t])
        each = Counter(xxhash.xxh64_intdigest(w) % BUCKETS for w in want)
        assert dict(zip(place.tolist(), n.tolist(), strict=True)) == each and begin.tolist() == [0, len(each)]
