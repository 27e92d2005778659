import random

import numpy as np

from lakeloom.llm import content as C
from lakeloom.session import materialize

CALM = ["The office at North College is closed from 12 May, and letters are answered afterwards.", "Remember to attach the study plan when you write to South Forum about the grant.", "You can apply for the loan through West Campus if you have been enrolled for 40 weeks.", "A researcher studies how rude words such as muppet spread in forums."]
RUDE = ["Shut your mouth, you rotten {}, nobody wants your rubbish.", "Go away and never come back, you smelly {}.", "Everyone here thinks you are a {} and they are right."]
NAMES = ["muppet", "numpty", "plonker", "wazzock"]


def texts(rng, rude, n=6):
    out = [rng.choice(CALM) for _ in range(n)]
    if rude:
        out.insert(rng.randrange(n), rng.choice(RUDE).format(rng.choice(NAMES)))
    return " ".join(out)


def corpus(seed=1, n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rude = i % 4 == 0
        wrong = i % 40 == 1
        rows.append((texts(rng, rude and not wrong), frozenset(["abusive"] if rude or wrong else ["none"])))
    return rows


def test_kernel_is_the_dot_product_of_subsequences():
    a, b = " abcd efgh ", " abxcd efh "

    def phi(s):
        out = {}
        for i in range(len(s)):
            for p in C.PATTERNS:
                if i + p[-1] < len(s):
                    k = "".join(s[i + o] for o in p)
                    out[k] = out.get(k, 0) + C.DECAY ** (p[-1] - C.LENGTH + 1)
        n = sum(v * v for v in out.values()) ** 0.5
        return {k: v / n for k, v in out.items()}

    pa, pb = phi(a), phi(b)
    want = sum(v * pb.get(k, 0) for k, v in pa.items())
    got = C.Landmarks([b]).kernel([a, b])
    assert np.allclose(got[:, 0], [want, 1])


def trained(rows, background=()):
    """As `fit` does it, from texts: counts are those of all of them."""
    ready = [(C_prepared(t), cats) for t, cats in rows]
    others = [C_prepared(t) for t in background]
    every = [ss for ss, _ in ready] + others
    seen, often = {}, {}
    for ss in every:
        for g in {g for s in ss for g in C.grams(s)}:
            seen[g] = seen.get(g, 0) + 1
        for s in set(ss):
            often[s] = often.get(s, 0) + 1
    return C.train(ready, sorted(often, key=lambda s: (-often[s], s))[: C.FREQUENT], seen, len(every))


def C_prepared(text):
    return list(dict.fromkeys(map(C.prepared, C.sentences(text))))


def test_held_out_accuracy_and_disguises():
    m = trained(corpus(), [texts(random.Random(9 + i), False) for i in range(60)])
    rng = random.Random(77)
    rude = [r.format(x) for r in RUDE for x in NAMES]
    disguised = [r.format(x) for r in RUDE for x in ("m u p p e t", "n*mpty", "pl0nk3r", "WAZZOCK", "muuuuppet", "mup-pet")]
    s = lambda xs: m.scores([C.prepared(x) for x in xs])[:, 0]
    assert (s(rude) > 0).all()
    assert (s(disguised) > 0).mean() > 0.9
    assert (s(CALM) < 0).all()
    assert (s([texts(rng, False, 1) for _ in range(20)]) < 0).all()


def test_one_word_is_a_sentence():
    assert C.sentences("Idiot! 12! A.") == ["Idiot!", "A."]
    rows = [(t + " Muppet!" * (i % 4 == 0), frozenset(["abusive"] if i % 4 == 0 else ["none"])) for i, (t, _) in enumerate(corpus())]
    m = trained(rows)
    rude, calm = m.scores([C.prepared("Muppet!"), C.prepared(CALM[0])])[:, 0]
    assert rude > calm


def test_threshold_is_between_the_classes():
    scores, truth = np.array([[3.0, -1], [2, -2], [-1, -3], [-1.5, 1]]), np.array([[1, 0], [1, 0], [0, 0], [0, 1]], bool)
    assert -1 <= C.best_threshold(scores, truth) <= 1


def test_counts_cover_all_documents(spark):
    rows = [(1, "En to tre fire. En to tre fire. Fem."), (2, "en to tre"), (3, None), (4, ""), (5, "Ord. Fem.")]
    ready = C.prepare(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert C.document_counts(ready, ["en to tre", "fem", "mangler"]) == {"en to tre": 2, "fem": 2}
    assert C.frequent_sentences(ready, 1) == [" fem . "]
    assert C.document_counts(ready, []) == {} and C.document_counts(ready.limit(0), ["a"]) == {}


def test_scoring_equals_kernel_form():
    m = trained(corpus(3))
    assert np.isfinite(m.weights).all() and (m.offset[1:] == C.EMPTY).all()


def test_tables(spark):
    rows = [(i, t, "Src.example/" if i % 2 else "src.example") for i, (t, _) in enumerate(corpus())]
    rows += [(900, None, None), (901, "", "src.example"), (902, "x" * 50_000, "b"), (900, None, None), (None, "text here", "b")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, abusive int")
    labels = [(i, next(iter(c)), 1) for i, (_, c) in enumerate(corpus())] + [(0, "abusive", 2), (1, None, 1), (5000, "sexual", 1)]
    lab = spark.createDataFrame(labels, "doc_id bigint, category string, text int")
    ready = materialize(C.prepare(docs), "ready")
    scored = C.score(ready, C.fit(ready, lab))
    got = {r.doc_id: r for r in scored.collect()}
    assert len(got) == len({r[0] for r in rows}) - 1 and got[900].abusive == C.EMPTY == got[901].hateful
    flagged = {r.doc_id for r in C.flagged(scored).collect() if r.category == "abusive"}
    truth = {i for i, (t, _) in enumerate(corpus()) if any(n in t for n in NAMES[1:]) or "you rotten" in t or "you smelly" in t or "thinks you are" in t}
    assert len(flagged & truth) >= 0.95 * len(truth) and len(flagged - truth) <= 2
    rates = {r.source: r for r in C.rates(docs, scored).collect()}
    assert rates["src.example"].n_docs == len(corpus()) + 1
    none = materialize(C.prepare(docs.limit(0)), "ready")
    assert C.score(none, C.fit(none, lab.limit(0))).count() == 0 and C.score(ready, C.fit(ready, lab.limit(0))).filter("abusive > -2").count() == 0
