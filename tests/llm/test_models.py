"""Quality and toxicity: identities, held-out accuracy and odd rows."""

from __future__ import annotations

from collections import Counter

import numpy as np

from gustframe.llm import quality_fm, queries, toxicity_kn
from tests.llm.helpers import ODD, documents

SF01 = "/root/testdata/sf0.01"


def _auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


def _held_out(spark, query, label):
    labels = spark.read.parquet(f"{SF01}/labels.parquet").select("doc_id", label)
    rows = query(spark, SF01).filter("held_out").join(labels, "doc_id").dropna().collect()
    return np.array([r["score"] for r in rows]), np.array([r[label] for r in rows]), np.array([r["predicted"] for r in rows])


def test_quality_on_the_held_out_fold(spark):
    score, y, predicted = _held_out(spark, queries.op7_quality, "quality")
    assert ((0 <= score) & (score <= 1)).all() and (predicted == (score >= 0.7)).all()
    assert _auc(score, y) > 0.8


def test_toxicity_on_the_held_out_fold(spark):
    score, y, predicted = _held_out(spark, queries.op8_toxicity, "toxic")
    assert ((0 <= score) & (score <= 1)).all() and (predicted == (score >= 0.3)).all()
    assert _auc(score, y) > 0.85


def test_pairs_in_linear_time_like_all_pairs():
    machine, dice = quality_fm.Machine(), np.random.default_rng(3)
    machine.w, machine.v = dice.normal(size=machine.w.shape), dice.normal(size=machine.v.shape)
    for text in ("one two three 4!", "a", ""):
        idx, val, starts = machine.rows([quality_fm.features(text)])
        slow = machine.bias + (machine.w[idx] * val).sum()
        slow += sum(machine.v[idx[i]] @ machine.v[idx[j]] * val[i] * val[j] for i in range(len(idx)) for j in range(i))
        assert np.isclose(machine.margins(idx, val, starts)[0][0], slow)


def test_quality_scores_like_all_pairs(spark):
    """The query's scores from the fitted weights, every pair of features by itself; repeated rows alike, a clashing column replaced."""
    docs, labels = _labelled(spark, "kind calm words here", "vile nasty words there", "quality")
    machine = quality_fm.fit(docs, labels)
    texts = [*ODD, "kind words of 12 people!", "vile " * 4000, "kind words of 12 people!"]
    got = {r["doc_id"]: r["score"] for r in quality_fm.score(documents(spark, texts).selectExpr("*", "1 as score", "2 as __text"), machine).collect()}
    for k, t in enumerate(texts):
        buckets, stats = quality_fm.features(t)
        x = [(quality_fm.WORDS + i, float(np.clip((v - machine.mean[i]) / machine.scale[i], -4, 4))) for i, v in enumerate(stats)]
        x += [(int(b), 1 / max(1, len(buckets)) ** 0.5) for b in buckets]
        margin = machine.bias + sum(machine.w[i] * v for i, v in x)
        margin += sum(float(machine.v[i] @ machine.v[j]) * a * b for n, (i, a) in enumerate(x) for j, b in x[:n])
        assert abs(got[k] - 1 / (1 + np.exp(-margin))) < 1e-9
    assert got[len(texts) - 1] == got[len(ODD)]


def _labelled(spark, good, bad, label):
    texts = [f"{good} {i}" if i % 2 else f"{bad} {i}" for i in range(80)]
    return documents(spark, texts), spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (500, None)], f"doc_id long, {label} int")


def test_held_out_labels_are_not_read(spark):
    docs, labels = _labelled(spark, "kind calm words here", "vile nasty words there", "toxic")
    turned = labels.selectExpr("doc_id", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2 then 1 - toxic else toxic end as toxic")
    for module in (quality_fm, toxicity_kn):
        one, two = (sorted(map(tuple, module.score(docs, module.fit(docs, l, "toxic"), keep=["doc_id"]).collect())) for l in (labels, turned))
        assert one == two


def test_odd_rows_and_no_labels(spark):
    docs, labels = _labelled(spark, "kind calm words here", "vile nasty words there", "toxic")
    odd = documents(spark, ODD).selectExpr("*", "1 as score")
    for module, without in ((quality_fm, 0.5), (toxicity_kn, 0.0)):
        model = module.fit(docs, labels, "toxic")
        got = module.score(odd, model).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
        assert module.score(odd.limit(0), model).count() == 0
        assert {r["score"] for r in module.score(odd, module.fit(docs, labels.limit(0), "toxic")).collect()} == {without}


def _slow_ratios(rows):
    """Word -> log likelihood ratio by all grams of rows (y, text), without Spark."""
    order, cut, least = toxicity_kn.ORDER, toxicity_kn.DISCOUNT, toxicity_kn.LEAST_SHARE
    raw = Counter((k, y) for y, t in rows for w in toxicity_kn.words_of(t) for k in toxicity_kn.grams(w))
    by, low = {}, {}
    for n in range(order, 0, -1):
        by[n] = {k: [raw[k, 0], raw[k, 1]] for k, _ in raw}
        if n < order:
            for k in by[n]:
                if not k.startswith(" "):
                    by[n][k] = [sum(1 for (g, c), v in longer.items() if c == y and v and g[1:] == k) for y in (0, 1)]
        longer, raw = raw, sum((Counter({(k[1:], y): v}) for (k, y), v in raw.items()), Counter()) if n > 1 else raw
    for n in range(1, order + 1):
        whole = [sum(c[y] for c in by[n].values()) for y in (0, 1)]
        scaled = {k: [c[y] * min(whole) / whole[y] for y in (0, 1)] for k, c in by[n].items()}
        low[n] = {}
        for k, own in scaled.items():
            after = [v for g, v in scaled.items() if g[:-1] == k[:-1]]
            mass = [sum(max(v[y] - cut, 0) for v in after) for y in (0, 1)]
            share = min(max(cut * len(after) / sum(map(sum, after)), least), 1) if min(mass) > 0 else 1
            back = low[n - 1][k[1:]] if n > 1 else [1 / len(scaled)] * 2
            low[n][k] = [(1 - share) * max(own[y] - cut, 0) / max(mass[y], 1e-9) + share * back[y] for y in (0, 1)]

    def ratio(key):
        return next((np.log(low[n][key[-n:]][1] / low[n][key[-n:]][0]) for n in range(order, 0, -1) if key[-n:] in low[n]), 0.0)

    return lambda word: sum(map(ratio, toxicity_kn.grams(word)))


def test_toxicity_counts_every_gram_and_letter(spark):
    """Ratios of words like those from all grams, by the head and by joins: letters 992 apart are not the same one."""
    far = chr(0x4E00), chr(0x4E00 + 992)
    rows = [(0, f"kind calm words {far[0] * 2} {'rare' if i else ''}") for i in range(4)] + [(1, f"vile nasty words {far[1] * 2} {'rarely' if i else ''}") for i in range(3)]
    counts = toxicity_kn.gram_counts(spark.createDataFrame(rows, "y int, text string"))
    tables = toxicity_kn._likelihoods(toxicity_kn._tables(counts))
    words = ["kind", "vile", "rare", "rarely", "kindly", "zzz", far[0], far[1] * 2]
    slow = _slow_ratios(rows)
    head = toxicity_kn._head(tables, 1 << 20)
    got = dict(zip(words, head.of_words([words])[0], strict=True))
    assert np.allclose([got[w] for w in words], [slow(w) for w in words], atol=1e-5)
    assert got[far[0]] < 0 < got[far[1] * 2]
    joined = dict(map(tuple, toxicity_kn.ratios(spark.createDataFrame([(w,) for w in words], "word string"), tables).collect()))
    assert np.allclose([joined[w] for w in words], [slow(w) for w in words], atol=1e-5)


def test_toxicity_does_not_depend_on_the_size_of_the_head(spark):
    docs, labels = _labelled(spark, "kind calm words here kindly", "vile nasty words there vilest", "toxic")
    odd = documents(spark, [*ODD, "kind", "vilest nasty", "unseen wörds", "vile " * 3000, "kind", "kind"]).selectExpr("*", "1 as evidence", "2 as row", "3 as rest")
    want = None
    for most in (1 << 20, 60, 5, 0):
        model = toxicity_kn.fit(docs, labels, "toxic", head_grams=most)
        assert sum(len(t[0]) for t in model.head.tables.values()) <= most
        scored = toxicity_kn.score(odd, model)
        assert scored.columns == [*odd.columns, "score"]
        got = {r["doc_id"]: r["score"] for r in scored.collect()}
        want = want or got
        assert len(got) == odd.count() and all(abs(got[k] - want[k]) < 1e-4 for k in want)
