"""Operators 2 and 9: held-out accuracy and edge cases."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgrove.llm import language_id, toxicity
from tests.llm.data import empty, table, texts


def labelled(spark):
    r = random.Random(4)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 8))) for _ in range(400)]
    bad = ["zqurv" + x for x in ("", "a", "os", "ix", "el", "un")]
    docs, labels = {}, []
    for k in range(400):
        own = [r.choice(words) for _ in range(r.randrange(20, 120))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                own[r.randrange(len(own))] = r.choice(bad)
        docs[k] = " ".join(own)
        labels.append((k, int(toxic)))
    return table(spark, docs | {1000: None, 1001: "", 1002: "..."}), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = toxicity.held_out_scores(docs, labels).join(labels, "doc_id", "left").collect()
    held = [r for r in got if r.held_out and r.toxic is not None]
    assert len(held) > 60 and all(0 <= r.score <= 1 for r in got)
    right = sum((r.predicted == 1) == (r.toxic == 1) for r in held)
    assert right / len(held) > 0.95
    assert len({round(r.score, 9) for r in got if r.doc_id >= 1000}) == 1
    assert all(r.predicted == int(r.score >= 0.3) for r in got)


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark)
    none = toxicity.score(docs, toxicity.fit(docs, labels.where("toxic > 1")))
    assert {(r.score, r.predicted) for r in none.collect()} == {(0.0, 0)}
    assert toxicity.score(empty(spark), toxicity.fit(docs, labels.where("toxic = 1"))).count() == 0
    assert toxicity.without_toxic(docs, labels.where("toxic = 0")).count() == docs.count()


def test_language(spark):
    r = random.Random(6)
    letters = {"aa": "abcdefg ", "bb": "hijklmn ", "cc": "éèüñßäö "}
    rows = [(k, "".join(r.choice(letters[lang]) for _ in range(r.randrange(30, 900))) + "x", lang) for k, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(900, None, "aa"), (901, "", None), (902, "123 ... !", "bb"), (903, "abc abd", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language_id.held_out_predictions(docs).collect()}
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    held = [k for k, _, _ in rows if k < 900 and got[k].held_out]
    assert sum(got[k].lang_pred == ["aa", "bb", "cc"][k % 3] for k in held) / len(held) > 0.97
    assert language_id.predict(docs.where("doc_id < 0"), language_id.Network(["aa"])).count() == 0
    untaught = language_id.predict(docs, language_id.fit(docs, F.lit(False)))
    assert {r.lang_pred for r in untaught.collect()} == {"und"}


def test_windows_cover_whole_texts():
    data = bytes(range(1, 250)) * 9
    windows = language_id.windows_of(data)
    hop = language_id.WINDOW - language_id.WIDEST + 1
    assert b"".join(w.tobytes()[:hop] for w in windows[:-1]) + windows[-1].tobytes().rstrip(b"\0") == data
    assert len(texts()) > 60


def plain_stream(text):
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    return " " * (toxicity.SHAPE.order - 1) + "".join(w + " " for w in letters)


def plain_differences(rows):
    """Every gram's and every context's difference by the formulas of interpolated Kneser-Ney, in plain Python."""
    order = toxicity.SHAPE.order
    counts = {0: Counter(), 1: Counter()}
    for text, toxic in rows:
        s = plain_stream(text)
        counts[toxic].update(s[i : i + order] for i in range(len(s) - order + 1))
    grams = set(counts[0]) | set(counts[1])

    def discount(values):
        ones, twos = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5

    kinds, levels = grams, {}
    for size in range(order - 1, 0, -1):
        levels[size] = Counter(g[1 : size + 1] for g in kinds)
        kinds = set(levels[size])
    p = {}
    for size in range(1, order):
        d, n, total, seen = discount(levels[size].values()), levels[size], Counter(), Counter()
        for g, k in n.items():
            total[g[:-1]] += k
            seen[g[:-1]] += 1
        for g, k in n.items():
            lower = p[g[1:]] if size > 1 else 1 / (seen[""] + 1)
            p[g] = (max(k - d, 0) + d * seen[g[:-1]] * lower) / total[g[:-1]]
    side = {}
    for c in (0, 1):
        d, total, seen = discount(counts[c].values()), Counter(), Counter()
        for g, k in counts[c].items():
            total[g[:-1]] += k
            seen[g[:-1]] += 1
        left = {g[:-1]: d * seen[g[:-1]] / total[g[:-1]] if total[g[:-1]] else 1.0 for g in grams}
        side[c] = {g: (max(counts[c][g] - d, 0) / total[g[:-1]] if total[g[:-1]] else 0.0) + left[g[:-1]] * p[g[1:]] for g in grams}, left
    return {g: math.log(side[1][0][g] / side[0][0][g]) for g in grams}, {x: math.log(side[1][1][x] / side[0][1][x]) for x in side[0][1]}


def test_kneser_ney_equals_the_formulas(spark):
    rows = [("You zqurv fool, go away!", 1), ("zqurva  zqurv\n\n", 1), ("Go away now, said the fool", 0), ("été 12 an old tale", 0), ("an old an old tale", 0), (None, 0), ("...", 1)]
    grams = toxicity.gram_counts(spark.createDataFrame([(t, y, False) for t, y in rows], "text string, toxic int, apart boolean"), toxicity.SHAPE.order)
    seen, unseen = toxicity.differences(grams, toxicity.SHAPE.order)
    want_seen, want_unseen = plain_differences(rows)
    for got, want, key in ((seen, want_seen, "gram"), (unseen, want_unseen, "context")):
        found = {r[key]: r.d for r in got.collect()}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    block = toxicity.tables(grams, toxicity.SHAPE.order)[0].value
    text = "the fool went away, qzurv!"
    s, n = plain_stream(text), toxicity.SHAPE.order
    plain = [want_seen.get(s[i : i + n], want_unseen.get(s[i : i + n - 1], 0.0)) for i in range(len(s) - n + 1)]
    assert np.allclose(block.differences(toxicity.streams([text], toxicity.SHAPE.order)[0]), plain, atol=1e-6)


def plain_features(d, shape):
    """The means of the strongest runs, found one by one, of the whole and the log length."""
    runs = lambda n: [(sum(d[i : i + n]), i) for i in range(max(1, len(d) - n + 1))]
    found, taken = [], []
    while len(found) < max(shape.strongest):
        left = [(x, -i) for x, i in runs(shape.run) if all(abs(i - j) >= shape.run for j in taken)]
        if not left or max(left)[0] <= 0:
            break
        x, i = max(left)
        found.append(x)
        taken.append(-i)
    return [sum(found[:n]) / (shape.run * n) for n in shape.strongest] + [max(x for x, _ in runs(n)) / n for n in shape.runs] + [sum(d) / max(1, len(d)), math.log(len(d) + 10)]


@pytest.mark.parametrize("shape", [toxicity.SHAPE, toxicity.Shape(3, 4, (1, 3), (8,))])
def test_scores_equal_a_plain_version(spark, shape):
    """Differences, features and the curve in plain Python, with the weights that the model has."""
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels, shape=shape)
    block = model.blocks[0].value
    some = docs.where("doc_id % 7 = 0").union(table(spark, {3000: None, 3001: "", 3002: "x", 3003: "zqurv " * 40, 3004: "12 ..."}))
    for r in toxicity.score(some, model).collect():
        d = block.differences(toxicity.streams([r.text], shape.order)[0]).astype(float).tolist()
        x = [(f - m) / s for f, m, s in zip(plain_features(d, shape), *model.scale.tolist(), strict=True)] + [1.0]
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(x, model.weights.tolist(), strict=True))))))
        assert abs(r.score - want) < 1e-5 and r.predicted == int(r.score >= 0.3)


def test_the_shape_is_chosen_on_learning_rows(spark):
    """Folds of the learning rows rank the shapes; labels of other rows change nothing."""
    docs, labels = labelled(spark)
    shapes, fold = [toxicity.SHAPE, toxicity.Shape(2, 4, (1,), (8,))], toxicity.fold(F.col("doc_id"), 4)
    learn = fold != 2
    got = toxicity.choose(docs, labels, shapes, learn, fold, [0, 1])
    assert {s for _, s in got} == set(shapes) and 0.5 < got[1][0] <= got[0][0] <= 1
    turned = labels.withColumn("toxic", F.when(fold == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    assert toxicity.choose(docs, turned, shapes[:1], learn, fold, [0, 1])[0][0] == dict((s, a) for a, s in got)[shapes[0]]
    scored = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.9, 1)], "score double, toxic int")
    assert toxicity.area(scored) == (2 + 1.5) / 4


def test_blocks_and_parts_of_texts_change_nothing(spark, monkeypatch):
    docs, labels = labelled(spark)
    docs = docs.union(table(spark, {2000: "zqurva " * 3 + "und ein langer text " * 3000}))
    want = {r.doc_id: r.score for r in toxicity.held_out_scores(docs, labels).collect()}
    monkeypatch.setattr(toxicity, "TABLE_ROWS", 900)
    got = {r.doc_id: r.score for r in toxicity.held_out_scores(docs, labels).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_evidence_crosses_spaces():
    one, two = toxicity.streams(["go away", "goaway"], 4), toxicity.streams(["Go -- away", None], 4)
    assert one[0].tolist()[: one[1][1]] == two[0].tolist()[: two[1][1]] != one[0].tolist()[one[1][1] :]
    d = np.zeros(100)
    d[10:16] = 1
    found = toxicity.features_of(d, toxicity.SHAPE)
    assert found[0] == 1 and abs(found[1] - 0.5) < 1e-12 and abs(found[len(toxicity.SHAPE.strongest)] - 0.5) < 1e-12 and abs(found[-2] - 0.06) < 1e-12


def test_only_letters_have_a_language(spark):
    network = language_id.Network(["aa", "bb"])
    assert network.predict(["²", "½ 3", "①", "Ⅷ", "", None, "x", "1é"])[0][:6] == ["und"] * 6
    assert "und" not in network.predict(["x", "1é"])[0]


def test_network_equals_plain_sums():
    """Log-probabilities of windows, and their weighted means, by plain loops."""
    network, text = language_id.Network(["aa", "bb", "cc"], 3), "Ein Text, der länger ist. " * 14 + "123 456 " * 30
    p, windows = network.p, language_id.windows_of(text.encode())
    z = np.zeros((len(windows), 3))
    for k, window in enumerate(windows):
        pooled = []
        for f in range(language_id.FILTERS * len(language_id.WIDTHS)):
            width = language_id.WIDTHS[f // language_id.FILTERS]
            places = range(language_id.WINDOW - language_id.WIDEST + 1)
            pooled.append(max(sum(float(p["embed"][window[i + j]] @ p["kernel"][j, :, f]) for j in range(width)) for i in places) + p["bias"][f])
        y = np.maximum(pooled, 0) @ p["out"] + p["out_bias"]
        z[k] = y - math.log(np.exp(y).sum())
    weights = np.array([sum(chr(b).isascii() and chr(b).isalpha() or b > 127 for b in w.tolist()) for w in windows])
    mean = np.exp((z * weights[:, None]).sum(0) / weights.sum())
    names, scores = network.predict([text])
    assert names == [network.languages[int(mean.argmax())]] and abs(scores[0] - mean.max() / mean.sum()) < 1e-4


def test_rare_languages_are_learned(spark):
    letters = {"aa": "abcdefg ", "bb": "hijklmn "}
    r = random.Random(2)
    rows = [(k, "".join(r.choice(letters["bb" if k in (6, 12) else "aa"]) for _ in range(300)), "bb" if k in (6, 12) else "aa") for k in range(300)]
    assert language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True)).languages == ["aa", "bb"]
