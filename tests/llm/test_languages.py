"""Language identification against plain features and votes, its accuracy on texts it has not seen, and odd rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.llm import language_id
from tastegrid.llm.common import table
from tastegrid.llm.quality_classifier import held_out
from tastegrid.llm.queries import QUERIES
from tastegrid.llm.shingles import mixed

SF = "/root/testdata/sf0.001"


def plain_counts(text):
    """Runs of one to four bytes of the text between blanks, without two blanks in a row, and their columns."""
    low = bytes(c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in text.encode())
    low = b" " + bytes(c + 32 if 0x80 <= c <= 0x9E and c != 0x97 and i and low[i - 1] == 0xC3 else c for i, c in enumerate(low)) + b" "
    out = Counter()
    for n in range(1, 5):
        for i in range(len(low) - n + 1):
            g = low[i : i + n]
            if b"  " in g or n == 1 and g == b" ":
                continue
            value = 0
            for c in g:
                value = (value * 257 + c + 1) % 2**64
            out[int(mixed(np.array([(value * 4 + n - 1) % 2**64], dtype=np.uint64))[0]) % language_id.COLUMNS] += 1
    return out


def plain_prediction(text, model):
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    counts = plain_counts(text)
    norm = math.sqrt(sum(math.log1p(n) ** 2 for n in counts.values())) or 1
    margin = lambda w: w[-1] + sum(math.log1p(n) / norm * w[c] for c, n in counts.items())
    m = [margin(w) for w in model.between]
    k = max(range(len(m)), key=lambda i: m[i])
    sure = 1 / sum(math.exp(language_id.STEEPNESS * (x - m[k])) for x in m)
    members = model.families[model.names[k]]
    pairs = {(a, b): margin(model.within[a, b]) for n, a in enumerate(members) for b in members[n + 1 :]}
    pairs |= {(b, a): -v for (a, b), v in pairs.items()}
    best = max(members, key=lambda a: (sum(pairs[a, b] > 0 for b in members if b != a), sum(pairs[a, b] for b in members if b != a)))
    trust = [1 / (1 + math.exp(-language_id.STEEPNESS * pairs[best, b])) for b in members if b != best]
    return model.languages[best], sure * (sum(trust) / len(trust) if trust else 1)


def test_counts_are_those_of_the_text(monkeypatch):
    texts = ["Die Straße, 12 ÄÖÜ × ÷ und die", "", "a", "the the  the\n\tTHE", "漢字かな", "ÉCOLE école", "x1y2"]
    got = language_id.feature_counts([t.encode() for t in texts])
    for t, row in zip(texts, got, strict=True):
        assert {c: int(row[c]) for c in np.flatnonzero(row)} == dict(plain_counts(t))
    long = "la maison est belle " * 500
    monkeypatch.setattr(language_id, "PIECE", 1000)
    cut = language_id.feature_counts([long.encode()])[0]
    assert abs(cut.sum() - sum(plain_counts(long).values())) <= 10 * len(long) // 1000


def test_every_document_against_a_plain_version(spark):
    """The whole table, every prediction and score by the same machines; and how many are right of those not learned from."""
    docs = table(spark, SF, "documents")
    model = language_id.fit(docs.filter(~held_out()))
    assert model.languages == ["de", "en", "es", "fr"] and model.names == ["germanic", "romance"] and len(model.within) == 2
    got = {r["doc_id"]: r for r in QUERIES["op13_language_id"](spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        code, score = plain_prediction(r["text"], model)
        assert got[r["doc_id"]]["lang_pred"] == code and abs(got[r["doc_id"]]["score"] - score) < 1e-4
    unseen = [(r["lang"], got[r["doc_id"]]["lang_pred"]) for r in rows if got[r["doc_id"]]["held_out"]]
    assert len(unseen) > 30 and sum(a == b for a, b in unseen) >= 0.97 * len(unseen)


def test_machine_separates_and_maximises_the_margin():
    """Two points on an axis, then a problem whose optimum is found by plain gradient steps."""
    w = language_id.machine(np.array([[1.0], [-1.0]]), np.array([True, False]), passes=200, cost=1e6)
    assert abs(w[0] - 1) < 1e-3 and abs(w[1]) < 1e-3
    rnd = np.random.default_rng(1)
    x, y = rnd.normal(size=(60, 3)), rnd.random(60) < 0.3
    y |= x[:, 0] > 0.5
    rows, sign = np.hstack((x, np.ones((60, 1)))), np.where(y, 1.0, -1.0)
    c = 2 / (2 * np.where(y, y.mean(), 1 - y.mean()))
    loss = lambda w: w @ w / 2 + (c * np.maximum(0, 1 - sign * (rows @ w)) ** 2).sum()
    plain = np.zeros(4)
    for _ in range(20_000):
        plain -= 1e-3 * (plain - 2 * (c * sign * np.maximum(0, 1 - sign * (rows @ plain))) @ rows)
    assert loss(language_id.machine(x, y, passes=300, cost=2.0)) <= loss(plain) * 1.001


def test_odd_rows(spark):
    learn = [(i, t, c) for i, (t, c) in enumerate([("the house and the garden", "en"), ("das haus und der garten", "de"), ("la maison et le jardin", "fr"), ("la casa y el jardin", "es"), ("ka hale a me ka mala", "haw")] * 12)]
    model = language_id.fit(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    assert model.names == ["germanic", "only haw", "romance"]
    rows = [(1, None), (2, ""), (3, "12 !? 34"), (4, "the garden and the house"), (4, "the garden and the house"), (None, "der garten und das haus"), (5, "漢字"), (6, "el jardin y la casa " * 40_000), (7, "\n"), (8, "9" * 100 + "é"), (9, "ka mala"), (10, "_^[]")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("score", "lang_pred", "_language", "digest")})
    got = language_id.predicted(df, model).collect()
    assert all(0 <= r["score"] <= 1 for r in got) and got[0]["digest"] == "own"
    of = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [of[i] for i in (1, 2, 3, 7, 10)] == ["und"] * 5 and of[4] == "en" and of[None] == "de" and of[6] == "es" and of[9] == "haw"
    assert of[5] in model.languages and of[8] in model.languages and len({tuple(r) for r in got if r["doc_id"] == 4}) == 1
    assert language_id.predicted(df.limit(0), model).count() == 0


def test_nothing_or_one_to_learn(spark):
    docs = spark.createDataFrame([(i, "some text", None) for i in range(9)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language_id.languages(docs).collect()} == {("und", 0.0)}
    assert language_id.languages(docs.limit(0)).count() == 0
    one = language_id.languages(docs.withColumn("lang", F.lit("eo")).withColumn("held_out", F.lit(1)))
    assert {(r["lang_pred"], r["score"]) for r in one.collect()} == {("eo", 1.0)}
    many = docs.crossJoin(spark.range(80)).withColumn("lang", F.concat(F.lit("l"), "id"))
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(many)


def test_the_sample_is_bounded_and_the_same_however_rows_lie(spark):
    docs = table(spark, SF, "documents")
    few = language_id.fit(docs.union(docs), sample=5)
    again = language_id.fit(docs.repartition(7).union(docs), sample=5)
    assert np.allclose(few.between, again.between) and all(np.allclose(few.within[k], again.within[k]) for k in few.within)
