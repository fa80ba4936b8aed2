"""op5, op6, op7, op8: base rules against a plain reading, models on held-out rows and made-up cases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loglake.llm import boosting, common, language, quality_model, quality_rules, toxicity
from loglake.llm.common import labelled_sample, raw, texts
from loglake.llm.kernels import Words
from loglake.llm.linear import Ftrl

from .conftest import AWKWARD, LONG, prose

TEXTS = [t or "" for t in AWKWARD] + [LONG, "a b c d e f g h " * 3, "x\nx", "é|é\té\x0bz", "\n\n a", "x\n", " x \n x \nx"]
SF = "/root/testdata/sf0.01"


def laid(many):
    col = texts(pa.array(many, pa.string()))
    return raw(col, 0, len(col))


def docs_and_labels(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


# ---- kernels ----


@pytest.mark.parametrize("fold", [False, True])
def test_words(fold):
    w = Words(*laid(TEXTS), fold=fold)
    got = [w.data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in TEXTS]
    assert got == [x for ws in want for x in ws] and w.counts.tolist() == list(map(len, want))
    names = [x.translate({i: i + 32 for i in range(65, 91)}) if fold else x for x in got]
    assert len(set(zip(names, w.hashes.tolist()))) == len(set(names)) == len(set(w.hashes.tolist()))


@pytest.mark.parametrize("k", [1, 4, 5])
def test_shingle_sets(k):
    h, first = Words(*laid(TEXTS), fold=True).shingle_sets(k)
    for t, a, b in zip(TEXTS, first, first[1:]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower() if t.isascii() else t)
        n = len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) if len(w) >= k else bool(w)
        assert b - a == n and (np.diff(h[a:b].astype(object)) > 0).all()


# ---- op5 ----


def plain_statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)]


def test_statistics():
    assert quality_rules.statistics(*laid(TEXTS))[:, :5].tolist() == [plain_statistics(t) for t in TEXTS]


def test_rules_on_awkward_rows(spark, awkward, nothing, no_labels):
    forest = quality_rules.fit(awkward, no_labels)
    got = quality_rules.judge(awkward, forest).collect()
    assert len(got) == awkward.count() and all(r["kept"] == (not r["base_failed"]) for r in got)
    assert all(r["base_failed"] for r in got if r["n_words"] < 20)
    assert quality_rules.judge(nothing, forest).count() == 0


def test_rules_learn(spark):
    docs, labels = docs_and_labels(spark)
    got = quality_rules.judge(docs, quality_rules.fit(docs, labels.where("doc_id % 3 > 0"))).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    seen = got[~got.base_failed]
    assert seen[seen.quality == 1].kept.mean() > 0.98 and got[got.quality == 0].kept.mean() < 0.2


def test_forest_is_monotone_and_equals_a_walk():
    r = np.random.default_rng(0)
    x = r.random((2000, 3))
    y = (r.random(2000) < np.clip(x[:, 0] - 0.3 * x[:, 1] + 0.3 * np.sin(9 * x[:, 2]), 0, 1)).astype(float)
    f = boosting.train(x, y, (1, -1, 0), trees=30)
    grid = np.repeat(r.random((50, 3)), 40, 0)
    for j, sign in ((0, 1), (1, -1)):
        g = grid.copy()
        g[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        assert (sign * np.diff(f.raw(g).reshape(50, 40), axis=1) >= -1e-9).all()

    def walk(row):
        total = f.base
        for n in f.roots:
            while f.feature[n] >= 0:
                n = f.left[n] if row[f.feature[n]] <= f.threshold[n] else f.right[n]
            total += f.value[n]
        return total

    assert np.allclose(f.raw(x[:50]), [walk(v) for v in x[:50]])
    p = f.probability(x)
    assert p[y == 1].mean() > p[y == 0].mean() + 0.05


# ---- op6 ----


def test_language_learns(spark):
    docs, _ = docs_and_labels(spark)
    held = F.col("doc_id") % 4 == 2
    model = language.fit(docs, keep=~held)
    got = language.predict(docs, model).join(docs.where(held).select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95 and got.score.between(0, 1).all()


def byte_grams(t):
    low = t.translate({i: i + 32 for i in range(65, 91)}).encode()
    return {low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)}


def plain_kernel(a, b):
    a, b = byte_grams(a), byte_grams(b)
    return len(a & b) / (len(a) * len(b)) ** 0.5 if a and b else 0.0


def test_kernel_is_normalised_set_overlap():
    marks = ["the cat sat", "the mat", "über ▁😀 é"]
    many = [*marks, "THE CAT SAT", "", "x", "th", *(t for t in TEXTS if t != LONG)]
    got = language.Landmarks.of(marks).kernel(language.distinct_grams(*laid(many)), len(many))
    assert np.allclose(got, [[plain_kernel(a, b) for b in marks] for a in many], atol=1e-6) and np.isclose(got[0, 0], 1)


def test_long_texts_in_blocks_have_the_same_ngrams(monkeypatch):
    many = ["abcabcx" * 9, "", "ab", "zyabc" * 5]
    want = language.distinct_grams(*laid(many))
    monkeypatch.setattr(language, "BLOCK", 7)
    assert all((a == c).all() and (b == d).all() for (a, b), (c, d) in zip(language.distinct_grams(*laid(many)), want))


def test_features_and_regression_equal_a_plain_reading(spark):
    """Nyström features and one-versus-rest ridge, by sets and dense algebra; landmarks are the first of each language."""
    docs, _ = docs_and_labels(spark)
    rows = docs.where("lang in ('en', 'de', 'fr')").orderBy("doc_id").limit(90).collect()
    many, lang = [r["text"] for r in rows], [r["lang"] for r in rows]
    names = sorted(set(lang))
    marks = [t for c in names for t in [x for x, y in zip(many, lang) if y == c][:5]]
    got = language.train(many, lang, 5)
    k = np.array([[plain_kernel(a, b) for b in marks] for a in marks])
    s, u = np.linalg.eigh(k)
    keep = s > 1e-6 * s.max()
    root = u[:, keep] @ np.diag(s[keep] ** -0.5) @ u[:, keep].T
    z = np.array([[plain_kernel(a, b) for b in marks] for a in many]) @ root
    want = np.zeros((len(many), len(names)))
    for c, name in enumerate(names):
        y = np.array([1.0 if x == name else -1.0 for x in lang])
        w = np.array([1 / lang.count(x) for x in lang])
        coefficients = np.linalg.solve(z.T @ (w[:, None] * z) + language.RIDGE / len(z) * np.eye(z.shape[1]), z.T @ (w * y))
        want[:, c] = z @ coefficients
    found, score, _ = got.predict(*laid(many))
    assert found == [names[i] for i in want.argmax(1)] and np.allclose(score, np.clip((want.max(1) + 1) / 2, 0, 1), atol=1e-3)


def test_language_sample_takes_every_language_and_each_id_once(spark):
    rows = [(1, "one id on many rows", "en")] * 300 + [(2, "zwei", "de"), (2, "zweite", "de"), (3, "drei", "de"), (None, "x", "fr"), (4, None, "fr"), (5, "cinq", "fr")] + [(i, f"text {i}", "en") for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    got = language.sampled(docs, 10).collect()
    assert len(got) == 10 == len({r["doc_id"] for r in got}) and {r["lang"] for r in got} == {"en", "de", "fr"}
    assert [r["text"] for r in got if r["doc_id"] == 2] == ["zwei"]
    again = language.sampled(docs.repartition(3), 10).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_language_sample_of_crowded_languages_is_the_first_by_hash(spark, monkeypatch):
    """Crowded languages are pruned before they are ordered; the sample is the one that a plain reading takes."""
    monkeypatch.setattr(common, "LEAST_CROWD", 200)
    monkeypatch.setattr(language, "OF_ONE", 40)
    ids = [(i, "xx") for i in range(5000)] + [(i, "yy") for i in range(5000, 5400)] + [(i, "zz") for i in range(5400, 5410)]
    docs = spark.createDataFrame([(i, f"text {i}", x) for i, x in ids], "doc_id long, text string, lang string").repartition(7)
    got = language.sampled(docs, 1000).collect()
    hashed = sorted((r["h"], r["doc_id"], r["lang"]) for r in docs.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).collect())
    want = [i for x in ("xx", "yy", "zz") for _, i, _ in [r for r in hashed if r[2] == x][:40]]
    assert sorted(r["doc_id"] for r in got) == sorted(want) and len(want) == 90


def test_labelled_sample_is_not_starved(spark):
    """Labels of unknown documents take no place; an id counts once, with its least text; sizes are bounded."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(5000)] + [(7, 0), (None, 1)], "doc_id long, quality int")
    rows = [(i * 100, f"text {i}") for i in range(50)] + [(7, "b"), (7, "a")] + [(9, "same")] * 200 + [(None, "x"), (11, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["text"], r["label"]) for r in labelled_sample(docs, labels, "quality", 100).collect()}
    assert len(got) == 52 and got[7] == ("a", 1.0) and got[9] == ("same", 1.0) and got[100] == ("text 1", 0.0)
    few = labelled_sample(docs, labels, "quality", 20).collect()
    assert len(few) == 20 and sorted(map(tuple, few)) == sorted(map(tuple, labelled_sample(docs.repartition(2), labels, "quality", 20).collect()))
    small = labelled_sample(docs, labels, "quality", 100, most_bytes=60).collect()
    assert 1 < len(small) < 20 and sum(len(r["text"]) for r in small) <= 60
    assert len(labelled_sample(docs, labels, "quality", 100, most_bytes=1).collect()) == 1


def test_language_on_awkward_rows(awkward, nothing):
    model = language.fit(awkward)
    got = language.predict(awkward, model).collect()
    assert len(got) == awkward.count()
    plain = {r["doc_id"]: r["text"] for r in awkward.collect()}
    for r in got:
        if r["doc_id"] not in (None, 101):
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in plain[r["doc_id"]] or ""))
    assert language.predict(awkward, language.fit(nothing)).where("lang_pred <> 'und' or score <> 0").count() == 0
    assert language.accept(awkward, model).columns == awkward.columns and language.accept(nothing, model).count() == 0


STRANGERS = [
    "今天天气很好,我们一起去公园散步,然后回家吃饭。", "天气很好", "Сегодня хорошая погода, и мы пошли гулять в парк, а потом вернулись домой ужинать.", "погода",
    "今日は天気がいいので公園を散歩してから家に帰って夕食を食べました。", "الطقس جميل اليوم لذلك ذهبنا في نزهة في الحديقة ثم عدنا إلى المنزل.", "오늘은 날씨가 좋아서 공원을 산책하고 집에 돌아와 저녁을 먹었습니다.",
    "Dzisiaj jest piękna pogoda, więc poszliśmy na spacer do parku, a potem wróciliśmy do domu na obiad.", "Tänään on kaunis ilma, joten menimme kävelylle puistoon ja palasimme sitten kotiin syömään.",
    "Bugün hava çok güzel, bu yüzden parkta yürüyüşe çıktık ve sonra akşam yemeği için eve döndük.", "xkq zvbt wrpl mnkd ghjt qwx zzkp vbn mtrk plkjh gfds xcvb",
]


def test_strangers_are_rejected_and_the_known_stay(spark):
    """Languages and scripts that are not learned go, short and long; held-out documents of the learned ones stay."""
    docs, _ = docs_and_labels(spark)
    held = F.col("doc_id") % 4 == 2
    model = language.fit(docs, keep=~held)
    rows = [(i, " ".join([t] * n)) for n in (1, 20) for i, t in enumerate(STRANGERS)]
    assert [r["text"][:40] for r in language.accept(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()] == []
    known = docs.where(held).where("text rlike '[a-zA-Z]'")
    assert language.accept(known, model).count() >= 0.99 * known.count()
    short = known.selectExpr("doc_id", "element_at(split(text, '[.]'), 1) as text").where("length(text) > 20")
    assert language.accept(short, model).count() >= 0.97 * short.count()
    assert language.accept(known, language.train([], [])).count() == 0


# ---- op7 ----


def test_quality_learns(spark):
    docs, labels = docs_and_labels(spark)
    model = quality_model.fit(docs, labels, keep=F.col("doc_id") % 5 != 0)
    got = quality_model.score(docs, model).join(labels.where("doc_id % 5 = 0"), "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95


def test_score_is_the_sparse_dot_product():
    many = [t for t in TEXTS if t != LONG]
    model = quality_model.Model(np.random.default_rng(0).normal(size=1 << quality_model.BITS).astype(np.float32), 0.3)
    rows = quality_model.rows(*laid(many))
    want = [1 / (1 + np.exp(-np.clip(0.3 + float(model.weights[at].astype(float) @ x), -35, 35))) for at, x in rows]
    assert np.allclose(model.scores(*laid(many)), want, rtol=1e-4)


def test_ftrl_finds_a_separating_feature():
    r = random.Random(0)
    rows = [(np.array(sorted({r.randrange(1, 50) for _ in range(5)} | ({0} if i % 2 else set()))), i % 2) for i in range(400)]
    m = Ftrl(50, l1=1.0).fit([(at, np.ones(len(at))) for at, _ in rows], np.array([y for _, y in rows], float))
    w = m.weights()
    assert w[0] > 1 and np.abs(w[1:]).max() < w[0] / 2 and (w == 0).any()


def test_quality_on_awkward_rows(awkward, nothing, no_labels):
    model = quality_model.fit(awkward, no_labels)
    got = quality_model.score(awkward, model).collect()
    assert len(got) == awkward.count() and all(r["score"] == 0.5 for r in got)
    assert quality_model.score(nothing, model).count() == 0


# ---- op8 ----


@pytest.fixture(scope="module")
def insults(spark):
    r = random.Random(5)
    words = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "no") for b in ("ka", "du", "fi", "pe", "sol")]
    rows = []
    for i in range(900):
        bad = i % 6 == 0
        w = prose(r, r.randrange(20, 200), words).split()
        if bad:
            for _ in range(r.randrange(2, 6)):
                w.insert(r.randrange(len(w)), r.choice(["vilejerk", "vilejerks", "dumbo", "rotter"]))
        rows.append((i, " ".join(w), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_learns(insults):
    labels = insults.select("doc_id", "toxic")
    chain = toxicity.fit(insults, labels.where("doc_id < 600"))
    got = toxicity.score(insults, chain).join(labels.where("doc_id >= 600").withColumnRenamed("toxic", "truth"), "doc_id").toPandas()
    assert got[got.truth == 1].toxic.mean() > 0.95 and got[got.truth == 0].toxic.mean() < 0.01
    kept = toxicity.accept(insults, chain)
    assert kept.columns == insults.columns and kept.where("toxic = 0").count() == 750 and kept.where("toxic = 1").count() < 10


def test_chain_feeds_earlier_probabilities():
    chain = toxicity.Chain(np.array([0]), np.zeros((3, 1)), np.array([[0, 0, 0], [1.0, 0, 0], [1.0, -2.0, 0]]), np.array([0.5, -1.0, 0.2]))
    p = chain.probabilities(*laid(["some words"]))[0]
    s = lambda v: 1 / (1 + np.exp(-v))
    a = s(0.5)
    b = s(-1 + toxicity.CHAIN * a)
    assert np.allclose(p, [a, b, s(0.2 + toxicity.CHAIN * (a - 2 * b))])


def plain_telling(rows, y):
    """Indices that are commoner among positive rows than chance allows, one index at a time."""
    share, out = sum(v > 0 for v in y) / len(y), set()
    share = min(max(share, 1e-6), 1 - 1e-6)
    for i in {int(x) for r in rows for x in r}:
        n = sum(i in set(r.tolist()) for r in rows)
        k = sum(i in set(r.tolist()) for r, v in zip(rows, y) if v > 0)
        g = 2 * ((k * np.log(k / (n * share)) if k else 0) + ((n - k) * np.log((n - k) / (n * (1 - share))) if n > k else 0))
        if k > n * share and g >= toxicity.EVIDENCE:
            out.add(i)
    return out


def small_insults():
    r = random.Random(8)
    many = [prose(r, 12, ["lo", "mi", "ta", "re"]) + (" vilejerk dumbo" if i % 4 == 0 else "") for i in range(120)]
    return toxicity.token_rows(many), np.array([[float(i % 4 == 0)] for i in range(120)])


def test_features_are_the_tokens_and_their_beginnings():
    rows = toxicity.token_rows(["Alpha alpha beta", "alphabet", "", "beta"])
    assert [len(r) for r in rows][2] == 0 and len(set(rows[0].tolist()) & set(rows[1].tolist())) == 2  # of 4 and 5 bytes
    assert set(rows[3].tolist()) < set(rows[0].tolist()) and len(rows[3]) == 1 + len(toxicity.PREFIXES)


def test_steps_equal_a_plain_reading():
    rows, y = small_insults()
    tells = plain_telling(rows, y[:, 0])
    assert set(np.flatnonzero(toxicity.telling(rows, y[:, 0])).tolist()) == tells and tells
    share = [len(tells & set(r.tolist())) / len(r) for r in rows]
    marked = [bool(v) and s > 0 for v, s in zip(y[:, 0], share)]
    middle = np.median([s for s, m in zip(share, marked) if m])
    want = [[m, m and s > middle, v] for m, s, v in zip(marked, share, y[:, 0])]
    assert toxicity.steps(rows, y).tolist() == np.array(want, float).tolist()


def test_out_of_fold_models_have_not_seen_the_fold():
    """Each row's probabilities are those of a chain trained from the other folds alone, whatever the own fold's labels are."""
    rows, y = small_insults()
    got = toxicity.out_of_fold(rows, y, toxicity.steps)
    fold = np.arange(len(rows)) % toxicity.FOLDS
    keep, held = np.flatnonzero(fold != 1), np.flatnonzero(fold == 1)
    aims = toxicity.steps([rows[i] for i in keep], y[keep])
    m = toxicity.link([rows[i] for i in keep], np.zeros((len(keep), 0)), aims[:, 0])
    w = m.weights()
    assert np.allclose(got[held, 0], [1 / (1 + np.exp(-(m.bias + w[rows[i]].sum()))) for i in held])
    changed = y.copy()
    changed[held] = 1 - changed[held]
    assert np.allclose(toxicity.out_of_fold(rows, changed, toxicity.steps)[held, 0], got[held, 0])
    assert got[(y[:, 0] > 0), 0].mean() > 0.9 > 0.1 > got[(y[:, 0] == 0), 0].mean()


def test_categories_of_the_labels(spark):
    """A labels table with columns of its own: insult, then threat, then toxic (either)."""
    r = random.Random(3)
    rows = []
    for i in range(600):
        w = prose(r, 30, ["lo", "mi", "ta", "re", "no", "fi"]).split()
        insult, threat = i % 6 == 0, i % 7 == 0
        w += ["vilejerk"] * insult + ["willhurtyou"] * threat
        r.shuffle(w)
        rows.append((i, " ".join(w), int(insult), int(threat), int(insult or threat)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, insult int, threat int, toxic int")
    names = ("insult", "threat", "toxic")
    chain = toxicity.fit(docs, docs.where("doc_id < 400"), categories=names)
    got = toxicity.score(docs, chain).toPandas().sort_values("doc_id")
    assert chain.categories == names and list(got.columns) == ["doc_id", "p_insult", "p_threat", "p_toxic", "score", "toxic"]
    for c, name in enumerate(names):
        truth = np.array([x[2 + c] for x in rows])[400:]
        assert (((got[f"p_{name}"].to_numpy() > 0.5)[400:]) == truth).mean() > 0.97
    assert chain.before[2, :2].max() > 0  # the verdict leans on a category before it


def test_toxicity_on_awkward_rows(awkward, nothing, no_labels):
    chain = toxicity.fit(awkward, no_labels)
    got = toxicity.score(awkward, chain).collect()
    assert len(got) == awkward.count() and not any(r["toxic"] for r in got)
    assert toxicity.accept(awkward, chain).count() == awkward.count() and toxicity.score(nothing, chain).count() == 0


def test_toxicity_of_labelled_documents(spark):
    docs, labels = docs_and_labels(spark)
    labels = labels.select("doc_id", "toxic")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).drop("score").join(labels.withColumnRenamed("toxic", "truth"), "doc_id").toPandas()
    assert got[got.truth == 0].toxic.mean() < 0.01
