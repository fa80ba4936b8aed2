"""op1, op4 and the pipeline: against brute force, and SQL where there is some."""

import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loglake import scratch
from loglake.llm import common, components, jaccard, registry, url_filter
from loglake.llm.common import materialise

from .conftest import prose

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


class Sets:
    """Union-find."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, sim):
    """Component of each (id, text), ids distinct."""
    sets = {i: shingles(t, sim.k) for i, t in rows}
    ids, f = sorted(sets), Sets()
    for x, a in enumerate(ids):
        f.find(a)
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sim.den * common >= sim.num * (len(sets[a]) + len(sets[b]) - common):
                f.join(a, b)
    return {i: f.find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def chained(r, n, length, change):
    """Texts of which each is the one before with some words changed: links chain through the group."""
    w = prose(r, length, WORDS).split()
    out = []
    for _ in range(n):
        w = list(w)
        for _ in range(change):
            w[r.randrange(len(w))] = r.choice(WORDS)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("sim", [jaccard.CONTRACT, jaccard.PIPELINE])
def test_join_equals_brute_force(spark, sim):
    r = random.Random(sim.k)
    texts = []
    for length, change in ((3, 1), (5, 0), (8, 1), (14, 1), (30, 1), (60, 1), (120, 2), (300, 4), (900, 9)):
        texts += chained(r, 25, length, change)
    texts += [prose(r, r.randrange(1, 200), WORDS) for _ in range(100)] + texts[:20] + [t.upper() for t in texts[20:30]] + ["", " ", None]
    passage = prose(r, 60, WORDS)
    texts += [prose(r, 80, WORDS) + " " + passage for _ in range(30)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, set int, component string").repartition(5)
    want, sizes = brute(rows, sim)
    got = jaccard.classes(docs, sim).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == want and {x["doc_id"]: x["n_shingles"] for x in got} == sizes
    kept = jaccard.representatives(docs, sim)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted(i for i, c in want.items() if i == c)


def test_blocks_and_small_tasks_find_the_same(spark, monkeypatch):
    """Groups of more than a block, cells held a few at a time."""
    r = random.Random(9)
    rows = list(enumerate(chained(r, 120, 60, 1)))
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    monkeypatch.setattr(jaccard, "SKETCH_BLOCK_SETS", 30)
    monkeypatch.setattr(jaccard, "HELD_CELLS", 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x["doc_id"]: x["component_id"] for x in jaccard.classes(docs, jaccard.CONTRACT).collect()} == brute(rows, jaccard.CONTRACT)[0]


def test_every_linked_pair_shares_a_cell():
    r = random.Random(1)
    for sim in (jaccard.CONTRACT, jaccard.PIPELINE):
        for n in (7, 9, 12, 20, 37, 80, 200, 511, 1500):
            for _ in range(15):
                a = {r.randrange(1 << 64) for _ in range(n)}
                drop = r.randrange(0, sim.difference(n, n) // 2 + 1)
                b = set(list(a)[drop:]) | {r.randrange(1 << 64) for _ in range(r.randrange(0, drop + 2))}
                if sim.den * len(a & b) < sim.num * len(a | b) or a == b:
                    continue
                h = np.array(sorted(a) + sorted(b), np.uint64)
                key, of = jaccard.emitted(h, np.array([0, len(a), len(a) + len(b)]), sim)
                assert set(key[of == 0].tolist()) & set(key[of == 1].tolist()), (n, len(a), len(b), len(a & b))


def test_sketches_bound_the_difference_from_below():
    r = random.Random(6)
    for n in (3, 30, 47, 48, 100, 191, 200, 900):
        a = {r.randrange(1 << 64) for _ in range(n)}
        b = set(list(a)[: n - n // 9]) | {r.randrange(1 << 64) for _ in range(n // 9 + 3)}
        x, y = (jaccard.sketched(np.array(sorted(s), np.uint64)) for s in (a, b))
        while len(x) != len(y):
            x, y = (x, y[::2] ^ y[1::2]) if len(y) > len(x) else (x[::2] ^ x[1::2], y)
        assert np.bitwise_count(x ^ y).sum() <= len(a ^ b)


def test_join_on_awkward_rows(awkward, nothing):
    got = jaccard.classes(awkward, jaccard.CONTRACT).collect()
    assert len(got) == awkward.count()
    by = defaultdict(set)
    for x in got:
        by[x["doc_id"]].add((x["n_shingles"], x["component_id"]))
    assert by[0] == {(0, 0)} and by[1] == {(0, 1)} and by[6] == {(1, 6)} and by[7] == {(1, 6)} and by[8] == {(2, 8)}
    assert {c for _, c in by[101]} == {101}
    assert jaccard.classes(nothing, jaccard.CONTRACT).count() == 0 and jaccard.representatives(nothing, jaccard.CONTRACT).count() == 0
    kept = jaccard.representatives(awkward, jaccard.CONTRACT)
    assert kept.columns == awkward.columns and kept.where("doc_id = 101").count() == 2 and kept.where("doc_id = 7").count() == 0


def test_one_row_of_each_group_whatever_the_ids(spark):
    """Ids null, repeated, on near copies and on rows of several groups: one row of each group stays."""
    r = random.Random(11)
    texts = []
    for _ in range(12):
        texts += chained(r, 10, 60, 1)
    texts += texts[::7] + [t.upper() for t in texts[::9]] + [prose(r, 50, WORDS) for _ in range(10)]
    rows = [(k, r.choice([None, None, 3, 4, 5, 1000 + k]), t) for k, t in enumerate(texts)]
    rows += [(len(rows) + i, None, t) for i, t in enumerate(chained(r, 6, 60, 1))]  # a group without ids
    docs = spark.createDataFrame(rows, "set long, doc_id long, text string").repartition(5)
    got = jaccard.representatives(docs, jaccard.PIPELINE)
    assert got.columns == docs.columns
    of, _ = brute([(k, t) for k, _, t in rows], jaccard.PIPELINE)
    ids = defaultdict(list)
    for k, i, _ in rows:
        ids[of[k]].append(i)
    kept = [tuple(x) for x in got.collect()]
    assert sorted(of[k] for k, _, _ in kept) == sorted(ids) and set(kept) <= set(rows)
    for k, i, _ in kept:
        assert i == min((x for x in ids[of[k]] if x is not None), default=None)
    blank = spark.createDataFrame([(0, None, ""), (1, None, ""), (2, None, None), (3, 3, " "), (4, 4, "one")], docs.schema)
    assert jaccard.representatives(blank, jaccard.PIPELINE).count() == 5


@pytest.mark.parametrize("last", [0, 40, 500_000])
def test_components(spark, last):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(300) if i % 50 != 49] + [(1000, 1000 + r.randrange(1, 200)) for _ in range(200)] + [(5, 5), (3, 2)]
    f = Sets()
    for a, b in edges:
        f.join(a, b)
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "u long, v long").repartition(6), last=last).collect()}
    same = defaultdict(set)
    for n, c in got.items():
        same[c].add(n)
    want = defaultdict(set)
    for n in f.up:
        want[f.find(n)].add(n)
    assert sorted(map(sorted, same.values())) == sorted(map(sorted, want.values()))
    u, v = components.forest(np.array([x[0] for x in edges]), np.array([x[1] for x in edges]))
    g = Sets()
    for a, b in zip(u.tolist(), v.tolist()):
        g.join(a, b)
    assert all(g.find(n) == f.find(n) for n in f.up)


def test_materialise_survives_in_the_shared_folder(spark):
    df = materialise(spark.range(10), "x")
    assert df.inputFiles()[0].startswith("file:") and df.count() == 10
    made = []

    def make():
        made.append(materialise(spark.range(5), "inner"))
        return made[0].where("id > 1")

    with common.temporaries(spark):
        out = common.settled(spark, "outer", make)
        assert out.count() == 3 and not os.path.exists(made[0].inputFiles()[0][7:])
        at = out.inputFiles()[0][7:]
    assert not os.path.exists(at) and df.count() == 10


def test_no_folder_of_one_machine_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda k, d=None: None)

        class sparkContext:
            master = "local-cluster[2,1,1024]"

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session)


@pytest.mark.parametrize("least", [3, 10_000])
def test_joined_is_a_left_join_whatever_the_crowd(spark, monkeypatch, least):
    monkeypatch.setattr(common, "LEAST_CROWD", least)
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(["a"] * 50 + ["b"] * 2 + ["c"] * 9 + [None] * 6 + ["d"])], "i int, k string")
    side = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("d", 4, "z"), ("e", 5, "w")], "k string, v int, w string")
    got = common.joined(rows, side, "k")
    assert got.columns == ["i", "k", "v", "w"] and sorted(map(str, got.collect())) == sorted(map(str, rows.join(side, "k", "left").select("i", "k", "v", "w").collect()))


# ---- op4 ----

PAGES = [
    ("http://a.org/x", '<a href="http://friend.net/">f</a> <a HREF=\'//FRIEND.net/2\'>'), ("https://good.com/fr/1?q#z", '<a href="https://friend.net/p">'), ("http://bad.com/de/1", None), ("http://bad.com/x", ""),
    ("http://farm.net/1", '<a href="http://bad.com/de/2"> <a href="http://bad.com/3">'), ("http://friend.net/a", "<a href='/local'>"), ("http://lonely.net", ""), ("HTTP://WWW.Example.ORG/en/12", ""), ("http://example.org/es/", ""),
    ("http://example.org/esx", ""), ("http://notexample.org/es/", ""), ("http://com/fr/", ""), ("no url", ""), (None, ""), ("x://", ""), ("http://h.net?x=/fr/", ""), ("http://h.net#a", ""), ("http://com.net/fr/a", ""), ("http://a.org/x", ""),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, h, "rule", 1.0) for i, (u, h) in enumerate(PAGES)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, rule string, host double")


def test_rules_and_hosts(pages):
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got[0] == ("a.org", "/x", "org/", "allow") and got[1] == ("good.com", "/fr/1", "com/fr/", "allow") and got[2][2:] == ("com/de/", "block")
    assert got[3] == ("bad.com", "/x", None, "block") and got[4][2:] == (None, "block") and got[5][2:] == (None, "allow") and got[6] == ("lonely.net", "", None, "allow")
    assert got[7] == ("www.example.org", "/en/12", "example.org/en/1", "block") and got[8][2:] == ("example.org/es/", "block") and got[9][2:] == ("org/", "allow") and got[10][2:] == ("org/", "allow")
    assert got[11][2:] == ("com/fr/", "allow") and got[12] == got[13] == got[14] == ("", "", None, "block") and got[15][:2] == ("h.net", "") and got[17][2] is None


def test_url_filter_equals_sql(spark, pages):
    duckdb = pytest.importorskip("duckdb")
    frame = pages.select("page_id", "url", "html").toPandas()  # noqa: F841
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT * FROM frame")
    want = sorted(map(str, con.execute(registry.ORACLES["op4_url_filter"]).fetchall()))
    assert sorted(str(tuple(r)) for r in url_filter.judge(pages).collect()) == want
    assert url_filter.judge(pages.where("false")).count() == 0


def plain_scores(links, start, damping=url_filter.DAMPING):
    """Personalised PageRank of both kinds by dense algebra; what a host without links onward has goes back to the start."""
    hosts = sorted({h for x in links for h in x} | {h for _, h in start})
    at = {h: i for i, h in enumerate(hosts)}
    out = {}
    for kind in {k for k, _ in start}:
        m = np.zeros((len(hosts), len(hosts)))
        for (s, t), w in links.items():
            m[(at[t], at[s]) if kind == "trust" else (at[s], at[t])] = w
        v = np.array([start.get((kind, h), 0.0) for h in hosts])
        if kind == "distrust":
            m = m / np.maximum(m.sum(0, keepdims=True), 1e-300)
        m[:, m.sum(0) == 0] = v[:, None]
        x = np.linalg.solve(np.eye(len(hosts)) - damping * m, (1 - damping) * v)
        out |= {(kind, h): x[at[h]] for h in hosts}
    return out


@pytest.mark.parametrize("crowd", [10_000, 2])
def test_scores_equal_personalised_pagerank(spark, monkeypatch, crowd):
    """Also with hosts that count as crowded, whose links are dealt to salts."""
    monkeypatch.setattr(common, "LEAST_CROWD", crowd)
    if crowd < 10:
        monkeypatch.setattr(common, "CROWDED", 20)
    r = random.Random(4)
    links = sorted({(f"h{r.randrange(12)}", f"h{r.randrange(12)}") for _ in range(40)} | {("hub", f"h{i}") for i in range(12)} | {(f"h{i}", "end") for i in range(0, 12, 3)})
    links = [x for x in links if x[0] != x[1]]
    share = {x: 1 / sum(y[0] == x[0] for y in links) for x in links}
    start = {("trust", "h1"): 0.5, ("trust", "hub"): 0.5, ("distrust", "h2"): 0.25, ("distrust", "end"): 0.75}
    got = url_filter.propagate(spark.createDataFrame([(*k, v) for k, v in start.items()], "kind string, host string, start double"), spark.createDataFrame([(*k, v) for k, v in share.items()], "source string, target string, share double"))
    got = {(x["kind"], x["host"]): x["score"] for x in got.collect()}
    for k, v in plain_scores(share, start).items():
        assert abs(got.get(k, 0.0) - v) < 3 * url_filter.TOLERANCE, k


def linked_pages(n=30):
    """Chains of hosts, one page each: to a blocked host, and from a trusted one; then both ends in a ring."""
    page = lambda h, *to: (f"http://{h}/x", "".join(f'<a href="http://{t}/">' for t in to))
    rows = [("http://bad.com/de/1", ""), page("good.org", "t1.net")]
    rows += [page(f"c{i}.net", f"c{i - 1}.net" if i > 1 else "bad.com") for i in range(1, n)]
    rows += [page(f"t{i}.net", f"t{i + 1}.net") for i in range(1, n)]
    return rows + [page("ring1.net", "ring2.net", "bad.com"), page("ring2.net", "ring1.net"), page("alone.net", "t5.net")]


def test_trust_and_distrust_go_all_the_way(spark):
    """Twenty-nine links off a seed, hosts still have its score: no cut after some rounds."""
    rows = [(i, u, h) for i, (u, h) in enumerate(linked_pages())]
    got = {r["host"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[f"c{i}.net"] == "block" for i in range(1, 30)) and all(got[f"t{i}.net"] == "allow" for i in range(1, 30))
    assert got["ring1.net"] == got["ring2.net"] == "block" and got["alone.net"] == "allow"


@pytest.mark.parametrize("crowd", [10_000, 1])
def test_url_query_on_linked_pages_equals_sql(spark, tmp_path, monkeypatch, crowd):
    """The registered query over a table with links, repeated rows, a very long html and a host with most pages."""
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(common, "LEAST_CROWD", crowd)
    if crowd < 10:
        monkeypatch.setattr(common, "CROWDED", 8)
    rows = linked_pages(12) + PAGES + [("http://hot.net/p", None)] * 60 + [("http://hot.net/q", '<a href="http://friend.net/">')] * 3
    rows.append(("http://long.net/", "x " * 200_000 + '<a href="http://c3.net/">' + " y" * 200_000))
    rows = [(i, u, h, "k") for i, (u, h) in enumerate(rows)] + [(0, "http://good.org/x", '<a href="http://t1.net/">', None), (None, "http://c2.net/", None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, verdict string").repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.QUERIES["op4_url_filter"](spark, str(tmp_path))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(registry.ORACLES["op4_url_filter"]).fetchall()
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want))
    assert {r["host"]: r["verdict"] for r in got.collect()}["long.net"] == "block"


# ---- registry and pipeline ----


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, SF).select(*want.columns).toPandas()
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))


def test_registry_has_all_ten():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus with planted copies, insults, secrets and texts without letters."""
    r = random.Random(11)
    vocabulary = {"en": ["the", "thing", "other", "that", "wash", "with", "when", "where", "and"], "de": ["der", "über", "schön", "nicht", "auch", "zwölf", "noch"]}
    rows, labels = [], []
    for i in range(400):
        lang = "de" if i % 4 == 0 else "en"
        words = [w + s for w in vocabulary[lang] for s in ("", "a", "en", "ly", "ung")]
        w = prose(r, r.randrange(40, 150), words).split()
        bad = i % 8 == 3
        if bad:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["vilejerk", "dumbo"]))
        rows.append([i, " ".join(w), lang, "s", None])
        labels.append((i, 1, int(bad)))
    for i in range(0, 40, 2):  # copies and near copies
        rows.append([400 + i, rows[i][1], rows[i][2], "t", None])
        rows.append([401 + i, rows[i][1] + " oneword", rows[i][2], "t", None])
    rows.append([500, "password = 0123456789abcdef01234567 " + rows[1][1][::-1], "en", "s", None])
    rows.append([501, "12 34 56 !!", "en", "s", None])
    rows.append([502, None, None, None, None])
    for x in rows:
        x[4] = len(x[1] or "")
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, corpus), name)
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()}
    toxic = {i for i in range(400) if i % 8 == 3}
    assert set(first) - set(kept["toxicity"]) == toxic
    assert set(kept["toxicity"]) - set(kept["language"]) == {501, 502}
    want, _ = brute(list(kept["language"].items()), jaccard.PIPELINE)
    assert set(kept["near_copies"]) == {i for i, c in want.items() if i == c} and not set(kept["near_copies"]) & set(range(400, 440))
    changed = {i for i, t in kept["secrets"].items() if t != first[i]}
    assert changed == {500} and "0123456789abcdef" not in kept["secrets"][500]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, corpus).collect()
    assert {r["doc_id"] for r in pieces} == set(kept["secrets"])


def test_run_and_an_empty_corpus(spark, corpus, tmp_path):
    rows = corpus_pipeline.run(spark, corpus).collect()
    per = defaultdict(int)
    for r in rows:
        per[r["doc_id"]] += r["length"]
    assert all(per[r["doc_id"]] == r["doc_tokens"] for r in rows)
    for t in ("documents", "labels"):
        spark.read.parquet(f"{corpus}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_awkward_rows(spark, awkward, corpus):
    docs = awkward.withColumn("n_chars", F.length("text"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, corpus), name)
    assert docs.columns == [*awkward.columns, "n_chars"]
    corpus_pipeline.STAGES[-1][1](spark, docs, corpus).collect()
