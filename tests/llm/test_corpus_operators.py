"""Operators that compare texts with each other, and the pipeline."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from capstan.llm import decontaminate, jaccard, suffixes, urls
from capstan.llm.components import connected_components

from . import brute


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 3, "y") for i, t in rows], "doc_id long, text string, component_id string, n_shingles int, kept string")


def near_copies(r, groups=6, size=12, words=90):
    """Groups of copies with a few words changed, some exact copies, odd texts, repeated rows."""
    rows, k = [], 0
    for _ in range(groups):
        base = [f"w{r.randrange(5000)}" for _ in range(words)]
        for _ in range(size):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                t[r.randrange(words)] = f"n{r.randrange(10**6)}"
            rows.append((k, " ".join(t)))
            k += 1
    shared = " ".join(f"common{i}" for i in range(40))
    rows += [(k + i, shared + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(30))) for i in range(8)]
    k += 8
    rows += [(k, None), (k + 1, ""), (k + 2, "one"), (k + 3, "ONE"), (k + 4, "one two three"), (k + 5, " \n"), (k + 6, rows[0][1].upper()), (3, rows[3][1]), (4, "another text with the same id"), (None, rows[0][1]), (None, "all alone here now")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [{}, {"SMALL_GROUP": 1, "QUERY_BLOCK": 2, "BASE_BLOCK": 3, "HOT": 2, "MARKED": 64}, {"ROWS_AT_ONCE": 7, "PAIRS_AT_ONCE": 5, "SEEN": 4, "HOT": 1}])
def test_jaccard_components(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(jaccard, k, v)
    rows = near_copies(random.Random(len(limits)))
    got = jaccard.components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(g) for g in got), key=repr) == brute.components(rows)


def test_jaccard_of_words_that_cancel_and_of_long_texts(spark):
    a = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, a), (2, a.translate(str.maketrans("ab", "ba"))), (3, long), (4, long + " end"), (5, "v0 " + long)]
    got = jaccard.components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (2, 1, 2), (3, 59_997, 3), (4, 59_998, 3), (5, 59_998, 3)]


def test_jaccard_with_other_parameters_and_clashing_columns(spark):
    rows = near_copies(random.Random(21), groups=3, size=6)
    df = frame(spark, rows).withColumnsRenamed({"kept": "k1"}).withColumns({c: F.lit("u") for c in ("node", "prefix", "row", "group", "id", "K2")})
    out = jaccard.components(df, gram=5, percent=80)
    assert set(out.columns) == {*df.columns} - {"text"}
    got = out.select("doc_id", "n_shingles", "component_id").collect()
    want = brute.components(rows, 80, 5)
    assert sorted((tuple(g) for g in got), key=repr) == want
    assert {r["k1"] for r in out.collect()} == {"y"}


def test_jaccard_of_nothing(spark):
    assert jaccard.components(frame(spark, [])).count() == 0


def test_overlap_bound_is_never_low():
    r = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(r.integers(0, 2**63, r.integers(1, 300), dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.9], r.integers(0, 2**63, 5, dtype=np.uint64)]))
        assert jaccard.overlap_bound(jaccard.range_counts(a), jaccard.range_counts(b)) >= len(np.intersect1d(a, b))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "src long, dst long")
    got = {r["node"]: r["label"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("limits", [{}, {"MANY_SEGMENTS": 2, "SHARD_BYTES": 500}, {"TASK_ROWS": 3, "BLOCK": 150}])
def test_repeated_bytes(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(suffixes, k, v)
    r = random.Random(4)
    letters = "abé \n"
    passages = ["".join(r.choice(letters) for _ in range(r.randint(90, 160))) for _ in range(4)]
    rows = [(i, "".join(r.choice(passages) if r.random() < 0.6 else "".join(r.choice("cdefgh") for _ in range(r.randint(1, 60))) for _ in range(r.randint(0, 5)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "a" * 350), (53, "ab" * 60), (54, rows[3][1]), (5, rows[5][1]), (None, passages[0]), (55, "\0" * 130)]
    got = suffixes.deduplicate(frame(spark, rows)).collect()
    ours = sorted(((g["doc_id"], g["n_bytes"], sum(x["end"] - x["start"] for x in g["removed"]), len(g["removed"]), hashlib.sha256(bytes(g["kept"])).hexdigest()) for g in got), key=repr)
    assert ours == brute.repeated_bytes(rows)


def test_repeated_bytes_of_rows_that_share_an_id_and_of_long_texts(spark):
    r = random.Random(14)
    passage = "".join(r.choice("ghijkl") for _ in range(150))
    rows = [(None, "".join(r.choice("abcdef") for _ in range(r.randint(0, 260)))) for _ in range(1500)]
    rows += [(None, f"{i:05d}" * 30) for i in range(1500)] + [(None, passage + "x"), (None, "yy" + passage), (1, passage + "z"), (1, "zz" + passage), (2, passage)]
    rows += [(3, "".join(r.choice("mnop") for _ in range(400_000)) + passage)]
    out = suffixes.deduplicate(frame(spark, rows).withColumnsRenamed({"component_id": "row", "kept": "start"}))
    got = sorted(((g["doc_id"], g["n_bytes"], sum(x["end"] - x["start"] for x in g["removed"]), len(g["removed"]), hashlib.sha256(bytes(g["kept"])).hexdigest()) for g in out.collect()), key=repr)
    assert got == brute.repeated_bytes(rows)


def test_repeated_bytes_of_rows_repeated_in_number(spark):
    r = random.Random(24)
    passage, other = ("".join(r.choice("ghijkl") for _ in range(170)) for _ in range(2))
    rows = [(0, passage)] + [(1, "ab" + passage + "cd" + other)] * 300 + [(None, other + "!")] * 200 + [(2, "zz" + other)]
    got = suffixes.deduplicate(frame(spark, rows)).collect()
    ours = sorted(((g["doc_id"], g["n_bytes"], sum(x["end"] - x["start"] for x in g["removed"]), len(g["removed"]), hashlib.sha256(bytes(g["kept"])).hexdigest()) for g in got), key=repr)
    assert ours == brute.repeated_bytes(rows)
    keyed = spark.createDataFrame(rows, "id long, text string").selectExpr("coalesce(id, -9223372036854775808) AS id", "xxhash64(text) AS row", "text")
    runs = suffixes.removals(keyed)
    assert runs.count() <= 8 * runs.distinct().count()  # one list a task, not one a copy


def test_suffix_array_and_prefixes():
    r = random.Random(5)
    for _ in range(200):
        b = bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 50))) * r.randint(1, 3)
        order, rank = suffixes.suffix_array(np.frombuffer(b, np.uint8))
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        shared = suffixes.common_prefixes(np.frombuffer(b, np.uint8), order, rank, 10, lanes=4)
        for k in range(1, len(b)):
            assert shared[k] == min(10, len(os.path.commonprefix([b[order[k] :], b[order[k - 1] :]])))


def test_repeated_bytes_of_nothing(spark):
    assert suffixes.deduplicate(frame(spark, [])).count() == 0


def overlaps(text, item):
    """Whether 13 aligned words (all of a shorter item) agree by 80 %."""
    import re

    w, v = (re.findall(r"[^\W_]+", (x or "").lower()) for x in (text, item))
    n = min(13, len(v))
    if len(v) < 5:
        return False
    return any(5 * sum(x == y for x, y in zip(w[i : i + n], v[j : j + n])) >= 4 * n for i in range(len(w) - n + 1) for j in range(len(v) - n + 1))


def test_decontamination(spark):
    r = random.Random(6)
    items = [(i, " ".join(f"b{r.randrange(400)}" for _ in range(n))) for i, n in enumerate([20, 13, 9, 5, 30, 4, 3])] + [(7, None), (8, "")]
    items += [(9, items[0][1].upper()), (10, items[3][1] + "!")]
    rows = []
    for i in range(150):
        body = [f"t{r.randrange(400)}" for _ in range(r.randint(0, 40))]
        item = r.choice(items[:7])[1].split()
        lo = r.randrange(len(item))
        part = item[lo : lo + r.randint(1, 20)] if r.random() < 0.5 else item
        part = [w if r.random() > 0.12 else "subst" for w in part]
        at = r.randint(0, len(body))
        rows.append((i, ", ".join(body[:at] + part + body[at:]).upper()))
    rows += [(200, None), (201, ""), (202, items[0][1]), (202, items[0][1]), (203, "x " * 5000 + items[4][1]), (None, items[0][1])]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_overlaps(docs, bench)
    want = {(i, k) for i, t in rows for k, v in items if overlaps(t, v)}
    assert {(g["doc_id"], g["item_id"]) for g in got.collect()} == want
    docs = docs.withColumnsRenamed({"component_id": "id", "kept": "_id"}).withColumns({c: F.lit(1) for c in ("hashes", "bits", "_held", "_text_key", "text_key")})
    clean = decontaminate.remove_overlapping(docs, bench)
    assert clean.columns == docs.columns
    bad = {i for i, _ in want}
    assert sorted(x["doc_id"] for x in clean.collect()) == sorted(i for i, _ in rows if i not in bad)


def test_decontamination_of_nothing(spark):
    docs, none = frame(spark, [(1, "a b c d e f g")]), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_overlaps(docs, none).count() == 0
    assert decontaminate.find_overlaps(frame(spark, []), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_range_counts_of_very_long_texts_do_not_wrap():
    long, short = np.full(64 * 200, 250, np.uint8), np.full(64 * 2, 3, np.uint8)
    assert (jaccard._tier([long, short], 64) == [[50_000] * 64, [6] * 64]).all()
    assert jaccard._tier([short], 64).dtype == np.int16


def test_url_rules(spark):
    rows = ["http://A.Example.COM/en/7?x", "https://b.example.com/en/6", "https://com/en/", "https://x.net/de/8", "https://q.example.net/de/81", "http://notcom/en/", "ftp://u.org/es/#f", "no scheme", None, "", "http://h.com?en/", "x://a.net/fr/://b"]
    pages = spark.createDataFrame([(i, u, None, "kept") for i, u in enumerate(rows)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect()}
    assert got[0] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1][2:] == ("com/en/", "block") and got[2][2:] == ("com/en/", "block") and got[3][2:] == ("net/de/", "allow")
    assert got[4][2:] == ("example.net/de/8", "block") and got[5][2] is None and got[6][:3] == ("u.org", "/es/", "org/es/")
    assert got[7] == got[8] == got[9] == ("", "", None, "allow") and got[10][:2] == ("h.com", "") and got[11][:2] == ("a.net", "/fr/://b")


def test_trust_flows_along_links_and_distrust_against_them(spark):
    def page(i, host, path, *links):
        return (i, f"http://{host}{path}", "".join(f'<a href="http://{x}/">' for x in links))

    pages = spark.createDataFrame(
        [page(0, "good.net", "/de/1", "friend.eu"), page(1, "bad.com", "/en/1"), page(2, "friend.eu", "/"), page(3, "farm.eu", "/", "bad.com"), page(4, "farther.eu", "/", "farm.eu"), page(5, "plain.eu", "/")],
        "page_id long, url string, html string",
    )
    rows = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert [rows[i]["verdict"] for i in range(6)] == ["allow", "block", "allow", "block", "block", "allow"]
    assert rows[2]["trust"] > 0 and rows[3]["distrust"] > rows[4]["distrust"] > 0 and rows[5]["trust"] == rows[5]["distrust"] == 0
    assert urls.judge(pages.limit(0)).count() == 0


def test_scores_equal_a_plain_walk_and_columns_may_clash(spark):
    r = random.Random(15)
    hosts = [f"h{i}.eu" for i in range(12)] + ["good.net", "bad.com"]
    links = {h: [r.choice(hosts) for _ in range(r.randint(0, 5))] for h in hosts}
    url = {"good.net": "http://good.net/de/1", "bad.com": "http://bad.com/en/1"}
    rows = [(i, url.get(h, f"http://{h}/"), "".join(f"<a href='//{x}/y'>" for x in links[h]), "u") for i, h in enumerate(hosts)] * 2
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string, _host string").withColumn("row", F.lit(1)).withColumn("score", F.lit(2))).collect()

    def walk(edges, seed):
        """Personalised PageRank; hosts without a way on give their mass back to the seed."""
        score = {h: float(h == seed) for h in hosts}
        for _ in range(300):
            out = {h: 0.0 for h in hosts}
            for h, x in score.items():
                for k in edges[h] or [seed]:
                    out[k] += 0.85 * x / len(edges[h] or [seed])
            out[seed] += 0.15 * sum(score.values())
            score = out
        return score

    ahead = {h: [x for x in links[h] if x != h] for h in hosts}
    back = {h: [x for x in hosts for y in ahead[x] if y == h] for h in hosts}
    trust, distrust = walk(ahead, "good.net"), walk(back, "bad.com")
    assert len(got) == 28
    for g in got:
        assert abs(g["trust"] - trust[g["host"]]) < 1e-3 and abs(g["distrust"] - distrust[g["host"]]) < 1e-3 and g["_host"] == "u" and g["row"] == 1


def test_scores_of_many_hosts_are_not_rounded_away(spark):
    # bad.com <- 1000 hosts; a0 of them <- 1000 hosts; b0 of these <- 1000 hosts
    pages = [("bad.com/en/1", None)] + [(f"a{i}.eu/", "bad.com") for i in range(1000)] + [(f"b{i}.eu/", "a0.eu") for i in range(1000)] + [(f"c{i}.eu/", "b0.eu") for i in range(1000)]
    rows = [(k, f"http://{url}", f'<a href="http://{to}/">' if to else None) for k, (url, to) in enumerate(pages)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).groupBy("verdict").count().collect()
    assert [tuple(g) for g in got] == [("block", 3001)]


def test_verdicts_of_a_drawn_graph_equal_a_plain_walk(spark):
    r, n = np.random.default_rng(16), 3000
    target = (n * r.random(4 * n) ** 2).astype(int)
    source = r.integers(0, n, 4 * n)
    seeds = {k: "good.net" if k % 2 else "bad.com" for k in range(40)}
    name = lambda k: f"s{k}.{seeds[k]}" if k in seeds else f"h{k}.eu"
    html = {}
    for a, b in zip(source.tolist(), target.tolist()):
        html[a] = html.get(a, "") + f"<a href=//{name(b)}/>"
    path = lambda k: "/" if k not in seeds else "/de/1" if k % 2 else "/en/1"
    got = urls.judge(spark.createDataFrame([(k, f"http://{name(k)}{path(k)}", html.get(k)) for k in range(n)], "page_id long, url string, html string")).collect()
    keep = source != target
    scores = []
    for a, b, first in ((source[keep], target[keep], 1), (target[keep], source[keep], 0)):
        ways, own = np.maximum(np.bincount(a, minlength=n), 1), np.array([float(k in seeds and k % 2 == first) for k in range(n)])
        own /= own.sum()
        score = own.copy()
        for _ in range(400):
            score = 0.85 * np.bincount(b, score[a] / ways[a], n) + 0.15 * own
        scores.append(score / score.sum())
    trust, distrust = scores
    for g in got:
        k = g["page_id"]
        if g["rule"] is None and abs(distrust[k] - trust[k]) > 1e-3 * trust[k]:
            assert (g["verdict"] == "block") == (distrust[k] > trust[k])


def test_distrust_reaches_hosts_any_number_of_links_away(spark):
    n = 11  # h0 -> h1 -> ... -> the blocked host
    hosts = [*(f"h{i}.eu" for i in range(n)), "bad.com"]
    rows = [(i, f"http://{h}/", f'<a href="http://{hosts[i + 1]}/">') for i, h in enumerate(hosts[:-1])] + [(n, "http://bad.com/en/1", None), (n + 1, "http://plain.eu/", None)]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i]["verdict"] for i in range(n + 2)] == ["block"] * (n + 1) + ["allow"]
    whole = sum(0.85**k for k in range(n + 1))  # what reaches the far end goes back to the seed
    assert all(abs(got[i]["distrust"] - 0.85 ** (n - i) / whole) < 1e-8 for i in range(n + 1))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    parts = {"xx": ["tha", "ing", "er", "st"], "yy": ["ção", "lh", "os", "ma"]}

    def text(lang, n=80):
        return " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(2, 5))) for _ in range(n))

    rows = [(i, text(k), k, "s", 1) for i, k in enumerate(["xx", "yy"] * 20)]
    rows.append((40, rows[0][1] + " end", "xx", "s", 1))  # a near copy of 0
    item = text("xx", 20)
    rows.append((41, text("xx", 30) + " " + item, "xx", "s", 1))  # leaked
    secret = rows[1][1] + " password=abcdef123456 and more"
    rows[1] = (1, secret, "yy", "s", len(secret))
    rows += [(42, None, "xx", "s", 0), (43, "123", "xx", "s", 3), (2, rows[2][1], "xx", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        if name != "byte_bpe":
            assert out.columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(sorted(x["doc_id"] for x in docs.select("doc_id").collect()))
    assert kept[0] == sorted([*range(42), 2])
    assert kept[1] == [i for i in range(42) if i != 40] and kept[2] == list(range(40))
    masked = spark.read.parquet(str(tmp_path / "secret_scans")).filter("doc_id = 1").first()
    assert "[secret]" in masked["text"] and "abcdef123456" not in masked["text"] and masked["n_chars"] == len(masked["text"])
    assert docs.filter("not round_trip").count() == 0
    again = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", F.hash("token_ids")).collect()
    assert sorted(again) == sorted(docs.select("doc_id", F.hash("token_ids")).collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", ["op3_jaccard_join", "op9_decontamination", "op10_url_filters", "op11_conversation_repair", "op13_importance_resampling", "quality_base", "secret_base", "personal_base"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from capstan.llm import registry
    from tests.test_queries import rows_of

    c, d = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "benchmark", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df, cursor = registry.QUERIES[name](spark, d), c.execute(registry.ORACLE_SQL[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([x[0] for x in cursor.description], cursor.fetchall())
