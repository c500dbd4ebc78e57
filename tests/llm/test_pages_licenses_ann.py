import duckdb
import numpy as np
import pytest

from tilewright.llm import html_text, ivfpq, licenses

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body><header>Site, name</header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-notice">We use, cookies, very many of these cookies, ok</div><div id="content"><h1>The &amp; title</h1><p>One, two, three, four and five words
   to make   it long.<p>Second <b>bold</b> paragraph, too.<br>line</p><ul><li>point a<li>point b</ul><!-- gone --><div class="comments"><p>I think, dear, this, is a bad comment.</p></div>
<form>Search <input name=q></form></div><aside>side, bar</aside><footer>&copy; foot</footer></body></html>"""


def test_extraction():
    assert html_text.extract(PAGE).split("\n\n") == ["The & title", "One, two, three, four and five words to make it long.", "Second bold paragraph, too. line", "point a", "point b"]
    assert html_text.extract(None) == html_text.extract("") == ""
    assert html_text.extract("just text") == "just text"
    for bad in ("<" * 50_000, "<p>" * 20_000, "<div>" * 20_000 + "x", '<a href="' * 20_000, "<!--" * 20_000, "<b>x" * 20_000):
        html_text.extract(bad)


def test_text_beside_the_best_container():
    long = "This is a long paragraph, with commas, of quite some words, that scores many points, and more than others. " * 3
    short = "x" * 199 + ","
    a = "<div class=section><h2>A</h2>" + f"<p>{long}</p>" * 6 + "</div>"
    links = "<div>" + "<p><a href=/x>Some other page with a long title</a></p>" * 4 + "</div>"
    page = f"<html><body><h1>Title</h1><div class=nav>no</div><div class=wrap>{a}<div class=section><h2>B</h2><p>{short}</p></div>{links}</div><ul><li>one<li>two</ul><table><tr><td>cell</table>{links}</body></html>"
    want = ["Title", "A", *[long.strip()] * 6, "B", short, "one", "two", "cell"]
    assert html_text.extract(page).split("\n\n") == want
    assert html_text.extract(f"<body>{a}and <b>bold</b> text</body>").endswith("and bold text")
    assert html_text.extract(f"<body><h1>Title</h1><article>{a}</article><p>Not, of it</p></body>").startswith("A")


def test_names_inside_an_article():
    page = "<article><header><h1>T</h1></header><p class=byline>By Ann</p><p>" + "long text, " * 10 + "</p><p id=legal>legal text</p><div class=share>Share it</div><section id=related-work><h2>Related work</h2><p>words words</p></section><p>x <math><mi>E</mi><mo>=</mo><mn>1</mn></math> y</p><div class=related-posts><p>Other, very, nice</p></div><aside>side</aside></article>"
    assert html_text.extract(page).split("\n\n") == ["T", "By Ann", ("long text, " * 10).strip(), "legal text", "Related work", "words words", "x E=1 y"]


@pytest.mark.parametrize("frame", ["article", "main", "wrap"])
def test_every_block_of_the_text_survives(frame):
    """Generated pages: every block of the text comes out, in order, and nothing else."""
    import random

    r = random.Random(frame)
    for n in range(150):
        number = iter(range(1000))
        said = lambda k: f"b{next(number)} " + " ".join("word" + "," * (r.random() < 0.2) for _ in range(k))
        want, parts = [], []

        def add(tag, text, want=want, parts=parts):
            want.append(text)
            parts.append(f"<{tag}>{text}</{tag}>")

        add("h1", said(4))
        for k in range(r.randrange(4, 10)):
            kind = r.choice(["p", "p", "p", "h2", "ul", "table", "blockquote", "pre", "section", "junk"]) if k else "p"
            if kind == "ul":
                items = [said(r.randrange(1, 6)) for _ in range(r.randrange(1, 5))]
                want.extend(items)
                parts.append("<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>")
            elif kind == "table":
                cells = [said(2) for _ in range(4)]
                want.extend(cells)
                parts.append("<table><tr>" + "<tr>".join(f"<td>{a}<td>{b}" for a, b in zip(cells[::2], cells[1::2])) + "</table>")
            elif kind == "section":
                parts.append("<div>")
                add("h2", said(3))
                add("p", said(30))
                parts.append("</div>")
            elif kind == "junk":
                parts.append(r.choice(["<div class=ad>Buy, now, and, more, things, today</div>", "<script>var a = '</p>'</script>", "<form>Name <input></form>", "<div class='social-share'>Share</div>", "<aside>Beside, this</aside>"]))
            else:
                add(kind, said(r.randrange(30, 60) if kind == "p" and k == 0 else r.randrange(3, 40)))
        body = "".join(parts)
        body = f"<{frame}>{body}</{frame}>" if frame != "wrap" else f"<div class=wrap>{body}</div>"
        page = f"<html><body><header>Site</header><nav><a href=/>Home</a></nav>{body}<div class=comments><p>I, think, this, is, a, long, comment</p></div><footer>Foot</footer></body></html>"
        assert html_text.extract(page).split("\n\n") == want, (n, page)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 3), (2, None, None, 3), (2, None, None, 3)], "page_id long, url string, html string, text int")
    rows = html_text.main_text(pages).collect()
    assert len(rows) == 3 and rows[0]["n_chars"] == len(rows[0]["text"]) > 0 and rows[1]["text"] == ""
    assert html_text.main_text(pages.limit(0)).count() == 0


def assert_equal_to_sql(spark, rows):
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = con.execute(licenses.oracle_sql()).fetchall()
    got = [tuple(r) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_licenses(spark, documents, none):
    assert_equal_to_sql(spark, [tuple(r) for r in documents.select("doc_id", "text").collect()])
    assert licenses.scan_licenses(none).count() == 0


def test_whole_notices(spark):
    """Full notices in small lines with marks between, a few words changed, cut short, and scattered over a long line."""
    import random

    r, rows = random.Random(6), []
    for k, (label, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        shown = [w.title() + r.choice(("", ",", ".", "\n * ")) for w in words]
        rows.append((3 * k, "some words before " + " ".join(shown) + " and after"))
        rows.append((3 * k + 1, " ".join(w if j % 12 else "changed" for j, w in enumerate(shown))))
        rows.append((3 * k + 2, " filler text of some length here ".join(words)))
    got = {x["doc_id"]: x["labels"].split(",") for x in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[3 * k] for k, (label, _) in enumerate(licenses.TEMPLATES))
    assert all(got[3 * k + 2] == [""] for k, (_, text) in enumerate(licenses.TEMPLATES) if len(text.split()) > 4)
    assert_equal_to_sql(spark, rows)


def test_wrapped_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files"
    bsd = "Some code\n * Redistribution and use in source and binary forms, with or\r\n * without modification, are permitted provided that the\n * following conditions are met:\n"
    far = "\n".join(mit.replace("\n", " ").replace(" ", "\nother words stand between these\n").split("\n"))
    rows = [(1, mit), (2, bsd), (3, mit.replace("\n", " ")), (4, far), (5, "a\n\n" + mit + "\n" + bsd), (6, "\n"), (7, "released under the\nmit\n\nlicense")]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert_equal_to_sql(spark, rows)
    assert got == {1: ("mit", 1.0), 2: ("bsd", 1.0), 3: ("mit", 1.0), 4: ("", 0.0), 5: ("bsd,mit", 1.0), 6: ("", 0.0), 7: ("mit", 1.0)}


def vectors(n, dim=8, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    x[n // 2 : n // 2 + 40] = x[0]  # copies of a query
    return x


@pytest.mark.parametrize("n", [5, 600])
def test_neighbours(spark, n):
    x = vectors(n)
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(n)] + [(100_000, None, 0), (100_100, [0.0] * 8, 0), (100_200, [1.0, None] + [1.0] * 6, 0), (100_300, [float("nan")] * 8, 0), (100_400, [], 0)]
    found = ivfpq.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    x = x.astype(np.float32).astype(float)
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == {i for i in range(n) if i % 100 == 0}
    hits = 0
    for q, got in by.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(n), d))[: min(10, n - 1)]
        got = sorted(got, key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, len(best) + 1))
        assert all(abs(r["score"] - d[r["vec_id"]]) < 1e-9 for r in got)
        hits += len({r["vec_id"] for r in got} & set(best.tolist())) / len(best)
        if q == 0:
            assert [r["vec_id"] for r in got] == best.tolist()
    assert hits / len(by) >= 0.9


def test_neighbours_in_clusters(spark, monkeypatch):
    """Tight clusters of unequal vectors that share their codes, as with many clusters."""
    train = ivfpq.train
    monkeypatch.setattr(ivfpq, "train", lambda x, lists, parts: train(x, 1, parts, codes=4))
    r = np.random.default_rng(7)
    x = (np.repeat(r.normal(size=(4, 16)), 500, axis=0) + 0.02 * r.normal(size=(2000, 16))).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(len(x))]
    found = ivfpq.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    x = x.astype(float)
    for q in range(0, len(x), 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        got = [f["vec_id"] for f in sorted(found, key=lambda f: f["rank"]) if f["query_id"] == q]
        assert got == np.argsort(d)[:10].tolist()


def test_closest_in_a_shard():
    """Nothing that is among the nearest is left out, whatever the codes are worth; ties go by id."""
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=(900, 8)), r.integers(0, 2, (900, 8)).astype(float), 5 + 1e-3 * r.normal(size=(900, 8))])
    index = ivfpq.train(x[::9], 3, 4, 8)
    ids = r.permutation(len(x))
    for which in range(3):
        lists = np.full(len(x), which)
        codes = index.encode(x, lists)
        asked = np.arange(0, len(x), 50)
        bounds = np.where(asked % 100 == 0, np.inf, 3.0)
        who, found, score = ivfpq.closest(index, which, x[asked], bounds, ids, x, codes, index.errors(x, lists, codes), 11)
        for k, q in enumerate(asked):
            d = np.sqrt(np.add.accumulate((x - x[q]) ** 2, axis=1)[:, -1])
            best = np.lexsort((ids, d))[:11]
            best = best[d[best] <= bounds[k]]
            assert found[who == k].tolist() == ids[best].tolist() and score[who == k].tolist() == d[best].tolist()


def test_every_list_is_exact(spark, monkeypatch):
    """Shards, slices, two vector lengths, a repeated id with two vectors, names that clash."""
    monkeypatch.setattr(ivfpq, "SHARD_ROWS", 40)
    monkeypatch.setattr(ivfpq, "SLICE", 3)
    r = np.random.default_rng(9)
    rows = [(i, r.normal(size=6 if i % 3 else 4).tolist()) for i in range(900)]
    low, high = sorted([r.normal(size=6).tolist(), r.normal(size=6).tolist()])
    rows += [(1000, high), (1000, low)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(1)).withColumn("list", F.lit("x")).withColumn("v", F.lit(None).cast("int"))
    found = {}
    for f in sorted(ivfpq.nearest(df, recall=1).collect(), key=lambda f: f["rank"]):
        found.setdefault(f["query_id"], []).append(f["vec_id"])
    x = dict(rows)
    assert set(found) == {i for i in x if i % 100 == 0}
    for q, got in found.items():
        assert got == sorted((i for i in x if i != q and len(x[i]) == len(x[q])), key=lambda i: (sum((a - b) ** 2 for a, b in zip(x[i], x[q], strict=True)), i))[:10]


def test_probes_follow_the_clusters():
    r = np.random.default_rng(3)
    flat = r.normal(size=(2000, 32))
    tight = np.repeat(r.normal(size=(40, 32)), 50, axis=0) + 0.01 * r.normal(size=(2000, 32))
    few, many = (ivfpq.measured_probes(ivfpq.train(x, 40, 8), x, 10, 0.97) for x in (tight, flat))
    assert few <= 6 and many >= 20


def test_no_vectors(spark):
    assert ivfpq.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("dim", [16, 64])
def test_outliers_have_all_their_neighbours(spark, dim):
    """Tight clusters, and queries far from all of them: ten answers each, the true ones."""
    r = np.random.default_rng(12)
    x = np.repeat(r.normal(size=(40, dim)), 247, axis=0) + 0.01 * r.normal(size=(9880, dim))
    x = np.concatenate([x, 3 * r.normal(size=(100, dim))])
    ids = [100 * k if k < 100 else 100_000 + 1 + k for k in range(len(x))]
    x = np.concatenate([x[-100:], x[:-100]])
    found = ivfpq.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")).collect()
    by = {}
    for f in found:
        by.setdefault(f["query_id"], []).append(f["vec_id"])
    queries = [k for k, i in enumerate(ids) if i % 100 == 0]
    hits = 0
    for q in queries:
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        assert len(by[ids[q]]) == 10
        hits += len(set(by[ids[q]]) & {ids[k] for k in np.argsort(d)[:10]})
    assert hits >= 0.99 * 10 * len(queries)


def test_lists_that_hold_too_few(spark, monkeypatch):
    """Fewer rows in the probed lists than answers are wanted: the others are looked into."""
    monkeypatch.setattr(ivfpq, "measured", lambda index, x, k, recall: (1, float("inf")))
    r = np.random.default_rng(13)
    x = r.normal(size=(60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ivfpq.nearest(df, every=1).groupBy("query_id").count().collect()
    assert len(found) == 60 and {f["count"] for f in found} == {10}


def test_more_lengths_and_clashing_names(spark):
    """Each vector length apart, however many; columns named like those inside."""
    from pyspark.sql import functions as F

    rows = [(100 * n + k, [float(k + j) for j in range(1, n + 2)]) for n in range(12) for k in (0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("key", "v", "digest", "dim", "copy", "ids", "slice", "shard", "list", "score", "found", "bound", "rank", "query_id"):
        df = df.withColumn(name, F.lit(1))
    got = sorted((f["query_id"], f["vec_id"]) for f in ivfpq.nearest(df).collect())
    assert got == [(100 * n, 100 * n + 1) for n in range(12)]
