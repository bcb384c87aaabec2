"""Whitening, main text and periodic runs against brute force, and on awkward inputs."""

import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lidarloom.llm import html_text, periodic, queries, whitening

DIR = "/root/testdata/sf0.001"


# --- whitening --------------------------------------------------------------------------------------------------------


def restated(vectors):
    """The contract in numpy, on arrays: x, n, deviations, whitened (any sign), shares."""
    x = np.floor(256 * np.asarray(vectors, float)).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    e, v = np.linalg.eigh(np.cov(u.T.astype(float), bias=True))
    e, v = e[::-1], v[:, ::-1]
    return n, ((n * x - s) ** 2).sum(1), ((x - s / n) @ v[:, :4]) / np.sqrt(e[:4]), e[:4] / e.sum()


def compare(rows, ids, vectors):
    n, deviation, white, share = restated(vectors)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == 4 * len(ids)
    for k in range(4):
        own = np.array([got[i, k + 1]["whitened"] for i in ids])
        assert np.allclose(own, np.sign(own @ white[:, k]) * white[:, k], atol=1e-8)
        assert np.isclose(got[ids[0], k + 1]["explained"], share[k])
    assert all(got[i, 1]["n"] == n and got[i, 1]["deviation"] == d and got[i, 1]["identity_error"] < 1e-9 for i, d in zip(ids, deviation.tolist(), strict=True))


def test_whitening_of_the_table(spark):
    v = spark.read.parquet(f"{DIR}/embeddings.parquet")
    t = v.toPandas()
    compare(queries.op11_whitening(spark, DIR).collect(), t["vec_id"].tolist(), np.stack(t["embedding"]))
    assert queries.op11_whitening(spark, DIR).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_of_awkward_rows(spark):
    """Rows without a finite vector go, repeated vectors count once, columns of the operator's own names do no harm."""
    rng = np.random.default_rng(1)
    good = rng.normal(size=(40, 6)).tolist()
    rows = [(i, v, "x", 1.0) for i, v in enumerate(good + good[:25])]
    odd = [(100, None), (101, [None, *good[0][1:]]), (102, [float("nan"), *good[0][1:]]), (103, [float("inf"), *good[0][1:]]), (104, [1e300, *good[0][1:]]), (105, [1.0, 2.0])]
    rows += [(i, v, "y", 2.0) for i, v in odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, n double").repartition(5)
    compare(whitening.whiten(df).collect(), list(range(65)), good + good[:25])


def test_whitening_is_exact_for_large_values(spark):
    """Sums and deviations beyond 2^53 are whole numbers; one beyond a long is null."""
    big = [[2.0**40 + i, -(2.0**30) * i] for i in range(5)]
    rows = whitening.whiten(spark.createDataFrame(list(enumerate(big)), "vec_id long, embedding array<double>"), scale=1).where("component = 1").orderBy("vec_id").collect()
    x = [[int(a), int(b)] for a, b in big]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((5 * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
    assert [r["deviation"] for r in rows] == [w if w < 2**63 else None for w in want] and None in [r["deviation"] for r in rows]


def test_whitening_without_spread(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (None, [0.5, 0.25])], schema)).collect()
    assert len(one) == 4 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in one)
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], schema)).collect()
    assert len(line) == 27 and all((r["whitened"] is None) == (r["component"] > 1) for r in line) and all(r["identity_error"] < 1e-12 for r in line)
    other = whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [1.0, 2.0])], schema)).collect()
    assert {r["vec_id"] for r in other} == {1, 2}


def test_moments_merge():
    rows = np.random.default_rng(2).normal(5, 2, (50, 3))
    whole, none = whitening.Moments.of(rows), whitening.Moments(0, np.zeros(3), np.zeros((3, 3)))
    parts = none + whitening.Moments.of(rows[:7]) + whitening.Moments.of(rows[7:]) + none
    assert parts.n == 50 and np.allclose(parts.mean, whole.mean) and np.allclose(parts.products, whole.products)


# --- main text --------------------------------------------------------------------------------------------------------

PAGE = "page_id long, url string, html string"


def extracted(spark, *pages):
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], PAGE)
    return [r["text"] for r in html_text.main_text(df).orderBy("page_id").collect()]


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice("alder birch cedar dogwood elm fir gum hazel".split()) for _ in range(n))


def test_main_text_of_the_table(spark):
    """Every page against the article's text, cut out by patterns that know this table's one layout."""
    for r in queries.op12_main_text(spark, DIR).join(spark.read.parquet(f"{DIR}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer|$)", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?(?:b|br)>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_main_text_of_other_layouts(spark):
    """Pages unlike the labelled ones: all of the article, nothing of the rest."""
    long = [words(n, n) for n in (60, 45, 80)]
    rest = '<nav><a href="/">Home</a> <a href="/n">News</a></nav><div id="cookie-banner">We use cookies, you know. <button>OK</button></div>'
    after = f'<aside class="sidebar"><h3>More</h3><p>{words(30, 7)}</p></aside><section id="comments"><article class="comment"><p>{words(40, 8)}</p></article><form><textarea>say</textarea><label>Name</label></form></section><footer><p>{words(20, 9)}</p></footer>'
    marked = f"<html><body>{rest}<header><h1>Site</h1></header><main><article><header><h1>Title here</h1></header><p>{long[0]}</p><p>Oh.</p><div class='ad-slot'>{words(25, 6)}</div><p>{long[1]} <a href=x>two words</a></p></article></main>{after}</body></html>"
    plain = f"<body><div>{rest}</div><div><h2>A heading of some words</h2><p>{long[0]}</p><p>{long[1]}<p>{long[2]}</div><div class=footer>{words(20, 9)}</div>"
    aspx = f"<body><form id=aspnetForm><div><a href=1>Home</a></div><div><p>{long[0]}</p><p>{long[2]}</p></div><label>Search</label></form>"
    got = extracted(spark, marked, plain, aspx)
    assert got[0] == f"Title here\n{long[0]}\nOh.\n{long[1]} two words"
    assert got[1] == f"A heading of some words\n{long[0]}\n{long[1]}\n{long[2]}"
    assert got[2] == f"{long[0]}\n{long[2]}"


def test_main_text_of_broken_markup(spark):
    got = extracted(
        spark, None, "", "   ", "no markup at all", "<article><p>a &amp;amp; b&nbsp;&#65;\n\t c<p>d<br>e</article>", "<article><p>x<!-- never closed", "<article><script>if (a < b) '</p>'</script><p>y</p>",
        '<article><p title="a>b">q</p><p>1 < 2 <b>b', "<article><p>" + "w " * 100_000, "</p></div></article><article><p>z</p>", "<div class='menu'><article><p>kept " + words(30) + "</p></article></div>",
    )
    assert got[:3] == ["", "", ""] and got[4] == "a &amp; b A c\nd e" and got[5] == "x" and got[6] == "y" and got[7] == "q\n1 < 2 b"
    assert got[8] == " ".join(["w"] * 100_000) and got[9] == "z" and got[10].startswith("kept")


def test_main_text_keeps_rows(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>a</p></article>", "b", 1)] * 2 + [(None, None, None, "b", 1)], PAGE + ", blocks string, text int")
    assert sorted(map(tuple, html_text.main_text(df).select("page_id", "url", "text", "n_chars").collect()), key=str) == [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)]
    assert html_text.main_text(spark.createDataFrame([], PAGE)).count() == 0


def test_the_tree_knows_its_table(spark):
    """The labelled blocks are told apart, and the tree uses more than one feature."""
    tree = html_text.tree_of()
    names = set()

    def walk(t, row):
        while not isinstance(t, float):
            names.add(t[0])
            t = t[2] if row[t[0]] <= t[1] else t[3]
        return t

    rows = html_text.labelled(spark).collect()
    right = sum(walk(tree, r) == r["main"] for r in rows)
    assert right >= 0.97 * len(rows) and {"mark", "place"} <= names and len(names) >= 4


# --- periodic runs ----------------------------------------------------------------------------------------------------


def all_runs(w, least=12):
    """Every period in turn, by comparing words."""
    n, found = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i + p - start >= max(least, 2 * p):
                found.setdefault((start, i + p), p)
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    drop = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


@pytest.mark.parametrize("least", [2, 4, 12])
def test_runs_of_small_alphabets(least):
    """Words of two and three letters, powers and Fibonacci words, many texts at once."""
    r = random.Random(3)
    texts = [[r.choice("ab") for _ in range(n)] for n in range(40)] + [[r.choice("abc") for _ in range(60)] for _ in range(40)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 150:
        fib.append(fib[-1] + fib[-2])
    texts += [list(fib[-1]), ["a"] * 50, list("abcab" * 12), [], list("abcabcabd" * 5), list("ab" * 20 + "ba" * 20)]
    runs, out = periodic.solved(texts, least)
    for t, found, text in zip(texts, runs, out, strict=True):
        want = all_runs(t, least)
        assert [(x["start"], x["length"], x["period"]) for x in found] == want and text == collapse(t, want)


def test_extensions_are_brute_force():
    r = np.random.default_rng(4)
    code, size = r.integers(0, 3, 300), np.array([100, 0, 150, 50])
    begin = np.cumsum(size) - size
    text, stop = np.repeat(np.arange(4), size), np.repeat(begin + size, size)
    s = periodic.Suffixes(code, text, stop)
    a, b = r.integers(100, 250, 400), r.integers(100, 250, 400)
    a, b = a[a != b], b[a != b]
    for x, y, k in zip(a, b, s.extension(a, b), strict=True):
        n = 0
        while max(x, y) + n < 250 and code[x + n] == code[y + n]:
            n += 1
        assert n == k


def test_grids_in_portions():
    size = np.array([0, 1, 7, 30])
    begin = np.cumsum(size) - size
    whole = [np.concatenate(v).tolist() for v in zip(*periodic.grids(size, begin), strict=True)]
    parts = [np.concatenate(v).tolist() for v in zip(*periodic.grids(size, begin, 5), strict=True)]
    want = [(b + j, p) for n, b in zip(size.tolist(), begin.tolist(), strict=True) for p in range(1, n // 2 + 1) for j in range(0, n - p, p)]
    assert whole == parts and list(zip(*whole, strict=True)) == want


def digests(doc_id, text):
    """The contract's row of one document, word by word."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = all_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{k},{p}\n" for s, k, p in runs)), sha(collapse(w, runs)))


def test_runs_of_the_table(spark):
    rows = queries.op13_periodic_runs(spark, DIR).collect()
    got = {r["doc_id"]: tuple(r) for r in rows}
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs) and sum(r["n_runs"] > 0 for r in rows) >= 5
    for d in docs:
        if len(d["text"] or "") < 12_000:
            assert got[d["doc_id"]] == digests(*d)


def test_runs_of_awkward_texts(spark):
    """Nulls, white space of all kinds, long texts, repeated rows, ids that plant a run, clashing columns."""
    texts = [None, "", " \n\t\r\x0b\x0c ", "a", "a\x1cb   c", "word " * 4000, "x" * 5000, "la li " * 10, "ÄÖ 漢字 " * 9]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 2 + [(None, "b " * 20)] + [(i, " ".join(f"w{i * k % 17}" for k in range(40))) for i in range(20, 120)]
    df = spark.createDataFrame([(*r, "r", 1) for r in rows], "doc_id long, text string, runs string, collapsed int")
    got = sorted(map(tuple, periodic.run_report(df).collect()), key=str)
    assert got == sorted((digests(*r) for r in rows), key=str)
    plain = periodic.periodic_runs(df)
    assert plain.columns == ["doc_id", "text", "runs", "collapsed", "runs_", "collapsed_"] and plain.count() == len(rows)
    assert periodic.run_report(df.limit(0)).count() == 0


def test_a_long_text_is_taken_whole(spark):
    """More words than a task takes at once, with one run at the end."""
    w = [f"w{i}" for i in range(periodic.WORDS + 50)] + ["a", "b", "c"] * 5
    r = periodic.periodic_runs(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")).select(F.col("runs")).first()["runs"]
    assert [tuple(x) for x in r] == [(periodic.WORDS + 50, 15, 3)]
