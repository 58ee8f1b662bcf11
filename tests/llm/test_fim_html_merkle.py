"""Fill-in-middle, HTML extraction and the Merkle manifest against brute force on small tables with nulls,
empty and long texts, ties, repeated rows and clashing extra columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from berthwise.llm import fim, html, merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, leaf0 string, h1 string, output string, g string"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


# -- fill in the middle ---------------------------------------------------------------------------

def _fim(doc_id, text):
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if t == "" or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, len(units), "plain", None, None, t.encode(), t.encode())
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    swap = h[3] % 100 < 20
    out = f"<S>{s}<P>{p}<M>{m}" if swap else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, len(units), "spm" if swap else "psm", len(p), len(m), out.encode(), t.encode())


def test_fim(spark):
    rng = random.Random(3)
    signs = ["ab", "Z", " ", "\n", "é", "ß", "漢", "\U0001f600", "<", "P", ">", "<P", "S>", "M>", "\x00", "9", "\r\n", "́"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [None, "", "a", "<", "<P>", "x<M>y", "word, " * 600_000, "z" * 100_000, "\x00", "漢" * 3000]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, "no id", "en", "s", 1), (5, texts[5], "en", "s", 1), (5, "other", None, None, None)]
    got = fim.with_restored(fim.transformed(_docs(spark, rows))).collect()
    bytes_ = lambda r: (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output), bytes(r.restored))
    assert sorted(map(bytes_, got), key=repr) == sorted((_fim(r[0], r[1]) for r in rows), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.with_restored(fim.transformed(_docs(spark, rows).limit(0))).collect() == []


def test_fim_slices_keep_rows(monkeypatch, spark):
    rows = [(i, "ab cd " * (i % 7), "en", "s", 1) for i in range(50)]
    batch = fim.pa.record_batch({"text": [r[1].encode() for r in rows]})
    parts = list(fim._slices(batch, "text", 20))
    assert sum(len(p) for p in parts) == 50 and max(len(p) for p in parts) > 1
    assert [x for p in parts for x in p.column("text").to_pylist()] == [r[1].encode() for r in rows]


# -- main text of pages ---------------------------------------------------------------------------

PARAGRAPH = "Some good words of an article that go on for a while, as articles do."


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "page_id bigint, url string, html string, host string, paths string, salt string").repartition(3)


def _texts(spark, rows):
    return {r.page_id: r.text for r in html.extracted(_pages(spark, rows)).collect()}


def test_blocks_and_references():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
      <nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy <b>now</b></div><!-- no -->
      <article><header><h1>A &amp;  title</h1></header><p>One <b>bold
      word<br>more<p>two &lt;x&gt; &eacute;&#233;&nbsp;z &am<ul><li>a<li>b</ul><form><p>no</p></form><aside>no</aside>
      <div class="share-buttons">no</div><table><tr><td>1<td>2<tr><td>3</table>tail <i>end</i></article>
      <section id="comments"><p>reader</p></section><footer>&copy; no</footer>"""
    want = "A & title\nOne bold word more\ntwo <x> éé z &am\na\nb\n1\n2\n3\ntail end"
    assert html.main_text(page, []) == want
    assert html.main_text(page, [("html", "body", "article")]) == want
    assert html.main_text("", []) == "" and html.main_text("no markup at  all", []) == "no markup at all"
    assert html.main_text("<nav>menu</nav><script>x</script>", []) == ""


def test_class_words_do_not_take_the_article():
    body = f"<p>{PARAGRAPH}</p><p>{PARAGRAPH}</p>"
    want = f"{PARAGRAPH}\n{PARAGRAPH}"
    assert html.main_text(f"<body class='has-sidebar'><div class='with-sidebar'><div class='content'>{body}</div></div><div class='sidebar'>no</div>", []) == want
    assert html.main_text(f"<body><div class='page banner'><article>{body}</article></div><p>out", []) == want
    assert html.main_text(f"<body><div id=story>{body}</div><div class='cookie-notice'>We use cookies</div>", []) == want


def test_consensus_follows_the_host(spark):
    """A short article beside an unnamed long box is found by the path its host agrees on; digits in classes don't matter."""
    box = "<div class=x7><p>" + "box words " * 40 + "</p></div>"
    page = lambda i, text, more="": f"<html><body><div class='post-{i} body'><p>{text}</p></div>{more}</body></html>"
    rows = [(i, f"http://User@Host.example:80/{i}", page(i, PARAGRAPH * 3)) for i in range(30)]
    rows += [(100, "https://host.example/x", page(100, "Short text here. " * 30, box)), (101, None, page(1, "alone")), (102, "not a url", None), (103, "http://b/", "")]
    rows += [rows[0]]
    voted = html.votes(_pages(spark, rows)).where("host = 'host.example'").collect()
    assert [(r.path, r.votes) for r in voted] == [(["html", "body", "div.body.post-#"], 32)] or sum(r.votes for r in voted) == 32
    got = html.extracted(_pages(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: (r.url, r.text) for r in got}
    assert by_id[0] == ("http://User@Host.example:80/0", " ".join((PARAGRAPH * 3).split()))
    assert by_id[100][1] == " ".join(("Short text here. " * 30).split())
    assert by_id[101] == (None, "alone") and by_id[102] == ("not a url", "") and by_id[103][1] == ""


def test_second_layout_of_a_host_and_odd_pages(spark):
    a = f"<body><div class=alpha><p>{PARAGRAPH}</p></div><p>loose line</p>"
    b = f"<body><main class=beta><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></main><footer>f</footer>"
    odd = f"<body><td class=gamma><p>{PARAGRAPH * 4}</p>"
    rows = [(i, "http://h/", a if i % 4 else b) for i in range(40)] + [(50, "http://h/", odd), (51, "http://h/", "<p>" + "deep" + "<div>" * 3000 + "x" * 50_000)]
    got = _texts(spark, rows)
    assert got[0] == f"{PARAGRAPH}\n{PARAGRAPH}" and got[50] == (PARAGRAPH * 4)
    assert got[1].startswith(PARAGRAPH) and got[51].endswith("x" * 50_000)
    assert html.extracted(_pages(spark, rows).limit(0)).collect() == []


# -- Merkle manifest ------------------------------------------------------------------------------

def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(i, s, la, n, t):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, la, n, t)])


def _tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])

    def proof(i):
        out = []
        for level in levels[:-1]:
            out.append(("none", None) if i ^ 1 >= len(level) else ("left" if i & 1 else "right", level[i ^ 1]))
            i >>= 1
        return out
    return levels, proof


@pytest.mark.parametrize("n", [*range(1, 20), 33, 100])
def test_append_log_is_addressed_in_closed_form(n):
    levels, _ = _tree([_h(str(i)) for i in range(n)])
    for more in range(3):                                   # blocks at the right edge rise alone
        log = merkle.append_log([bytes.fromhex(x) for x in levels[0]], len(levels) - 1 + more)
        for level, nodes in enumerate(levels):
            for i, x in enumerate(nodes):
                assert log[int(merkle.position(np.array(level), np.array(i), n))].hex() == x
        assert len(log) == sum(map(len, levels)) + more


@pytest.mark.parametrize("block_levels", [2, 10])
def test_manifest(spark, monkeypatch, block_levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", block_levels)
    rng = random.Random(5)
    langs = ["en"] * 60 + ["de"] * 17 + ["é", "z", None, None, None, "one"]
    rows = [(i, "text %d " % i * rng.randrange(4), la, rng.choice(["a", None, "ü"]), rng.choice([None, i])) for i, la in enumerate(langs)]
    rows += [(None, None, "de", None, None), (None, "", "en", "", 0), (3, "again", "en", "a", 1), rows[4], rows[4], (9_000, "long " * 200_000, "de", "s", 1)]
    rng.shuffle(rows)
    docs = _docs(spark, rows).withColumn("leaf", merkle.digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])).drop("text")
    got = merkle.manifest(docs, "leaf", "doc_id", "lang").select(
        "row.*", "subroot", "root", "proof", merkle.folded(F.col("row.leaf"), F.col("proof")).alias("back"),
        merkle.folded(F.sha2("row.leaf", 256), F.col("proof")).alias("tampered")).collect()

    groups = {}
    for i, t, la, s, n in rows:
        groups.setdefault(la, []).append((i, _leaf(i, s, la, n, t)))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {la: _tree([x for _, x in sorted(groups[la], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]) for la in order}
    top, top_proof = _tree([trees[la][0][-1][0] for la in order])
    want = sorted((la or "", leaf, trees[la][0][-1][0], top[-1][0], tuple(trees[la][1](k) + top_proof(order.index(la))))
                  for la in order for k, leaf in enumerate(trees[la][0][0]))
    assert sorted((r.lang or "", r.leaf, r.subroot, r.root, tuple((s.side, s.digest) for s in r.proof)) for r in got) == want
    assert all(r.back == r.root and r.tampered != r.root and r.g == "x" for r in got)


def test_empty_manifest(spark):
    docs = _docs(spark, [(1, "a", "b", "c", 1)]).limit(0).withColumn("leaf", F.lit("00"))
    assert merkle.manifest(docs, "leaf", "doc_id", "lang").collect() == []
