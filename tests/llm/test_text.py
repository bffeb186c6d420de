"""Toxicity and HTML extraction: parts by hand, held-out accuracy, odd rows; the pipeline against the same steps in plain Python."""

import html
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from skyload.llm import html_text, mixing, packing, simhash, toxicity
from skyload.llm.queries import QUERIES, table, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_folding():
    for text in ("idiot", "IDIOT!", "1d10t", "IDıOT", "іdiоt", "ïdîôt", "ｉｄｉｏｔ", "id​iot", "ídiot", "ldiot"):
        assert toxicity.fold(text).split() == ["idiot"], text
    assert toxicity.fold("a-b, c").split() == ["a", "b", "c"]


def test_lexicon_hits_and_exceptions():
    lexicon = toxicity.Lexicon({" scum ": 5.0, " iowei": 4.0}, (" pond scum ",), (-4.0, 2.0, 10.0))
    found = lambda text: [(a, b) for a, b, _ in lexicon.hits(toxicity.fold(text))]
    assert len(found("you 5cum, Loweiter and loweiblind")) == 3 and found("scummy unlowei") == []
    assert found("green pond scum grows") == [] and len(found("pond scum and scum")) == 1
    assert lexicon.score(b"scum") > lexicon.score(b"scum " + b"word " * 500) > lexicon.score(b"word") == lexicon.score(b"")
    assert 0 <= lexicon.score(b"scum " * 10_000) <= 1


def test_curve():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(3000, 2))
    y = (draw.random(3000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    assert toxicity.fit_curve(x, y) == pytest.approx((0.5, 2, -1), abs=0.25)


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = table(spark, folder, "labels")
    rows = QUERIES["op1_toxicity"](spark, folder).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic", "doc_id").collect()
    toxic, clean = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    assert len(toxic) > 50 and sum(r["predicted"] for r in toxic) > 0.85 * len(toxic) and sum(r["predicted"] for r in clean) < 0.01 * len(clean)
    assert all(r["predicted"] == (r["score"] >= 0.5) and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)


def test_toxicity_of_odd_rows(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score_documents(odd, none).collect()
    assert len(rows) == 13 and {r["score"] for r in rows} == {0.0}
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (7, None), (6, 1), (9, 0)], "doc_id long, toxic int")
    assert toxicity.score_documents(odd, labels).count() == 13 and toxicity.score_documents(nothing, labels).count() == 0
    assert toxicity.drop_toxic(odd, none).columns == odd.columns and toxicity.drop_toxic(odd, none).count() == 13


def test_blocks():
    page = (
        "<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><!-- <p>no</p> --><ul><li>One<li><a href='x>y'>Two &amp; 2</a></ul>"
        "<script>var t='</p><p>no';</script><div class='post mainText'>bare <b>bold</b>er<br>next<p>in &lt;p&gt;\n  again<p>last</div>tail</body>"
    )
    blocks = html_text.blocks_of(page)
    assert [b.text for b in blocks] == ["One", "Two & 2", "bare bolder next", "in <p> again", "last", "tail"]
    assert blocks[1].linked > 5 and blocks[1].tags == ("html", "body", "ul", "li") and blocks[2].names == {"post", "main", "text"}
    assert [b.tags[-1] for b in blocks] == ["li", "li", "div", "p", "p", "body"]
    for broken in ("", "<", "<p", "a < b", "<p><b>x", "</div></p>y", "<script>never closed", "<!-- open", "<a href='", "&#0; &bogus; &#x41;", "<p/>z", "\x00"):
        html_text.blocks_of(broken)


def test_viterbi_and_training_by_enumeration():
    draw = random.Random(2)
    field = html_text.Field({"a": 0.7, "b": -1.1, "c": 0.2}, np.array([[0.4, -0.3], [-0.8, 0.9]]))
    for _ in range(30):
        features = [[draw.choice("abc") for _ in range(draw.randint(0, 3))] for _ in range(draw.randint(1, 7))]
        gains = field.emissions(features)

        def total(labels):
            return sum(g for g, label in zip(gains, labels) if label) + sum(field.moves[a][b] for a, b in zip(labels, labels[1:]))

        every = [[n >> i & 1 for i in range(len(features))] for n in range(1 << len(features))]
        assert total(field.decode(features)) == pytest.approx(max(map(total, every)))
    assert field.decode([]) == []
    pages = [([["a"], ["b"], ["b"], ["c"]], [0, 1, 1, 0])] * 20
    assert html_text.train(pages).decode(pages[0][0]) == [0, 1, 1, 0]


def test_extraction(spark):
    """All pages of the table, and pages of unseen layouts made from others than the field was trained on."""
    folder = "/root/testdata/sf0.01"
    found = {r["page_id"]: r for r in QUERIES["op5_html_extraction"](spark, folder).collect()}
    pages = duckdb.execute(f"SELECT page_id, url, html FROM '{folder}/pages.parquet' ORDER BY page_id").fetchall()
    right = 0
    for page_id, url, page in pages:
        article = re.search(r"(?s)<article>(.*)</article>", page).group(1)
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", article))).split())
        assert found[page_id]["url"] == url and found[page_id]["n_chars"] == len(found[page_id]["text"])
        right += found[page_id]["text"] == text
    assert len(found) == len(pages) and right >= 0.99 * len(pages)
    whole = [page for *_, page in pages]
    field, draw, wrong, size = html_text.train(html_text.labelled_pages(whole[:120])), random.Random(99), 0, 0
    others = [b.text for page in whole[120:140] for b in html_text.blocks_of(page)]
    for page in whole[140:]:
        main = [b.text for b in html_text.blocks_of(page) if html_text.label_of(b)]
        made, labels = html_text.render(main[0], main[1:], others, draw)
        got = field.decode(html_text.features_of(html_text.blocks_of(made)))
        wrong, size = wrong + sum(a != b for a, b in zip(got, labels)), size + len(labels)
    assert wrong < 0.02 * size


def article_page(wrap: str, inner: str) -> str:
    """A page of the tables' layout inside a wrapper."""
    words = " ".join(f"word{n} and more" for n in range(30)) + "."
    return (
        f"<html>{wrap}<nav><a href='#'>Home</a> <a href='#'>News</a></nav><article><h1>The title</h1><p>First: {words}</p>{inner}<p>Last: {words}</p></article>"
        "<aside>Related things</aside><footer>© someone</footer></body></html>"
    )


@pytest.mark.parametrize("wrap", [
    "<body class='page-with-comments'>", "<body class='menu-open'>", "<body class='has-sidebar'>", "<body><div class='sidebar-layout'><div id='comments-page'>",
    "<body class='newsletter'><div class='widget'>", "<body><main class='no-sidebar'>",
])
def test_names_of_outer_elements_lose_no_paragraph(wrap):
    folder = "/root/testdata/sf0.01"
    pages = [page for (page,) in duckdb.execute(f"SELECT html FROM '{folder}/pages.parquet' ORDER BY page_id LIMIT 120").fetchall()]
    field = html_text.train(html_text.labelled_pages(pages))
    inner = "<p>Here <math><mi>x</mi><mo>=</mo><mn>2</mn></math> stands, and an <object><b>object</b></object> with a text of its own.</p><figure><figcaption>A caption of some words, in the article.</figcaption></figure>"
    found = html_text.main_text(article_page(wrap, inner).encode(), field)
    for part in ("The title", "First: word0", "Here x=2 stands, and an object with", "A caption of some words", "Last: word0"):
        assert part in found, (part, found)
    for part in ("Home", "Related things", "someone"):
        assert part not in found, (part, found)
    blocks = html_text.blocks_of(article_page(wrap, inner))
    assert [html_text.label_of(block) for block in blocks] == [0, 1, 1, 1, 1, 1, 0, 0][: len(blocks)]


def test_reader_comments_are_no_article():
    page = "<body><article><h1>T</h1><p>Some text of the article, long enough.</p><div class='comments'><article class='comment-body'><p>I say so.</p></article></div></article></body>"
    assert [html_text.label_of(block) for block in html_text.blocks_of(page)] == [1, 1, 0]


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>Some words, as they are.</p></article>"), (None, "u", "<p" * 20_000), (3, "u", "<div>" * 5000 + "deep"), (3, "u", "plain")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit("r"))
    found = html_text.extract_text(pages).collect()
    assert len(found) == 6 and {r["text"] for r in found if r["row"]["page_id"] in (1, 2)} == {""}
    assert html_text.extract_text(pages.where("false")).count() == 0


def test_pipeline(spark, folder, documents):
    """Each stage on what the one before returned, in plain Python from there on."""
    docs, seen = table(spark, folder, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, folder)
        if name != "packing":
            assert result.columns == docs.columns
        seen[name] = [r.asDict() for r in result.collect()]
        docs = spark.createDataFrame(result.collect(), result.schema)
    scores = {r["doc_id"]: r["score"] for r in QUERIES["op1_toxicity"](spark, folder).collect()}
    kept = {d for d, s in scores.items() if s < 0.5}
    assert {r["doc_id"] for r in seen["toxicity"]} == kept and len(seen["toxicity"]) == len(kept)
    classes = defaultdict(list)
    for r in seen["toxicity"]:
        classes["".join(WORD.findall(r["text"] or ""))].append((-len(r["text"] or ""), r["doc_id"]))
    assert sorted(r["doc_id"] for r in seen["exact_dedup"]) == sorted(min(group)[1] for group in classes.values())
    prints = {r["doc_id"]: simhash.fingerprint((r["text"] or "").encode()) for r in seen["exact_dedup"]}
    root = {d: d for d in prints}
    for a in sorted(prints):
        for b in prints:
            if b > a and ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 2:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    assert sorted(r["doc_id"] for r in seen["near_dedup"]) == sorted(set(root.values()))
    mixed = mixing.mix_sources(spark.createDataFrame(seen["near_dedup"], table(spark, folder, "documents").schema), keep=["doc_id"])
    times = {r["doc_id"]: r["times"] for r in mixed.select("row.doc_id", "mix.times").collect() if r["times"]}
    assert Counter(r["doc_id"] for r in seen["mixing"]) == times
    of = {d: t for d, t, *_ in documents}
    expected = Counter()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for doc_id in times:
        ids = tokenizer.encode(of[doc_id] or "", add_special_tokens=False).ids
        for piece, _, length, crc in packing.cut(np.array(ids, "<u4").tobytes(), 2048):
            expected[doc_id, piece, length, crc] += times[doc_id]
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in seen["packing"]) == expected
    assert corpus_pipeline.run(spark, folder).count() == len(seen["packing"])
