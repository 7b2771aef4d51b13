"""Near duplicates, tokens, archives, pages and the classifier against plain versions."""

import html
import json
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tastegrid.llm import bpe, components, html_text, jaccard_join, quality_classifier, shingles, warc
from tests.llm import plain
from tests.llm.test_rows import ODD

SF = "/root/testdata/sf0.001"


def _family(rnd, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randrange(edits)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("n", "percent", "block"), [(4, 85, 256), (5, 80, 4)])
def test_groups_against_all_pairs(docs, monkeypatch, n, percent, block):
    """Families of near copies, a passage that many share, short texts; small blocks make many pairs of blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rnd = random.Random(n)
    words = lambda k: [f"w{rnd.randrange(3000)}" for _ in range(k)]
    texts = [t for size in (30, 60, 120) for t in _family(rnd, words(size), 25, size // 5)]
    passage = " ".join(words(30))
    texts += [" ".join(words(rnd.randrange(5, 60))) + " " + passage for _ in range(40)] + [passage.upper()] * 3
    texts += ["a b", "A  b", "a", "", None, " \n", "one two three four", "é Ä"] + [" ".join(words(20_000))] * 2
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.groups(docs(rows), n, percent).collect()}
    assert got == plain.groups(rows, n, percent)


@pytest.mark.parametrize("cheap", [1, 2, 3, 4])
def test_links_between_demands(docs, monkeypatch, cheap):
    """Pairs just above and below the threshold, one node of each with few partners and the other with more; the
    one's own words come last in its order, the other's come first and stand in 0 to 8 single words."""
    monkeypatch.setattr(jaccard_join, "CHEAP", cheap)
    pairs, texts = [(common, busy) for common in (91, 92, 93) for busy in (0, 1, 2, 4, 8)], []
    for i, (common, busy) in enumerate(pairs):
        both, late, early = ([f"{k}{i}x{j}" for j in range(n)] for k, n in (("b", common), ("l", 100 - common), ("e", 100 - common)))
        texts += [" ".join(both + late), " ".join(both + early), *early[:busy]]
        texts += [" ".join((both if k < 4 else []) + late + [f"r{i}x{k}x{j}" for j in range(800)]) for k in range(12)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.groups(docs(rows, extra=False), 1, 85).collect()}
    assert got == plain.groups(rows, 1, 85)


def test_groups_odd_rows(docs):
    out = jaccard_join.groups(docs(ODD), 4, 85).collect()
    assert len(out) == len(ODD) and {r["component_id"] for r in out if r["doc_id"] is None} == {None}
    assert jaccard_join.groups(docs([])).count() == 0
    left = jaccard_join.deduplicated(docs([(1, "a b c d e f"), (2, "a b c d e f")]).withColumns({c: F.lit("own") for c in ("_id", "_n", "component_id", "key")}))
    assert [(r["doc_id"], r["_id"]) for r in left.collect()] == [(1, "own")]
    left = jaccard_join.deduplicated(docs([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, None), (None, "x y")]))
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 3, 4]


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 30)] + [(200, 201), (201, 200), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 5 for i in range(5, 30)} | {200: 200, 201: 200}


def test_shingles_of_long_words_and_texts(monkeypatch):
    """Pieces of any length give the same sets, words that lie across them too."""
    texts = [b"a" * 1000 + b" b c d", b"x y z " * 300, b"", b"q" * 37]
    want = shingles.shingle_sets(texts, 4)
    for piece in (1, 7, 64):
        monkeypatch.setattr(shingles, "PIECE", piece)
        assert all((a == b).all() for a, b in zip(shingles.shingle_sets(texts, 4), want, strict=True))


def test_products_in_turns(monkeypatch):
    rnd = np.random.default_rng(1)
    tokens = [np.unique(rnd.integers(-(2**62), 2**62, 40)) for _ in range(6)]
    tokens = [np.unique(np.concatenate((t, tokens[0][: 5 * i]))) for i, t in enumerate(tokens)]
    want = [[len(np.intersect1d(a, b)) for b in tokens] for a in tokens]
    for most in (1 << 20, 50):
        monkeypatch.setattr(jaccard_join, "PRODUCT_TOKENS", most)
        got = jaccard_join._shared_counts(tokens)
        assert all(got[i][j] == want[i][j] for i in range(6) for j in range(6) if i != j)


def test_shingles_do_not_depend_on_batches():
    texts = [b"A b  c d e", b"", b"a B c d e", b"x", b"a b c d"]
    together = shingles.shingle_sets(texts, 4)
    assert all((a == shingles.shingle_sets([t], 4)[0]).all() for a, t in zip(together, texts, strict=True))
    assert (together[0] == together[2]).all() and [len(s) for s in together] == [2, 0, 2, 1, 1]


@pytest.fixture(scope="module")
def encoder():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return bpe.Encoder(json.load(f), *bpe.classes())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def _ids(encoder, text):
    return np.frombuffer(b"".join(encoder.encode(text)), dtype="<i4").tolist()


def test_tokens_as_the_library(encoder, library, monkeypatch):
    rnd = random.Random(3)
    odd = ["", " \n", "İstanbul ΣΑΣ", "it's we'll I'd 'S", "<|endoftext|>a<|startoftext|>", "²½Ⅷ 12 3", "á é", "\x1c x", "a b", "日本語のテキスト" * 9, "!!'s!!", "a_b", "😀👩‍👩‍👧", "<|endof", "ab" * 9000, "z" * 70_001, "!" * 70_000 + "'s", "'ll" * 30_000]
    odd += ["".join(rnd.choice("ab'sldté \n!<|>endoftx1²ß") for _ in range(rnd.choice([5, 30, 200]))) for _ in range(500)]
    assert all(_ids(encoder, t) == library.encode(t, add_special_tokens=False).ids for t in odd)
    monkeypatch.setattr(bpe, "WINDOW_CHARS", 16)
    monkeypatch.setattr(bpe, "MEMO_WORD", 4)
    monkeypatch.setattr(bpe, "BLOCK", 8)
    short = bpe.Encoder.__new__(bpe.Encoder)
    short.__dict__ |= encoder.__dict__ | {"memo": bpe.Memo(encoder)}
    assert all(_ids(short, t) == library.encode(t, add_special_tokens=False).ids for t in odd[-500:])


def test_lookahead_holds(encoder):
    """Tokens settled from a prefix stand in the whole, whatever follows."""
    merges, rnd = encoder.merges, random.Random(5)
    for _ in range(20):
        word = "".join(rnd.choice("etaoinshr") for _ in range(merges.lookahead + bpe.BLOCK + 2000))
        machine = bpe.WordTransducer(merges)
        settled = machine.feed(encoder.word_symbols(word[:-500]))
        whole = merges.merged([*encoder.word_symbols(word)[:-1], word[-1] + merges.suffix])
        assert settled == whole[: len(settled)] and len(machine.pending) <= merges.lookahead + 1 + bpe.BLOCK


def test_decoding(encoder, library):
    text = "Hello, wörld! 😀 it's"
    ids = _ids(encoder, text)
    assert bpe.Decoder(encoder.merges).feed(ids) == library.decode(ids, skip_special_tokens=False)
    machine = bpe.Decoder(encoder.merges, as_text=True)
    assert "".join([machine.feed([i]) for i in ids] + [machine.finish()]) == "hello , wörld ! 😀 it 's "


def test_coded_rows(docs, library):
    out = bpe.coded(docs(ODD), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(out) == len(ODD)
    for r in out:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want) and r["decoded"] == library.decode(want, skip_special_tokens=False) and r["extra"] == "own"
    assert bpe.coded(docs([]), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_archives(spark):
    rows = [(3, "http://a/ü", "<p>x"), (1, "http://b", "<p>x"), (2, None, None), (5, "u", ""), (9, "u", "y" * 300_000), (9, "u", "y" * 300_000), (10, "u", "<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_bytes", F.lit("own"))
    out = warc.read_archives(warc.write_archives(pages), keep_payload=True).collect()
    by = {}
    for r in out:
        by.setdefault(r["page_id"], []).append(r)
    assert {k: (v[0]["record_type"], v[0]["refers_to"]) for k, v in by.items()} == {1: ("response", None), 3: ("revisit", 1), 10: ("revisit", 1), 2: ("response", None), 5: ("revisit", 2), 9: ("response", None)}
    assert len(by[9]) == 2 and by[9][0]["payload"] == b"y" * 300_000 and by[3][0]["payload_bytes"] == 4
    long_only = warc.read_archives(warc.write_archives(pages, min_revisit_bytes=5)).filter("record_type = 'revisit'")
    assert long_only.count() == 0
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_broken_archives():
    import io

    good = warc.member(warc.record(1, "u", b"payload")) + warc.member(warc.record(2, "u", b"payload", 1))
    read = lambda data: [warc.read_record(m, True) for m in warc.members(io.BytesIO(data))]
    assert [r["record_type"] for r in read(good)] == ["response", "revisit"]
    bad = warc.record(1, "u", b"payload").replace(b"payload\r\n", b"pAyload\r\n")
    for data in (warc.member(bad), good[:-5], warc.member(warc.record(1, "u", b"x")[:-1]), warc.member(b"HTTP/1.1\r\n\r\n")):
        with pytest.raises((warc.Corrupt, zlib.error)):
            read(data)


def test_main_text_of_pages():
    """The generated pages: the paragraphs of the article and nothing else."""
    for page in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall():
        article = page[0].split("<article>")[1].split("</article>")[0]
        parts = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in re.split(r"</?(?:p|h1)>", article))
        assert html_text.main_text(page[0]) == "\n".join(p for p in parts if p)


def test_main_text_cases(spark):
    for page in html_text.LABELLED:
        bare = re.sub(r"(?<=>)[+-]", "", page)
        wanted = [b for b, marked in zip(html_text.blocks(bare), html_text.blocks(page), strict=True) if "".join(marked.raw).lstrip()[0] == "+"]
        assert [x for x in html_text.main_text(bare).split("\n") if x] == [" ".join("".join(b.raw).split()) for b in wanted]
    cases = {None: "", "": "", "<p>": "", "<article>a<b>b</b>&amp;&nbsp; c<br>d<p>e": "ab& c d\ne", "<article><p>x<script>var a='</p>'</script>y<!-- z": "xy", "<main><p>k</p><style>p{": "k", "<article><p>a > b < c</p></article>": "a > b < c"}
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(cases)] + [(99, "<article><p>" + "long " * 60_000)], "page_id long, html string").withColumn("text", F.lit("own"))
    got = {r["page_id"]: r["text"] for r in html_text.extracted(rows).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and len(got[99]) == 5 * 60_000 - 1


def test_tree_asks_for_density_and_neighbours():
    """On pages whose elements tell nothing, main text is told by link density and by the blocks around."""
    used = html_text.columns_used(html_text.tree())
    assert {2, 3} <= used and used & {4, 5, 6, 7}
    long = "The ice came early that year and the boats that had not been drawn up were caught in it and broken before the month was out."
    page = f"<div><a>All news</a></div><div><a>Five boats that were lost in the ice of other years and the men who sailed them to the north</a></div><p>{long}</p><p>It was bitter.</p><p>{long[::-1]}</p><div><a>Next</a></div><p>Top of page</p><div><a>Help</a></div>"
    assert html_text.main_text(page) == "\n".join((long, "It was bitter.", long[::-1]))
    linked = page.replace(f"<p>{long}</p>", f"<p><a>{long}</a></p>")
    assert long not in html_text.main_text(linked)
    alone = page.replace(f"<p>{long[::-1]}</p>", "").replace(f"<p>{long}</p>", "")
    assert html_text.main_text(alone) == ""
    inside = "<article><header>Site</header><p>Short.</p><p><a>A linked line</a></p><nav><a>One</a></nav></article>"
    assert html_text.main_text(inside) == "Short.\nA linked line"


def _stripped(page):
    """A page whose elements tell nothing: block tags are <div>, without attributes, scripts and title."""
    page = re.sub(r"<(script|style|title)\b.*?</\1>", "", page, flags=re.S)
    return re.sub(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>", lambda m: f"<{m[1]}{m[2] if m[2].lower() in ('a', 'b', 'br', 'html', 'head', 'body', 'meta') else 'div'}>", page)


def _on_stripped_pages(model, columns=()):
    """(blocks of articles, those lost, blocks wrongly taken) with some features set to 0."""
    total = lost = wrong = 0
    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        article = page.split("<article>")[1].split("</article>")[0]
        want = Counter(t for p in re.split(r"</?(?:p|h1)>", article) if (t := " ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split())))
        found = html_text.blocks(_stripped(page))
        rows = html_text.features(found)
        rows[:, list(columns)] = 0
        got = Counter(" ".join("".join(b.raw).split()) for b, row in zip(found, rows.tolist(), strict=True) if html_text.is_main(model, row))
        total, lost, wrong = total + want.total(), lost + (want - got).total(), wrong + (got - want).total()
    return total, lost, wrong


def test_pages_whose_elements_tell_nothing():
    """Words, link density and neighbours alone find the articles; without density and neighbours they are not found."""
    total, lost, wrong = _on_stripped_pages(html_text.tree())
    assert total > 2000 and lost <= 0.05 * total and wrong <= 0.02 * total
    table = [(html_text.features(html_text.blocks(re.sub(r"(?<=>)[+-]", "", p))), ["".join(b.raw).lstrip()[0] == "+" for b in html_text.blocks(p)]) for p in html_text.LABELLED]
    x, y = np.concatenate([f for f, _ in table]), np.array([v for _, f in table for v in f], dtype=float)
    x[:, 3:8] = 0
    total, lost, wrong = _on_stripped_pages(html_text.grow(x, y), range(3, 8))
    assert lost + wrong > 0.2 * total


def test_links_around_blocks():
    """A link that holds blocks links them all, up to its end or that of the element that it began in."""
    density = lambda page: [(b.words, b.linked) for b in html_text.blocks(page)]
    assert density("<a href=x><div>one two</div><p>three</p></a><p>four</p>") == [(2, 2), (1, 1), (1, 0)]
    assert density("<div><a><h3>one</h3><p>two three</div><p>four</p>") == [(1, 1), (2, 2), (1, 0)]
    assert density("<li><a>one<li>two</li><p>a <a>b <br>c</a> d</p>") == [(1, 1), (1, 0), (4, 2)]


def test_many_repeated_payloads(spark, monkeypatch):
    """Beyond the bound of a broadcast the repeats find their rows by id and digest."""
    rows = [(i, "u", f"<p>{i % 7}" if i % 3 else None) for i in range(60)] + [(12, "u", "<p>1"), (12, "u", "<p>1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_digest", F.lit("own"))
    few = sorted(map(str, warc.with_revisits(pages).collect()))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert sorted(map(str, warc.with_revisits(pages).collect())) == few and len(few) == 62


def test_registered_tokens(spark, library):
    """The registered query on its whole table, both digests."""
    from hashlib import sha256

    from tastegrid.llm import queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.QUERIES["op5_bpe"](spark, SF).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_other_tokenizer_files(tmp_path):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    bpe.check_form(spec)
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": {"type": "ByteLevel"}}):
        with pytest.raises(ValueError, match="another form"):
            bpe.check_form(spec | change)


def test_memo_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 5000)
    memo = bpe.Memo(encoder)
    words = [f"w{i}" for i in range(500)] + ["again"] * 5
    assert [memo[w] for w in words] == [encoder.word_ids(w) for w in words]
    assert len(memo) + len(memo.old) <= 2 * 5000 // bpe.ENTRY_BYTES + 2


def test_classifier_against_all_cosines(spark):
    """The registered query, all rows, against counts, cosines and votes done plainly."""
    from tastegrid.llm import queries

    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.fit(d, labels.filter(~quality_classifier.held_out()))
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    out = queries.QUERIES["op10_quality_classifier"](spark, SF).collect()
    assert len(out) == len(texts)
    for r in out:
        assert abs(r["score"] - plain.vote((texts[r["doc_id"]] or "").encode(), model, quality_classifier)) < 1e-9
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7)


def test_classifier_ties(spark, docs):
    """Many equal vectors with either label: a score depends on the text alone, whatever stands beside it."""
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int")
    rows = [(i, f"same words here {'x ' * (i // 45)}") for i in range(90)] + [(200 + i, f"same words here {'y ' * (i % 7)}") for i in range(60)]
    model = quality_classifier.fit(docs(rows), labels)
    together = {r["doc_id"]: r["score"] for r in quality_classifier.scored(docs(rows).repartition(1), model).collect()}
    apart = {r["doc_id"]: r["score"] for r in quality_classifier.scored(docs(rows).repartition(13), model).collect()}
    one = {r["doc_id"]: r["score"] for i in (3, 60, 205) for r in quality_classifier.scored(docs([r for r in rows if r[0] == i]), model).collect()}
    assert together == apart and all(together[i] == s for i, s in one.items()) and len(set(together.values())) > 1


def test_classifier_on_held_out_rows(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality_classifier.quality_scores(d, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(out) > 60 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert sum(r["predicted"] == r["quality"] for r in out) / len(out) >= 0.97


def test_classifier_odd_rows(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    train = docs([(i, "clean words of prose stand here" if i % 2 else "JUNK!!! JUNK!!! ###") for i in range(40)] + [(100 + (r[0] or 0), r[1]) for r in ODD])
    out = {r["doc_id"]: r for r in quality_classifier.quality_scores(train, labels).collect()}
    assert out[1]["score"] > 0.9 and out[2]["score"] < 0.1 and 0 < out[103]["score"] < 1
    none = quality_classifier.quality_scores(docs(ODD), labels.limit(0)).collect()
    assert len(none) == len(ODD) and {r["score"] for r in none} == {0.5}
    assert quality_classifier.quality_scores(docs([]), labels).count() == 0


def test_terms_do_not_depend_on_batches():
    texts = [b"One two two.", b"", b"a", "é é é".encode(), b"A\nB !!"]
    assert (quality_classifier.term_counts(texts) == np.vstack([quality_classifier.term_counts([t]) for t in texts])).all()
