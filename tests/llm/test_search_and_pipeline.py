"""Exact search against all distances, and the pipeline against its stages done plainly."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tastegrid.llm import hamming_search, quality_classifier, quality_rules
from tastegrid.llm.common import table
from tests.llm import plain

SF = "/root/testdata/sf0.001"


def _expected(codes, queries, k):
    out = set()
    for qid, q in set(queries):
        near = sorted({((q ^ c).bit_count() if (q ^ c) >= 0 else (q ^ c & (2**64 - 1)).bit_count(), i) for i, c in codes})[:k]
        out |= {(qid, n + 1, i, d) for n, (d, i) in enumerate(near)}
    return out


@pytest.mark.parametrize("wide_from", [4096, 1])
def test_search(spark, monkeypatch, wide_from):
    """Clusters, many equal codes, far codes; both segment widths."""
    monkeypatch.setattr(hamming_search, "WIDE_FROM", wide_from)
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 2**63, 4)
    flips = lambda n: int(np.bitwise_or.reduce(1 << rnd.integers(0, 62, n)))
    codes = [(i, int(base[i % 4]) ^ flips(i % 5 + 1)) for i in range(150)] + [(1000 + i, int(base[0])) for i in range(40)] + [(2000, 0), (2001, 2**63 - 1)]
    queries = codes[::15] + [(2001, 2**63 - 1)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, code long")
    got = {tuple(r) for r in hamming_search.search(frame(codes), frame(queries), 5).collect()}
    assert got == _expected(codes, queries, 5)


def test_codes_of_vectors(spark):
    rnd = np.random.default_rng(6)
    vectors = [rnd.normal(size=n).tolist() for n in (64, 64, 63, 1)] + [[None, 1.0], [-0.0, 0.0, 5.0]]
    got = {r["id"]: r["code"] for r in hamming_search.binary_codes(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")).collect()}
    for i, v in enumerate(vectors):
        bits = "".join("1" if x is not None and x > 0 else "0" for x in v).ljust(64, "0")
        assert got[i] % 2**64 == int(bits, 2)
    with pytest.raises(Exception, match="more than 64 components"):
        hamming_search.binary_codes(spark.createDataFrame([(1, [1.0] * 65)], "vec_id long, embedding array<float>")).collect()


def test_search_odd_rows(spark):
    rows = [(1, [1.0] * 64), (2, None), (3, []), (None, [1.0]), (4, [float("nan"), 1.0]), (1, [1.0] * 64)]
    codes = hamming_search.binary_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert {r["id"] for r in codes.collect()} == {1, 4} and codes.count() == 2
    assert sorted((r["query_id"], r["rank"], r["neighbour_id"]) for r in hamming_search.search(codes, codes, 10).collect()) == [(1, 1, 1), (1, 2, 4), (4, 1, 4), (4, 2, 1)]
    assert hamming_search.search(codes.limit(0), codes, 3).count() == 0


def test_pipeline_against_plain_stages(spark, tmp_path):
    """The whole pipeline on a table of near copies, shared lines, junk, nulls and long texts, against its stages done
    row by row; then every stage's ids on the way."""
    from tokenizers import Tokenizer

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [tuple(r) for r in docs.collect()]
    shared = "this line stands at the foot of far too many pages of one host"
    rows += [(5000 + i, f"{r[1]}\n{shared}", r[2], "src1", 0) for i, r in enumerate(rows[:12]) if r[1]]
    rows += [(6000, None, None, None, None), (6001, "", "en", None, 0), (6002, "long words of a text " + " ".join(f"w{i}" for i in range(30_000)), "en", None, 1)]
    spark.createDataFrame(rows, docs.schema).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    labels = table(spark, "/root/testdata/sf0.001", "labels")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    got, want = {}, {}
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((found := stage(spark, docs, sf)).collect(), found.schema)
        got[name] = docs.collect()
        assert name == "bpe" or docs.columns == list(found.columns) == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = plain.cleaned([(r[0], r[1], r[3]) for r in rows])
    assert sorted((r["doc_id"], r["text"]) for r in got["quality_rules"]) == sorted(k[:2] for k in kept)
    assert 0 < sum(shared in (k[1] or "") for k in kept) < 6
    model = quality_classifier.fit(spark.createDataFrame(got["quality_rules"], docs_schema(spark)), labels.filter(~quality_classifier.held_out()))
    good = [k for k in kept if plain.vote((k[1] or "").encode(), model, quality_classifier) >= quality_classifier.THRESHOLD]
    assert sorted(r["doc_id"] for r in got["quality_classifier"]) == sorted(k[0] for k in good)
    component = plain.groups([k[:2] for k in good], 5, 80)
    single = [k for k in good if component[k[0]][1] == k[0]]
    assert sorted(r["doc_id"] for r in got["jaccard_join"]) == sorted(k[0] for k in single)
    want = plain.mixed([(i, plain.counts(t)[0], s) for i, t, s in single])
    assert Counter(r["doc_id"] for r in got["mixing"]) == want
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    texts = {k[0]: k[1] for k in single}
    assert Counter(r["doc_id"] for r in got["bpe"]) == want
    for r in got["bpe"]:
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
    whole = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in whole) == Counter((r["doc_id"], tuple(r["ids"])) for r in got["bpe"])


def docs_schema(spark):
    return table(spark, SF, "documents").schema


def test_pipeline_on_an_empty_table(spark, tmp_path):
    table(spark, SF, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SF, "labels").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_removes_lines(spark):
    """A line in 120 documents of a host goes from all but the first; other hosts and lines stay as they are."""
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(20))
    rows = [(i, f"Read  MORE here\n{body(i)}\n\n  kept {i} \nread more\there", "en", "a") for i in range(120)]
    rows += [(200 + i, f"{body(200 + i)}\nread more here", "en", "b") for i in range(3)] + [(300, None, "en", "a"), (None, f"{body(9)}\nRead more here\n", "en", "a")]
    rows.append((1, rows[1][1], "en", "c"))
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.quality_rules_stage(spark, docs, SF).collect()
    assert [r["text"] for r in out if r["source"] == "c"] == [rows[1][1]]
    got = {r["doc_id"]: r for r in out if r["source"] != "c"}
    want = {i: f"{body(i)}\n\n  kept {i} " for i in range(1, 120)} | {0: rows[0][1], None: f"{body(9)}\n"} | {r[0]: r[1] for r in rows[120:123]}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
