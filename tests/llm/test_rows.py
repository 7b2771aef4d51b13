"""Sharding, mixing, quality rules and licences on small tables: nulls, empty and long texts, ties, repeats."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.llm import licenses, mixing, quality_rules, sharding
from tests.llm import plain

ODD = [(1, "one two three"), (2, None), (3, ""), (4, " \n\t"), (1, "one two three"), (None, "null id here"), (7, "x " * 30_000), (8, "é ü z")]


def test_sharding_odd_rows(docs):
    rows = sharding.sharded_documents(docs(ODD)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
    by = Counter(r["shard"] for r in rows)
    for shard, n in by.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {8}
    assert next(r for r in rows if r["doc_id"] == 8)["text_crc32"] == zlib.crc32("é ü z".encode())


def test_slots_beside_clashing_names(docs):
    names = ("_offset", "_s", "_b", "_n", "_bucket", "slot")
    df = docs(ODD).withColumns({c: F.lit("own") for c in names}).withColumn("shard", F.lit(3))
    rows = sharding.with_slots(df, "shard", "doc_id").collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(ODD))) and {r["_offset"] + r["_s"] + r["_bucket"] for r in rows} == {"ownownown"}


def test_sharding_empty(docs):
    assert sharding.sharded_documents(docs([])).count() == 0


def test_law_for_whole_regions_only(docs):
    for n in (8, 16):
        assert all(r["grown_shard"] in (r["shard"], n) for r in sharding.sharded_documents(docs([(i, "x") for i in range(300)]), n).collect())
    with pytest.raises(ValueError, match="multiple of 8"):
        sharding.sharded_documents(docs([(1, "x")]), 25)


def test_sharding_shares_and_movement(spark):
    """Shares follow weights; a change of one weight moves rows only into or out of its subtree."""
    tree = [sharding.Leaf(f"g{i // 4}", f"k{i // 2}", i, 1.0 + i % 3) for i in range(8)]
    changed = [sharding.Leaf(x.region, x.rack, x.shard, 6.0 if x.shard == 3 else x.weight) for x in tree]
    rows = sharding.shard_rows(spark.range(20_000).toDF("id"), "id", tree, changed).collect()
    total = sum(x.weight for x in tree)
    for leaf in tree:
        share = sum(r["shard"] == leaf.shard for r in rows) / len(rows)
        assert abs(share - leaf.weight / total) < 0.015
    grew = {x.shard for x in tree if x.region == "g0"}
    moved = [(r["shard"], r["grown_shard"]) for r in rows if r["shard"] != r["grown_shard"]]
    assert moved and all(b in grew for _, b in moved)
    assert all(b == 3 or b == 2 for a, b in moved if a in grew)


def test_quota_tree_is_exact():
    quotas = np.array([100, 0, 7, 1234])
    shares = mixing.split_quotas(quotas, 5)
    assert (shares.sum(axis=0) == quotas).all() and (shares >= 0).all()
    assert set(shares.sum(axis=1)) <= {quotas.sum() // 5, quotas.sum() // 5 + 1}
    assert (mixing.split_quotas(quotas, 5) == shares).all()


def test_quota_tree_draws_at_random():
    """A shard's blocks of a source spread as a hypergeometric draw does: mean and variance over many sources."""
    n, each, shards = 400, 64, 16
    shares = mixing.split_quotas(np.full(n, each), shards).astype(float)
    p = 1 / shards
    assert abs(shares.mean() - each * p) < 1e-9
    want = each * p * (1 - p) * (n * each - each) / (n * each - 1)
    assert abs(shares.var() / want - 1) < 0.1


def test_mixing_targets_and_takes(docs):
    rows = [(i, "w " * (i % 13 + 1), f"s{'abcde'[min(4, i % 11)]}") for i in range(300)] + [(1000, "tiny", "sA"), (1001, None, None), (1002, "a b", None), (5, "w " * 6, "sa")]
    sized = mixing.sized(docs(rows).select("doc_id", "text", "source"))
    out = mixing.mix(sized).collect()
    assert len(out) == len(rows)
    names = sorted({r["source"] for r in out if r["source"]}, key=str.encode) + [None]
    sizes = [sum(r["size"] for r in out if r["source"] == n) for n in names]
    want = plain.water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    for n, s, t in zip(names, sizes, want, strict=True):
        mine = [r for r in out if r["source"] == n]
        assert all(r["source_size"] == s and math.isclose(r["target"], t, rel_tol=1e-9) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - t) <= 1
    assert all(r["taken"] <= 3 * r["size"] for r in out)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(sized.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in out}
    blocks = {}
    for r in out:
        for c in r["copies"]:
            assert blocks.setdefault((r["source"], c["block"]), c["shard"]) == c["shard"]


def test_mixing_whole_copies_and_empty(docs):
    sized = mixing.sized(docs([(i, "w " * 10, "a" if i % 3 else "b") for i in range(60)]).select("doc_id", "text", "source"))
    assert all(r["words"] == r["size"] for r in mixing.drawn(mixing.mix(sized, cut="whole")).collect())
    assert mixing.mix(mixing.sized(docs([], extra=False))).count() == 0
    assert [r["taken"] for r in mixing.mix(mixing.sized(docs([(1, None), (2, "")], extra=False))).collect()] == [0, 0]


def test_mixing_shards(docs):
    """The rows bear out the tree: blocks are disjoint, shards differ by one block at most, quotas are exact, and a
    shard's copies stand together in an order that is neither that of ids nor that of blocks."""
    rows = [(i, "w " * (i % 5 + 1), f"s{i % 3}") for i in range(900)]
    mixed = mixing.mix(mixing.sized(docs(rows, extra=False)), n_shards=8, block_words=6).cache()
    blocks, takes = {}, {}
    for r in mixed.collect():
        takes[r["source"]] = math.floor(r["target"] + 0.5)
        for c in r["copies"]:
            assert blocks.setdefault((r["source"], c["block"]), c["shard"]) == c["shard"]
    # texts are shorter than a block, so a copy begins in every block but perhaps a source's last
    quotas = {s: -(-t // 6) for s, t in takes.items()}
    want = mixing.split_quotas(np.array([quotas[s] for s in sorted(quotas)]), 8)
    for k, s in enumerate(sorted(quotas)):
        got = Counter(shard for (source, _), shard in blocks.items() if source == s)
        assert quotas[s] - 1 <= sum(got.values()) <= quotas[s]
        assert all(0 <= want[shard, k] - got[shard] <= 1 for shard in range(8)) and len(set(want[:, k])) > 1
    out = [r for part in mixing.shuffled(mixed).rdd.glom().collect() for r in part]
    assert Counter((r["doc_id"], r["copy"]) for r in out) == Counter((r["doc_id"], c["copy"]) for r in mixed.collect() for c in r["copies"])
    assert [r["shard"] for r in out] == sorted(r["shard"] for r in out)
    first = [(r["source"], r["block"]) for r in out if r["shard"] == 0]
    assert first != sorted(first) and len(set(first[: len(first) // 2]) & set(first[len(first) // 2 :])) > 5


def test_mixing_clashing_names(docs):
    df = mixing.sized(docs([(i, "w " * 5, "ab"[i % 2]) for i in range(40)], extra=False)).withColumns({c: F.lit("own") for c in ("target", "source_size", "_take", "_plan", "_bucket", "_h", "copies", "shard", "words")})
    out = mixing.mix(df)
    assert out.count() == 40 and {r["_plan"] for r in out.collect()} == {"own"} and out.filter("target > 50").count() > 0
    assert mixing.shuffled(out).count() >= 30


def test_quality_counts(docs):
    texts = [r[1] for r in ODD] + ["a b c d e a b c d e a", "l\nl\nl\n\n", "#*$%&|<> a", "a b c d e f " * 4, "\x0b\x0c x", "😀 y"]
    got = {r["doc_id"]: r for r in quality_rules.judged(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain.counts(t), (i, t[:40] if t else t)
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["extra"] == "own"


def test_quality_depletion(docs):
    """Shared lines go from all but the first document; copies of a text count once; other hosts are their own."""
    shared = "this very line stands in far too many documents of the host\n"
    rows = [(i, shared + f"own{i} " * 2 + f"word{i}") for i in range(30)] + [(100 + i, "a unique text with words enough to pass all of the rules " + str(i), "s1") for i in range(3)] + [(200 + i, "copied text of more than ten words that stands here many times", "s2") for i in range(40)]
    out = {r["doc_id"]: r for r in quality_rules.judged(docs(rows), min_left=0.5, min_documents=10, share=0.1).collect()}
    assert out[0]["kept"] and not any(out[i]["kept"] for i in range(1, 30))
    assert all(out[i]["kept"] for i in [*range(100, 103), *range(200, 240)])
    assert out[5]["n_removed_words"] == len(shared.split())
    assert quality_rules.judged(docs([])).count() == 0


def test_limits_by_host_size(docs):
    """The limit is a share of the host's documents, never under the least and never over the most."""
    rows = [(i, "\n".join(f"line {k} of the host" for k in range(i, 40)) + f"\nalone {i} " + "w " * 20, "a") for i in range(40)]
    for least, share, most in ((3, 0.02, 1000), (3, 0.5, 1000), (3, 0.5, 9)):
        limit = max(least, min(most, share * 40))
        got = {r["doc_id"]: r["n_removed_words"] for r in quality_rules.judged(docs(rows), min_documents=least, share=share, most_documents=most).collect()}
        # line k stands in documents 0 to k
        assert got == {i: sum(5 for k in range(i, 40) if k + 1 > limit and i > 0) for i in range(40)}


def test_rules_clashing_names(docs):
    rows = [(i, f"shared by all of them\nown line {i} " + " ".join(f"x{i}y{k}" for k in range(12))) for i in range(20)]
    names = ("_id", "_removed", "_words", "_key", "gone", "host", "document", "line", "n", "first", "kept")
    df = docs(rows, extra=False).withColumns({c: F.lit("own") for c in names})
    out = quality_rules.judged(df).collect()
    assert len(out) == 20 and sum(r["n_removed_words"] for r in out) == 19 * 5 and {r["_removed"] for r in out} == {"own"}
    back = quality_rules.cleaned(df)
    assert back.columns == df.columns and {r["kept"] for r in back.collect()} == {"own"}


def test_licenses(docs):
    rows = [(1, "Some text.\nReleased under the MIT License.\nmore"), (2, "released UNDER the mit license"), (3, None), (4, ""), (5, "under the license of nobody"), (6, "Licensed under CC BY 4.0."), (7, "Licensed under CC BY-NC 4.0."), (8, "x " * 40_000 + "\nAll rights reserved."), (9, "This work is licensed under the GNU\nGeneral Public License, version 3.\n\nend")]
    out = {r["doc_id"]: r["matches"] for r in licenses.scanned(docs(rows)).collect()}
    first = {k: v[0]["license"] if v else None for k, v in out.items()}
    assert first == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: "CC-BY-4.0", 7: "CC-BY-NC-4.0", 8: "Proprietary", 9: "GPL-3.0"}
    assert out[2][0]["dice"] == 1.0
    assert licenses.scanned(docs([])).count() == 0


def test_planted_notices(docs):
    """Every template within a line of prose, wrapped over commented lines of a paragraph, and with a word in 25
    changed: its licence is found in nine of ten at least. Prose alone has none."""
    rnd = np.random.default_rng(4)
    prose = lambda n: " ".join("".join(rnd.choice(list("etaoinshrdlu"), rnd.integers(2, 9))) for _ in range(n))
    rows, want = [], {}
    for name, text in licenses.TEMPLATES:
        words = text.split()
        noisy = [prose(1) if rnd.random() < 0.04 else w for w in words]
        lines = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
        for planted in (f"{prose(30)} {text} {prose(20)}", "\n".join(f"# {x}" for x in [prose(9), *lines, prose(7)]), f"{prose(12)} {' '.join(noisy)} {prose(40)}"):
            want[len(rows)] = name
            rows.append((len(rows), f"{prose(60)}\n{planted}\n{prose(50)}"))
    rows += [(10_000 + i, prose(400)) for i in range(30)]
    out = {r["doc_id"]: {m["license"] for m in r["matches"]} for r in licenses.scanned(docs(rows)).collect()}
    assert sum(want[i] in out[i] for i in want) >= 0.9 * len(want)
    assert not any(out[i] for i in range(10_000, 10_030))


def test_key_words_are_sound():
    """Whatever matches a template holds a key word: the bigrams without one are too few for the least Dice."""
    keys = licenses.key_words()
    for _, text in licenses.TEMPLATES:
        grams = licenses.bigrams(licenses.normal(text))
        without = [g for g in grams if not any(k in g for k in keys)]
        assert 2 * len(without) / (len(without) + len(grams)) < licenses.MIN_DICE


def test_whole_rows_come_back(docs):
    df = docs([(1, "a b"), (1, "a b")])
    assert quality_rules.judged(df).filter(F.col("doc_id") == 1).count() == 2


def test_whole_licences(docs):
    """Licence texts as files and headers have them: wrapped, in comments, with titles and holders."""
    mit = """MIT License

Copyright (c) 2020 Foo

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
    apache = """# Copyright 2020 Foo
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
    code = "\n\n" + "\n".join(f"x{i} = f{i}(y{i})" for i in range(200))
    rows = [(1, mit), (2, mit + code), (3, apache), (4, apache + code), (5, gpl + code), (6, code)]
    out = {r["doc_id"]: [m["license"] for m in r["matches"]] for r in licenses.scanned(docs(rows)).collect()}
    assert {i: got[:1] for i, got in out.items()} == {1: ["MIT"], 2: ["MIT"], 3: ["Apache-2.0"], 4: ["Apache-2.0"], 5: ["GPL-3.0"], 6: []}
    whole = {t: licenses.bigrams(licenses.normal(text)) for t, (_, text) in enumerate(licenses.TEMPLATES)}
    assert max(map(len, whole.values())) > 100


def test_many_notices_in_one_text(spark):
    """A hundred thousand notices one after the other: windows are held against their neighbours only."""
    import time

    line = "All rights reserved.\n"
    df = spark.createDataFrame([(1, line * 100_000), (2, line), (3, "plain text")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in licenses.license_report(df).collect()}
    assert time.time() - began < 60
    assert got[1]["licenses"] == got[2]["licenses"] != "" and got[1]["best_dice"] == 1.0 and got[3]["n_matches"] == 0
