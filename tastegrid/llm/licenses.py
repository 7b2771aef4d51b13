"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

The units of a text are its lines, its paragraphs (between blank lines), the whole text, and windows of its words. A
unit is lower case with runs of other than letters and digits as one space. Dice = 2 * shared / (unit + template)
over sets of bigrams; a unit is a match from MIN_DICE on. As Dice is at most 2 * less / (less + more), only templates
between size * MIN_DICE / (2 - MIN_DICE) and the inverse are compared. A match shares so many of a template's
bigrams that it must hold one of a few key words; texts without any are settled by that.

A window finds a notice inside a longer line, or wrapped over some lines of a paragraph: wherever a template's key
word stands in the text, as many words as the template has are laid where it would begin. Of windows that overlap
and match, the best one counts. DataFrame functions only.

Cases: a null or empty text has no matches; a unit of fewer than two words has no bigrams and never matches;
ties in Dice go to the lesser template name; a very long text is one row whose work grows with its length; repeated
rows are scanned alike; an empty table gives an empty result; extra columns pass through unless they carry the name
matches.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, fresh

MIN_DICE = 0.8

#: Licence notices and texts as they stand in files and pages (fixed values).
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    # whole short licences, and standard headers and leading paragraphs of long ones; without titles and holders
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        'compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, '
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        'CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing '
        'permissions and limitations under the License.',
    ),
    (
        "Apache-2.0",
        '2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor '
        'hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable '
        'copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, '
        'sublicense, and distribute the Work and such Derivative Works in Source or Object form.',
    ),
    (
        "BSD-2-Clause",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided '
        'that the following conditions are met: 1. Redistributions of source code must retain the above copyright '
        'notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must '
        'reproduce the above copyright notice, this list of conditions and the following disclaimer in the '
        'documentation and/or other materials provided with the distribution.',
    ),
    (
        "BSD-2-Clause",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided '
        'that the following conditions are met: 1. Redistributions of source code must retain the above copyright '
        'notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must '
        'reproduce the above copyright notice, this list of conditions and the following disclaimer in the '
        'documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE '
        'COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        'LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE '
        'DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, '
        'INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF '
        'SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND '
        'ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR '
        'OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH '
        'DAMAGE.',
    ),
    (
        "BSD-3-Clause",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided '
        'that the following conditions are met: 1. Redistributions of source code must retain the above copyright '
        'notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must '
        'reproduce the above copyright notice, this list of conditions and the following disclaimer in the '
        'documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright '
        'holder nor the names of its contributors may be used to endorse or promote products derived from this '
        'software without specific prior written permission.',
    ),
    (
        "BSD-3-Clause",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided '
        'that the following conditions are met: 1. Redistributions of source code must retain the above copyright '
        'notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must '
        'reproduce the above copyright notice, this list of conditions and the following disclaimer in the '
        'documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright '
        'holder nor the names of its contributors may be used to endorse or promote products derived from this '
        'software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS '
        'AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
        'IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT '
        'SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, '
        'EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR '
        'SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF '
        'LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN '
        'ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    (
        "GPL-2.0",
        'The licenses for most software are designed to take away your freedom to share and change it. By '
        'contrast, the GNU General Public License is intended to guarantee your freedom to share and change free '
        'software--to make sure the software is free for all its users. This General Public License applies to '
        "most of the Free Software Foundation's software and to any other program whose authors commit to using "
        'it. (Some other Free Software Foundation software is covered by the GNU Lesser General Public License '
        'instead.) You can apply it to your programs, too.',
    ),
    (
        "GPL-2.0",
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU '
        'General Public License as published by the Free Software Foundation; either version 2 of the License, or '
        '(at your option) any later version.',
    ),
    (
        "GPL-3.0",
        'The licenses for most software and other practical works are designed to take away your freedom to share '
        'and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom '
        'to share and change all versions of a program--to make sure it remains free software for all its users. '
        'We, the Free Software Foundation, use the GNU General Public License for most of our software; it applies '
        'also to any other work released this way by its authors. You can apply it to your programs, too.',
    ),
    (
        "GPL-3.0",
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU '
        'General Public License as published by the Free Software Foundation, either version 3 of the License, or '
        '(at your option) any later version.',
    ),
    (
        "GPL-3.0",
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU '
        'General Public License as published by the Free Software Foundation, either version 3 of the License, or '
        '(at your option) any later version. This program is distributed in the hope that it will be useful, but '
        'WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR '
        'PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU '
        'General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.',
    ),
    (
        "GPL-2.0",
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU '
        'General Public License as published by the Free Software Foundation; either version 2 of the License, or '
        '(at your option) any later version. This program is distributed in the hope that it will be useful, but '
        'WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR '
        'PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU '
        'General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 '
        'Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.',
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and '
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        'without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell '
        'copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the '
        'following conditions:',
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and '
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        'without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell '
        'copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the '
        'following conditions: The above copyright notice and this permission notice shall be included in all '
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        'KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
        'PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR '
        'ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, '
        'OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "MPL-2.0",
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL '
        'was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.',
    ),
)


def normal(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams(tokens: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False)})


def key_words(templates=TEMPLATES, min_dice: float = MIN_DICE) -> list[str]:
    """Words of which every match of every template holds one.

    A match of a template of b bigrams shares at least need = ceil(min_dice / 2 * (a + b)) of them, with a the
    least size that the bound lets through. Hence b - need + 1 bigrams that hold a key word suffice.
    The longest words are taken first: they are rare in prose, and any choice is sound.
    """
    found = {w for _, text in templates for w in own_key_words(text, min_dice)}
    return sorted(w for w in found if not any(x != w and x in w for x in found))


def whole_key_words(templates=TEMPLATES, min_dice: float = MIN_DICE) -> list[str]:
    """The same where words are looked up whole, not in other words too."""
    return sorted({w for _, text in templates for w in own_key_words(text, min_dice)})


def own_key_words(text: str, min_dice: float = MIN_DICE) -> set[str]:
    """Words of which every match of a template holds one."""
    found: set[str] = set()
    grams = [set(g.split()) for g in bigrams(normal(text))]
    least = max(1, math.ceil(len(grams) * min_dice / (2 - min_dice) - 1e-9))
    spare = len(grams) - math.ceil(min_dice / 2 * (least + len(grams)) - 1e-9) + 1
    by_length = iter(sorted(set(normal(text)), key=lambda w: (-len(w), w)))
    while sum(bool(g & found) for g in grams) < spare:
        found.add(next(by_length))
    return found


def anchors(templates=TEMPLATES, min_dice: float = MIN_DICE) -> list[tuple[str, int, int]]:
    """(word, template, place): where the key words of each template stand in it."""
    out = []
    for i, (_, text) in enumerate(templates):
        keys = own_key_words(text, min_dice)
        out += [(w, i, at) for at, w in enumerate(normal(text)) if w in keys]
    return out


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")


def _pairs(w: Column) -> Column:
    """Each word with the one after it."""
    return F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def _negative_dice(g: Column, t: Column) -> Column:
    return F.size(F.array_intersect(g, t)) * -2.0 / (F.size(g) + F.size(t))


def _window_matches(w: Column, pairs_of_w: Column, known: Column, templates, min_dice: float) -> Column:
    """The best of the windows of words w that match and overlap: dice (negative), license, template."""
    places: dict[str, list[tuple[int, int]]] = {}
    for word, template, at in anchors(templates, min_dice):
        places.setdefault(word, []).append((template, at))
    of_word = F.create_map(*[c for word, found in sorted(places.items()) for c in (F.lit(word), F.array(*[F.struct(F.lit(t).alias("template"), F.lit(at).alias("at")) for t, at in found]))])
    hits = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("word"), i.alias("i"))), lambda h: h["word"].isin(*places))
    # a number for a place and a template: array_distinct hashes numbers, but compares structs one with the other
    laid = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(of_word, h["word"]), lambda a: (h["i"] - a["at"]).cast("long") * len(templates) + a["template"]))))
    laid = F.transform(laid, lambda n: F.struct(F.floor(n / len(templates)).cast("int").alias("start"), F.pmod(n, F.lit(len(templates))).cast("int").alias("template")))
    pairs = lambda b: F.transform(laid, lambda c: rated(b, c, F.element_at(known, c["template"] + 1)))

    def rated(b: Column, c: Column, t: Column) -> Column:
        from_ = F.greatest(c["start"], F.lit(0))
        g = F.array_distinct(F.slice(b, from_ + 1, F.greatest(c["start"] + t["words"] - 1 - from_, F.lit(0))))
        return F.struct(_negative_dice(g, t["grams"]).alias("dice"), t["license"].alias("license"), c["template"].alias("template"), c["start"].alias("start"), (c["start"] + t["words"]).alias("end"))

    width = max(len(normal(t)) for _, t in templates)
    stretch = lambda x: F.floor((x["start"] + width) / width)

    def best(m: Column) -> Column:
        """In order of starts, a window meets only those that begin in its own stretch of `width` words, the one before or
        the one after."""
        by_start = F.array_sort(F.transform(m, lambda x: F.struct(*[x[k].alias(k) for k in ("start", "end", "dice", "license", "template")])))
        return bound(by_start, lambda s: bound(firsts(s), lambda f: bound(dense(f), lambda d: kept(s, d))))

    def firsts(s: Column) -> Column:
        """(stretch, place of its first window)"""
        at = F.transform(s, lambda x, i: F.struct(stretch(x).alias("stretch"), i.alias("i")))
        return F.filter(at, lambda x: (x["i"] == 0) | (stretch(F.get(s, x["i"] - 1)) != x["stretch"]))

    def dense(f: Column) -> Column:
        """By stretch, from 0 on, the place of the first window in it or after."""
        return F.flatten(F.transform(f, lambda x, k: F.array_repeat(x["i"], (x["stretch"] - F.coalesce(F.get(f, k - 1)["stretch"], F.lit(-1))).cast("int"))))

    def kept(s: Column, d: Column) -> Column:
        def beaten(x: Column) -> Column:
            low = F.coalesce(F.get(d, (stretch(x) - 1).cast("int")), F.lit(0))
            high = F.coalesce(F.get(d, (stretch(x) + 2).cast("int")), F.size(s))
            order = lambda y: F.struct(y["dice"], y["license"], y["template"], y["start"])
            return F.exists(F.slice(s, low + 1, high - low), lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]) & (order(y) < order(x)))

        return F.transform(F.filter(s, lambda x: ~beaten(x)), lambda x: F.struct(x["dice"].alias("dice"), x["license"].alias("license"), x["template"].alias("template")))

    matches = F.filter(pairs(pairs_of_w), lambda m: m["dice"] <= -min_dice)
    return F.when(F.exists(w, lambda x: x.isin(*places)), bound(matches, best))


def scanned(docs: DataFrame, templates=TEMPLATES, min_dice: float = MIN_DICE) -> DataFrame:
    """docs with matches: the best (dice, license, template) of each unit that has one, distinct, best first."""
    text = F.coalesce(F.col("text"), F.lit(""))
    known = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(i).alias("template"), F.lit(len(normal(t))).alias("words"), F.array(*map(F.lit, bigrams(normal(t)))).alias("grams")) for i, (name, t) in enumerate(templates)])
    sizes = [len(bigrams(normal(t))) for _, t in templates]
    low, high = min(sizes) * min_dice / (2 - min_dice), max(sizes) * (2 - min_dice) / min_dice
    # every match holds a key word, as a word of its own
    hopeful = lambda w: F.exists(w, lambda x: x.isin(*whole_key_words(templates, min_dice)))
    # lines and paragraphs; the whole text is read from its words, which the windows need too
    units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n\s*\n")))
    in_bounds = lambda a, b: (a >= b * (min_dice / (2 - min_dice)) - 1e-9) & (a * (min_dice / (2 - min_dice)) - 1e-9 <= b)

    def against(g: Column) -> Column:
        near = F.filter(known, lambda t: in_bounds(F.size(g), F.size(t["grams"])))
        rated = F.transform(near, lambda t: F.struct(_negative_dice(g, t["grams"]).alias("dice"), t["license"].alias("license"), t["template"].alias("template")))
        return F.array_min(F.filter(rated, lambda r: r["dice"] <= -min_dice))

    kind = "array<struct<dice:double,license:string,template:int>>"
    none = F.array().cast("array<string>")
    word, pair, gram, window = fresh(docs, "_words", "_pairs", "_grams", "_windows")
    out = docs.withColumn(word, bound(_words(text), lambda w: F.when(hopeful(w), w).otherwise(none)))
    out = out.withColumn(pair, _pairs(F.col(word)))
    held = F.transform(F.filter(F.transform(units, _words), hopeful), lambda w: F.array_distinct(_pairs(w)))
    parts = F.when(F.size(word) > 0, F.concat(held, F.array(F.array_distinct(pair)))).otherwise(F.array().cast("array<array<string>>"))
    out = out.withColumn(gram, F.filter(parts, lambda g: F.size(g).between(low - 1e-9, high + 1e-9)))
    out = out.withColumn(window, F.coalesce(F.when(F.size(word) > 0, _window_matches(F.col(word), F.col(pair), known, templates, min_dice)), F.array().cast(kind)))
    found = F.array_sort(F.array_distinct(F.concat(F.filter(F.transform(gram, against), lambda m: m.isNotNull()), F.col(window))))
    best = F.transform(found, lambda m: F.struct((-m["dice"]).alias("dice"), m["license"].alias("license"), m["template"].alias("template")))
    return out.withColumn("matches", F.when((F.size(gram) > 0) | (F.size(window) > 0), best).otherwise(F.array().cast(kind))).drop(word, pair, gram, window)


def license_report(docs: DataFrame) -> DataFrame:
    """Per document: n_matches, its licences in order of name, the best licence and its Dice coefficient."""
    got = scanned(docs.select("doc_id", "text")).select("doc_id", "matches")
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return got.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.get("matches", 0)["license"].alias("best_license"), F.coalesce(F.get("matches", 0)["dice"], F.lit(0.0)).alias("best_dice"))
