"""Licence scan: passages against licence templates by Dice coefficient over word bigrams, in Spark SQL expressions only.

A text's passages are its lines, its blocks between empty lines, the whole, and windows of consecutive words. Each is normalised (lower case, everything
but letters and digits one space) and made a set of hashed word bigrams. A passage of n bigrams can reach a coefficient
t with a template of m only if t / (2 - t) * m <= n <= (2 - t) / t * m, so templates outside that are never compared.

Windows are at most (2 - t) / t times as long as their template and begin and end with one of its bigrams, as any other
end only lowers the coefficient; they run across lines and blocks. They are tried only where the text as a whole has
enough of a template's bigrams (t / (2 - t) * m), with running counts: a bigram counts at its first place in a window.
Of overlapping windows the best counts (then the longest, then the name), and none that lies in a passage found already.

Scale: a projection without a shuffle; templates are literals of the plan. Edge cases: null and empty texts and passages
of fewer than three words match nothing (license null, dice 0); ties go to the name first in the alphabet; other
columns pass through ``scan`` unless they have the names of the new ones.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: (name, text); one licence may have several.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


def _normal(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()


def _windows(df: DataFrame, least: float, threshold: float) -> DataFrame:
    """df with _picked, windows that don't overlap, as (d, l, name, s, e): minus dice, minus length, name, first and last bigram; and _new, the texts of those in no passage of _found."""
    df = df.withColumn("_words", F.expr(r"split(trim(replace(_norm, '\n', ' ')), ' +')"))
    df = df.withColumn("_seq", F.expr("transform(array(_words), w -> if(size(w) < 2, cast(array() AS array<bigint>), transform(sequence(0, size(w) - 2), i -> xxhash64(w[i], w[i + 1]))))[0]"))
    near = "filter(_templates, t -> size(array_intersect(h, t.pairs)) >= t.low)"
    df = df.withColumn("_near", F.expr(f"transform(array(array_intersect(_seq, flatten(transform(_templates, t -> t.pairs)))), h -> if(size(h) < {least!r}D - 1e-9D, slice(_templates, 1, 0), {near}))[0]"))
    # The place of the same bigram before, or -1.
    before = "transform(array(array_sort(transform(_seq, (h, i) -> named_struct('h', h, 'i', i)))), z -> transform(array_sort(transform(z, (x, k) -> named_struct('i', x.i, 'b', if(k > 0, if(z[k - 1].h = x.h, z[k - 1].i, -1), -1)))), x -> x.b))[0]"
    df = df.withColumn("_before", F.when(F.size("_near") > 0, F.expr(before)))
    state = lambda n, c, dice, e: f"named_struct('n', {n}, 'c', {c}, 'dice', {dice}, 'e', {e})"
    d = "(2D * (a.c + 1) / (a.n + 1 + t.m))"
    grown = f"if(before[k] >= s, a, if(own[k], {state('a.n + 1', 'a.c + 1', f'greatest(a.dice, {d})', f'if({d} > a.dice, k, a.e)')}, {state('a.n + 1', 'a.c', 'a.dice', 'a.e')}))"
    ends = f"aggregate(sequence(s, least(s + t.most, size(before)) - 1), {state('0', '0', '0D', '-1')}, (a, k) -> {grown}, a -> named_struct('d', -a.dice, 'l', s - a.e, 'name', t.name, 's', s, 'e', a.e))"
    starts = f"filter(transform(filter(sequence(0, size(before) - 1), i -> own[i]), s -> {ends}), x -> x.d <= -{threshold!r}D)"
    # Bound by lambdas, so that no lambda's body holds the expression of a column.
    every = f"transform(array(_before), before -> transform(array(_seq), q -> flatten(transform(_near, t -> transform(array(transform(q, h -> array_contains(t.pairs, h))), own -> {starts})[0])))[0])[0]"
    none = "cast(array() AS array<struct<d:double,l:int,name:string,s:int,e:int>>)"
    picked = f"aggregate(array_sort({every}), {none}, (a, x) -> if(exists(a, y -> y.s <= x.e + 1 AND x.s <= y.e + 1), a, array_append(a, x)))"
    df = df.withColumn("_picked", F.when(F.size("_near") > 0, F.expr(picked)).otherwise(F.expr(none)))
    texts = "transform(array(_words), w -> array_distinct(transform(_picked, x -> array_join(slice(w, x.s + 1, x.e - x.s + 2), ' '))))[0]"
    inside = "exists(_found, y -> contains(concat(' ', regexp_replace(y.p, ' +', ' '), ' '), concat(' ', x, ' ')))"
    return df.withColumn("_new", F.expr(f"filter({texts}, x -> NOT {inside})"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs with license, dice (of the best passage) and n_matches (distinct passages that reach the threshold)."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    rows, bounds = [], []
    for name, text in templates:
        words = _normal(text).split()
        pairs = sorted(set(zip(words, words[1:], strict=False)))
        m = len(pairs)
        if m:
            bounds.append((low * m, high * m))
            hashes = ", ".join(f"xxhash64('{a}', '{b}')" for a, b in pairs)
            rows.append(f"named_struct('name', '{name}', 'm', {m}, 'most', {int(high * (len(words) - 1))}, 'low', {low * m!r}D - 1e-9D, 'high', {high * m!r}D + 1e-9D, 'pairs', array({hashes}))")
    if not rows:
        raise ValueError("no template has two words")
    least, most = min(b[0] for b in bounds), max(b[1] for b in bounds)
    df = docs.withColumn("_norm", F.regexp_replace(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"[^\p{L}\p{N}\n]+", " "))
    df = df.withColumn("_parts", F.expr(r"transform(array_distinct(concat(split(_norm, '\n'), split(_norm, '\n[ \n]*\n'), array(_norm))), p -> trim(replace(p, '\n', ' ')))"))
    # A set has at most as many pairs as the passage; repeats only make it smaller, so the upper bound waits for the set.
    df = df.withColumn("_parts", F.expr(f"filter(_parts, p -> length(p) - length(replace(p, ' ', '')) >= {least!r}D - 1e-9D)"))
    df = df.withColumn("_templates", F.expr(f"array({', '.join(rows)})"))
    sets = "transform(_parts, p -> transform(array(split(p, ' +')), w -> named_struct('p', p, 'b', array_distinct(transform(sequence(0, size(w) - 2), i -> xxhash64(w[i], w[i + 1])))))[0])"
    df = df.withColumn("_sets", F.when(F.size("_parts") > 0, F.expr(f"filter({sets}, x -> size(x.b) <= {most!r}D + 1e-9D)")))
    best = (
        "aggregate(_templates, named_struct('dice', 0D, 'name', ''), (a, t) -> if(size(b) >= t.low AND size(b) <= t.high, "
        "transform(array(2D * size(array_intersect(b, t.pairs)) / (size(b) + t.m)), d -> if(d > a.dice OR (d = a.dice AND t.name < a.name), named_struct('dice', d, 'name', t.name), a))[0], a))"
    )
    df = df.withColumn("_found", F.expr(f"filter(transform(coalesce(_sets, array()), x -> named_struct('p', x.p, 'r', transform(array(x.b), b -> {best})[0])), y -> y.r.dice >= {threshold!r}D)"))
    df = _windows(df, min(b[0] for b in bounds), threshold)
    top = F.expr("aggregate(concat(transform(_found, y -> y.r), transform(_picked, y -> named_struct('dice', -y.d, 'name', y.name))), named_struct('dice', 0D, 'name', cast(null AS string)), (a, x) -> if(x.dice > a.dice OR (x.dice = a.dice AND x.name < a.name), x, a))")
    df = df.withColumn("_top", top)
    return df.withColumns({"license": F.col("_top.name"), "dice": F.col("_top.dice"), "n_matches": (F.size("_found") + F.size("_new")).cast("long")}).drop("_norm", "_parts", "_templates", "_sets", "_found", "_words", "_seq", "_near", "_before", "_picked", "_new", "_top")
