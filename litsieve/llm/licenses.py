"""Operator 4 [native]: licence scans by Dice coefficient over word bigrams.

Text is normalised (lowered; words are runs of letters, digits and non-ASCII characters, so line ends are separators like
any other) and becomes the sequence of its word bigrams. A unit is a run of those: for a template of b bigrams, runs of
several lengths at a stride of b / 8 (``sizes``), and Dice is ``2 * overlap / (size of unit + size of template)`` over the
two bags. So a licence is found in a line, over wrapped lines, inside a longer text or line, and as the whole text.

Size bounds prune: at the threshold t a template suits only units of ``b * t / (2 - t)`` to ``b * (2 - t) / t`` bigrams,
so it is not tried on shorter texts, and its units have no other lengths. A unit shares at least ``b * t / (2 - t)`` bigrams with
the template; each distinct bigram of the text can add no more than its number in the template. A first pass sums that bound
for each text and template (one row each is shuffled, no text) and keeps what can pass. Only texts with such a template are
read again for units: they meet the kept keys by broadcast while their counted bytes allow, by a shuffle beyond.

Units that reach the threshold overlap each other. Each bigram of a text goes to the best unit over it (higher Dice, then
longer, then template name, then start), and a unit counts if it is given more than half of its own, so a passage counts
once, for the licence it resembles most. All of it is DataFrame functions.

How much is found: a unit covers a passage but for at most about a sixteenth of the template at its ends, so exact copies
score .93 or more wherever they start, and templates of less than 16 bigrams are tried at every place and length.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, floor
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm.common import BROADCAST_BYTES
from litsieve.storage import materialize

THRESHOLD = 0.8
#: Most template bigrams that are broadcast (about 100 bytes each).
MAX_BROADCAST = 200_000
#: Steps of lengths and places of units, by template.
STEPS = 8
#: Complete texts of the longer licences, a file each.
TEXTS = Path(__file__).parent / "license_texts"

# --- fixed values: short licence statements, notices and the shorter complete texts ---------------------
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org",
    ],
}
#: Licences whose statements are another's with a few words changed: the other's name and the changes, in order.
_UNPORTED = {"4.0 International": "3.0 Unported", "4.0": "3.0"}
NEIGHBOURS = {
    "AGPL-3.0": ("GPL-3.0", {"GNU General": "GNU Affero General"}),
    "LGPL-3.0": ("GPL-3.0", {"GNU General": "GNU Lesser General"}),
    "GPL-2.0": ("GPL-3.0", {"version 3": "version 2"}),
    "LGPL-2.1": ("GPL-3.0", {"GNU General": "GNU Lesser General", "version 3": "version 2.1"}),
    "Apache-1.1": ("Apache-2.0", {"Version 2.0": "Version 1.1", "LICENSE-2.0": "LICENSE-1.1"}),
    "MPL-1.1": ("MPL-2.0", {"v. 2.0": "v. 1.1", "MPL/2.0": "MPL/1.1"}),
    "CC-BY-ND-4.0": ("CC-BY-4.0", {"CC BY": "CC BY-ND", "Attribution": "Attribution-NoDerivatives"}),
    "CC-BY-NC-SA-4.0": ("CC-BY-NC-4.0", {"BY-NC": "BY-NC-SA", "NonCommercial": "NonCommercial-ShareAlike"}),
    "CC-BY-NC-ND-4.0": ("CC-BY-NC-4.0", {"BY-NC": "BY-NC-ND", "NonCommercial": "NonCommercial-NoDerivatives"}),
    "CC-BY-3.0": ("CC-BY-4.0", _UNPORTED),
    "CC-BY-NC-3.0": ("CC-BY-NC-4.0", _UNPORTED),
    "CC-BY-SA-3.0": ("CC-BY-SA-4.0", _UNPORTED),
    "CC-BY-ND-3.0": ("CC-BY-ND-4.0", _UNPORTED),
    "CC-BY-NC-SA-3.0": ("CC-BY-NC-SA-4.0", _UNPORTED),
    "CC-BY-NC-ND-3.0": ("CC-BY-NC-ND-4.0", _UNPORTED),
}
# ---------------------------------------------------------------------------------------------------------
_PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def texts() -> dict[str, list[str]]:
    """All templates by licence: the statements above, those of their neighbours, and the complete text where ``TEXTS`` has one.

    With its neighbours' statements at hand, a licence of a like name or version is given its own name.
    """
    said = dict(TEMPLATES)
    for name, (other, changes) in NEIGHBOURS.items():
        said[name] = [reduce(lambda t, c: t.replace(*c), changes.items(), t) for t in said[other]]
    whole = {f.stem: f.read_text() for f in sorted(TEXTS.glob("*.txt"))}
    return {name: ts + [whole[name]] if name in whole else ts for name, ts in said.items()}


def words(c: Column) -> Column:
    return F.array_remove(F.split(F.lower(c), _PARTS), "")


def grams(w: Column) -> Column:
    """Two words side by side, with a space between; the last entry is null."""
    return F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))


def sizes(size: int, threshold: float = THRESHOLD) -> list[int]:
    """Lengths of the units that are tried for a template of ``size`` bigrams: the two bounds, and steps from ``size`` between."""
    lo, hi = max(1, ceil(size * threshold / (2 - threshold) - 1e-9)), floor(size * (2 - threshold) / threshold + 1e-9)
    step = max(1, size // STEPS)
    return sorted({lo, hi, *range(size, lo, -step), *range(size, hi, step)})


def templates(spark: SparkSession, table: dict[str, list[str]] | None = None) -> DataFrame:
    """``g, template, license, size, times``: how often each template has each bigram."""
    rows = [(f"{name}/{k}", name, t) for name, ts in (table or texts()).items() for k, t in enumerate(ts)]
    t = spark.createDataFrame(rows, "template string, license string, text string")
    t = t.select("template", "license", words(F.col("text")).alias("w"))
    t = t.select("template", "license", (F.size("w") - 1).alias("size"), F.explode(grams(F.col("w"))).alias("g")).where("g is not null")
    return t.groupBy("g", "template", "license", "size").agg(F.count("*").alias("times"))


def scan(docs: DataFrame, known: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, license, n_units, best_dice`` for every document that holds a licence.

    ``n_units`` counts the passages (units that are given more than half of their bigrams) of that licence, ``best_dice`` is the best
    of them. A null or blank text, and one of fewer than two words, matches nothing. Rows equal in id and text are one; rows
    with one id and different texts add up, under null where the id is null; an empty table gives no rows. Columns other than
    doc_id and text are not read.
    """
    spark = docs.sparkSession
    known = templates(spark) if known is None else known
    table = [(r.template, int(r.size)) for r in known.select("template", "size").distinct().collect()]
    n = known.count()
    if not n:
        return spark.createDataFrame([], "doc_id long, license string, n_units long, best_dice double")
    ratio = threshold / (2 - threshold)
    side = F.broadcast(known) if n <= MAX_BROADCAST else known
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where("text is not null")
    own = own.withColumn("k", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("text"))))
    some = own.select("k", words(F.col("text")).alias("w")).select("k", (F.size("w") - 1).alias("n"), F.explode(F.array_distinct(grams(F.col("w")))).alias("g"))
    fits = F.col("n") >= F.col("size") * ratio - 1e-9
    met = some.join(side, "g").where(fits)
    # rows equal in id and text add up here, which only loosens the bound
    bound = met.groupBy("k", "template", "size").agg(F.sum("times").alias("u")).where(F.col("u") >= F.col("size") * ratio - 1e-9)
    few = materialize(bound.groupBy("k").agg(F.collect_set("template").alias("ts")), "licence-keys")
    kept = few.agg(F.count("*").alias("n"), F.sum(32 + 24 * F.size("ts")).alias("width")).first()
    few = F.broadcast(few) if (kept.width or 0) * 2 <= BROADCAST_BYTES else few.hint("shuffle_hash")
    again = own.join(few, "k").dropDuplicates(["k"])
    again = again.select("k", "doc_id", "ts", words(F.col("text")).alias("w"))
    again = again.select("k", "doc_id", "ts", (F.size("w") - 1).alias("n"), F.posexplode(grams(F.col("w"))).alias("at", "g"))
    hit = again.join(side, "g").where(F.array_contains("ts", F.col("template")) & fits)
    grid = spark.createDataFrame([(t, m, max(1, size // STEPS)) for t, size in table for m in sizes(size, threshold)], "template string, len int, step int")
    # all places of a unit of this length over the bigram
    first = F.greatest(F.lit(0).cast("long"), F.expr("(at - len + step) div step"))
    spread = hit.join(F.broadcast(grid), "template").withColumn("place", F.explode(F.sequence(first, F.expr("at div step"))))
    unit, about = ["k", "template", "len", "place"], ["doc_id", "n", "license", "size", "step"]
    overlap = spread.groupBy(*unit, *about, "g").agg(F.least(F.count("*"), F.first("times")).alias("c")).groupBy(*unit, *about).agg(F.sum("c").alias("c"))
    start = F.col("place") * F.col("step")
    cut = overlap.withColumn("start", start).withColumn("m", F.least(F.col("len"), F.col("n") - F.col("start")))
    dice = cut.withColumn("dice", 2 * F.col("c") / (F.col("m") + F.col("size"))).where(F.col("dice") >= threshold)
    dice = dice.select("k", "doc_id", "template", "license", "start", "m", "dice").dropDuplicates(["k", "template", "start", "m"])
    over = dice.withColumn("p", F.explode(F.sequence("start", F.col("start") + F.col("m") - 1)))
    best = F.struct((-F.col("dice")).alias("d"), (-F.col("m")).alias("l"), "template", "start", "license")
    given = over.groupBy("k", "doc_id", "p").agg(F.min(best).alias("b"))
    held = given.groupBy("k", "doc_id", "b").agg(F.count("*").alias("held")).where(2 * F.col("held") > -F.col("b.l"))
    return held.groupBy("doc_id", F.col("b.license").alias("license")).agg(F.count("*").alias("n_units"), F.round(F.max(-F.col("b.d")), 6).alias("best_dice"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL, without the first pass."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(f'{name}/{k}')}, {quote(name)}, {quote(t)})" for name, ts in texts().items() for k, t in enumerate(ts))
    cut = lambda c: f"list_filter(string_split_regex(lower({c}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""WITH t AS (SELECT template, license, {cut("text")} AS w FROM (VALUES {values}) v(template, license, text)),
    tb AS (SELECT template, license, size, x, y, count(*) AS times FROM (SELECT template, license, len(w) - 1 AS size, unnest(w[:-2]) AS x, unnest(w[2:]) AS y FROM t) GROUP BY ALL),
    z AS (SELECT template, len(w) - 1 AS b, greatest(1, (len(w) - 1) // {STEPS}) AS step, greatest(1, ceil((len(w) - 1) * {threshold} / (2 - {threshold}) - 1e-9))::BIGINT AS lo, floor((len(w) - 1) * (2 - {threshold}) / {threshold} + 1e-9)::BIGINT AS hi FROM t),
    grid AS (SELECT DISTINCT template, step, unnest(list_concat([lo, hi], range(b, lo, -step), range(b, hi, step))) AS m FROM z),
    d AS (SELECT row_number() OVER () AS r, * FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
    s AS (SELECT doc_id, r, {cut("text")} AS w FROM d),
    k AS (SELECT doc_id, r, len(w) - 1 AS n, unnest(range(len(w) - 1)) AS p, unnest(w[:-2]) AS x, unnest(w[2:]) AS y FROM s WHERE len(w) > 1),
    h AS (SELECT doc_id, r, n, p, template, license, size, x, y, times FROM k JOIN tb USING (x, y) WHERE n >= size * {threshold} / (2 - {threshold}) - 1e-9),
    e AS (SELECT h.*, m, step, unnest(range(greatest(0, (p - m + step) // step), p // step + 1)) AS place FROM h JOIN grid USING (template)),
    c AS (SELECT doc_id, r, n, template, license, size, m, place * step AS start, x, y, least(count(*), any_value(times)) AS c FROM e GROUP BY ALL),
    q AS (SELECT DISTINCT doc_id, r, template, license, start, least(m, n - start) AS m, 2 * sum(c) / (least(m, n - start) + size)::DOUBLE AS dice FROM c GROUP BY doc_id, r, n, template, license, size, m, start),
    o AS (SELECT *, unnest(range(start, start + m)) AS p FROM q WHERE dice >= {threshold}),
    b AS (SELECT *, row_number() OVER (PARTITION BY r, p ORDER BY dice DESC, m DESC, template, start) AS rank FROM o),
    u AS (SELECT doc_id, r, template, license, start, m, dice FROM b WHERE rank = 1 GROUP BY ALL HAVING 2 * count(*) > m)
    SELECT doc_id, license, count(*)::BIGINT AS n_units, round(max(dice), 6) AS best_dice FROM u GROUP BY doc_id, license"""
