"""Operator 8: license scans by diagonal voting.

Every whole text is split into words (letters, digits and non-ASCII characters after lower-casing A-Z). The rolling hashes of all
its runs of `k` words are Spark-joined to the template positions (a broadcast of the job's parameters). A shared k-gram at word i of
the text and word j of template t is a vote for the diagonal (t, i - j). Votes are aggregated by diagonal, neighbouring diagonals (at
most `drift` apart: a few words inserted or lost) are merged, and the merged span is verified: the distinct template positions it
explains must be at least `least` of the template's k-grams, or, for a part of a long text, at least `long_part` positions and
`least` of those between the first and the last of them. The template's label is then added to the base labels.

Base labels come from whole phrases standing in the text, which are counted one by one. `score` is the largest share of a template,
or of a verified part, that is explained, 1 where a base phrase stands, 0 without evidence. Votes of a text are aggregated before
they meet, so a text of any length, or one that repeats a licence many times, leaves a row per diagonal.

Null, empty and blank texts have no words and no labels. Rows that repeat an id are scanned each and get a row each. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import wordhash as W

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: (label, words of a license or of a usual notice)
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
     1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
     2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
     3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
     this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
     in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption
     however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
     the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
     in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
     whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
     permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
     1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required
     2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software
     3 this notice may not be removed or altered from any source distribution"""),
    ("apache", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
     unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
     see the license for the specific language governing permissions and limitations under the license"""),
    ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
     this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
     you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"""),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means
     in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors
     we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"""),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]


def _hashes(text: str) -> np.ndarray:
    (_, _, buf, off), *_ = W.blocks(pa.array([text], pa.large_utf8()))
    return W.words(buf, off, W.FOLDED, W.ALNUM)[0]


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", k: int = 3, least: float = 0.7, drift: int = 3, long_part: int = 24) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score. Phrases and templates are a parameter
    of a job, not data: they and their positions are broadcast."""
    spark = docs.sparkSession
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    wanted: dict[int, dict[int, str]] = {}
    for text, label in phrases.items():
        h = _hashes(text)
        wanted.setdefault(len(h), {})[int(W.window_hashes(h, len(h))[0])] = label
    places = []
    for t, (label, text) in enumerate(templates):
        h = _hashes(text)
        grams = W.window_hashes(h, k).view(np.int64)
        places += [(int(g), t, j, len(grams), label) for j, g in enumerate(grams)]
    positions = spark.createDataFrame(places, "gram long, t int, j int, size int, label string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in W.blocks(batch.column(2)):
                h, _, _, rows = W.words(buf, off, W.FOLDED, W.ALNUM)
                row = np.repeat(np.arange(hi - lo), np.diff(rows))
                base: dict[int, list[tuple[int, str]]] = {}
                for size, by in wanted.items():
                    w = W.window_hashes(h, size)
                    for g, label in by.items():
                        for p in np.flatnonzero(w == np.uint64(g)).tolist():
                            if row[p] == row[p + size - 1]:
                                base.setdefault(int(row[p]), []).append((p - int(rows[row[p]]), label))
                own = [base.get(r, []) for r in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array(np.diff(rows)),
                        pa.array([len(b) for b in own], pa.int64()),
                        pa.array([min(i for i, _ in b) if b else None for b in own], pa.int64()),
                        pa.array([max(i for i, _ in b) if b else None for b in own], pa.int64()),
                        pa.array([sorted({x for _, x in b}) for b in own], pa.list_(pa.string())),
                    ],
                    names=["__id", "__hash", "n_words", "n_base", "first_word", "last_word", "__base"],
                )

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in W.blocks(batch.column(2)):
                h, _, _, rows = W.words(buf, off, W.FOLDED, W.ALNUM)
                w = W.window_hashes(h, k)
                lists = [w[a : max(a, b - k + 1)] for a, b in zip(rows, rows[1:], strict=False)]
                at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(lists).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), grams], names=["__id", "__hash", "grams"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__hash"), text.alias("__text"))
    rows = keyed.mapInArrow(read, f"__id {kind}, __hash long, n_words long, n_base long, first_word long, last_word long, __base array<string>")
    votes = keyed.mapInArrow(roll, f"__id {kind}, __hash long, grams array<long>").select("__id", "__hash", F.posexplode("grams").alias("i", "gram"))
    voted = votes.join(F.broadcast(positions), "gram").withColumn("d", F.col("i") - F.col("j"))
    by_diagonal = voted.groupBy("__id", "__hash", "t", "label", "size", "d").agg(F.collect_set("j").alias("js"))
    w = Window.partitionBy("__id", "__hash", "t").orderBy("d")
    merged = by_diagonal.withColumn("new", (F.coalesce(F.col("d") - F.lag("d").over(w), F.lit(drift + 1)) > drift).cast("int")).withColumn("span", F.sum("new").over(w))
    spans = merged.groupBy("__id", "__hash", "t", "label", "size", "span").agg(F.array_distinct(F.flatten(F.collect_list("js"))).alias("js")).withColumn("n", F.size("js"))
    part = F.col("n") / (F.array_max("js") - F.array_min("js") + 1)
    verified = spans.withColumn("share", F.greatest(F.col("n") / F.col("size"), F.when((F.col("n") >= long_part) & (part >= least), part)))
    found = verified.groupBy("__id", "__hash").agg(F.collect_set(F.when(F.col("share") >= least, F.col("label"))).alias("__more"), F.max("share").alias("__share"))
    found = found.withColumnsRenamed({"__id": "__fid", "__hash": "__fhash"})
    out = rows.join(found, F.col("__id").eqNullSafe(F.col("__fid")) & (F.col("__hash") == F.col("__fhash")), "left")
    labels = F.array_join(F.array_sort(F.array_union("__base", F.coalesce("__more", F.array().cast("array<string>")))), ",")
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("__share", F.lit(0.0)))
    return out.select(F.col("__id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("__base", ",").alias("base_labels"), labels.alias("labels"), score.alias("score"))


def op8_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
