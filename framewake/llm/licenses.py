"""License scans: TF-IDF cosine of statements to templates, then inheritance from directories. DataFrame functions only.

A text is cut into segments at line ends and after sentence ends; segments that
hold a cue word are compared. Weights are tf * idf, with idf over all such
segments of the corpus for words of templates (a bounded vocabulary, so its
counts are gathered and broadcast) and that of a word never seen for all others.
Notices are wrapped, so runs of up to JOINED consecutive segments around a cue word
are compared as well, with the same weights, and so is the whole text of a file whose
name is that of a license file. A file's header license is that of an
SPDX-License-Identifier (the first id of its expression), else that of its best
segment or run with a cosine of at least `least`, ties to segments, then to the
template listed first. A file is a license file if its name
says so or if segments that match, or the best run, make up half of its words.

A file without a license gets that of the nearest ancestor directory, its own
included, with a license file: directories without license are taken once each,
joined to license directories over their ancestor paths, and the deepest wins.
Several license files of one directory: the smallest path counts.

Null, empty and cue-less texts have no header. Null paths have no directory and
inherit nothing. Repeated rows repeat their result, an empty table gives an empty
one. Other columns are not read. Long texts are cut like others; a segment's words
are rows, never an unbounded value.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, quoted, written

# Parts of license texts.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_NO_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_DISCLAIMED = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: License ids and how they are stated.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
    # Titles, which stand alone on a line.
    ("MIT", "The MIT License (MIT)"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    # Whole texts, which license files are held against.
    ("MIT", _GRANT + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-3-Clause", _CONDITIONS + _NO_NAMES + _DISCLAIMED),
    ("BSD-2-Clause", _CONDITIONS + _DISCLAIMED),
)
CUE = r"(?i)licen[cs]e|copyright|public domain|permission|redistribut|rights reserved|\bCC0\b|\bSPDX\b"
#: Consecutive lines at most that are compared as one.
JOINED = 8
#: Least cosine of a match.
LEAST = 0.75
_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)[^/]*$"
_SEGMENT_END = r"\n|(?<=[.;!?])[\x20\t]+"
_WORD = r"[a-z0-9]+"
#: An SPDX line names its license, without the suffix that says which later versions hold.
_SPDX = r"SPDX-License-Identifier:[\x20\t]*\(?([A-Za-z0-9][A-Za-z0-9.-]*?)(?:-only|-or-later|\+)?(?![A-Za-z0-9.+-])"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _joined(lines: str) -> Column:
    """Each run of 2 to JOINED consecutive lines around one that holds a cue word."""
    cue = CUE.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"""array_distinct(filter(flatten(flatten(transform(
        filter(transform({lines}, (s, p) -> IF(s RLIKE '{cue}', p, NULL)), p -> p IS NOT NULL),
        p -> transform(sequence(greatest(p - {JOINED - 1}, 0), p), i -> transform(sequence(greatest(i + 2, p + 1), i + {JOINED}),
            e -> IF(e <= size({lines}), concat_ws(' ', slice({lines}, i + 1, e - i)), NULL)))))), w -> w IS NOT NULL))""")


def headers(df: DataFrame, keep: list[str], text_col: str = "text", templates: tuple = TEMPLATES, least: float = LEAST, whole: Column | None = None) -> DataFrame:
    """The columns `keep`, license, score (null without a match) and share (of its words in matching segments). whole: rows whose whole text is compared besides."""
    text = F.col(text_col).cast("string")
    as_one = F.array() if whole is None else F.when(whole & text.rlike(CUE), F.array(text)).otherwise(F.array())
    own = F.when(text.rlike(CUE), F.filter(F.split(text, _SEGMENT_END, -1), lambda s: s.rlike(CUE)))
    n_words = F.when(text.rlike(CUE), F.regexp_count(F.lower(text), F.lit(_WORD))).otherwise(0)
    lines = F.when(text.rlike(CUE), F.filter(F.split(text, _SEGMENT_END, -1), lambda s: s.rlike(f"(?i){_WORD}")))
    stated = F.nullif(F.regexp_extract(text, _SPDX, 1), F.lit(""))
    marked = lambda c, one: F.transform(c, lambda s: F.struct(s.alias("s"), F.lit(one).alias("one")))
    rows = df.select(F.monotonically_increasing_id().alias("__n"), F.struct(*keep, stated.alias("__stated")).alias("__row"), n_words.alias("__words"), own.alias("__s"), lines.alias("__lines"), as_one.cast("array<string>").alias("__whole"))
    rows = rows.withColumn("__both", F.concat(marked(F.col("__s"), 1), marked(_joined("__lines"), 0), marked(F.col("__whole"), 0)))
    # Written, so that texts are cut once, and the row numbers stand.
    windows = written(rows.select("__n", "__row", "__words", F.posexplode_outer("__both").alias("__pos", "__b")).select("__n", "__row", "__words", "__pos", F.col("__b.s").alias("__segment"), F.col("__b.one").alias("__one")), "segments")
    segments = windows.where("__one = 1").select("__segment")
    vectors = [Counter(re.findall(_WORD, t.lower())) for _, t in templates]
    vocabulary = sorted(set().union(*vectors))
    spark = df.sparkSession
    # Document frequencies of the templates' words over all segments: as many rows as the vocabulary has words.
    counted = segments.where("__segment IS NOT NULL").select(F.explode(F.array_union(F.array_intersect(_words(F.col("__segment")), F.array(*map(F.lit, vocabulary))), F.array(F.lit("")))).alias("w"))
    df_of = {r["w"]: r["n"] for r in counted.groupBy("w").agg(F.count("*").alias("n")).collect()}
    n = df_of.pop("", 0) + len(templates)
    idf = {w: math.log((1 + n) / (1 + df_of.get(w, 0) + sum(w in v for v in vectors))) + 1 for w in vocabulary}
    unseen = math.log(1 + n) + 1
    norms = [math.sqrt(sum((c * idf[w]) ** 2 for w, c in v.items())) for v in vectors]
    table = [(w, idf[w], [v[w] * idf[w] / norm for v, norm in zip(vectors, norms, strict=True)]) for w in vocabulary]
    shape = T.StructType([T.StructField("__w", T.StringType()), T.StructField("__idf", T.DoubleType()), T.StructField("__t", T.ArrayType(T.DoubleType()))])
    words = (
        windows.select("__n", "__pos", "__row", "__words", "__one", F.explode_outer(_words(F.col("__segment"))).alias("__word"))
        .groupBy("__n", "__pos", "__word").agg(F.first("__row").alias("__row"), F.first("__words").alias("__words"), F.first("__one").alias("__one"), F.count("*").alias("__tf"))
        .join(F.broadcast(spark.createDataFrame(table, shape)), F.col("__word") == F.col("__w"), "left")
    )
    weight = F.col("__tf") * F.coalesce("__idf", F.lit(unseen))
    scored = words.groupBy("__n", "__pos").agg(
        F.first("__row").alias("__row"), F.first("__words").alias("__words"), F.first("__one").alias("__one"),
        F.sum(F.when(F.col("__word").isNotNull(), F.col("__tf"))).alias("__own"),
        F.sqrt(F.sum(F.when(F.col("__word").isNotNull(), weight * weight))).alias("__norm"),
        *(F.sum(weight * F.col("__t")[k]).alias(f"__d{k}") for k in range(len(templates))),
    )
    cosines = F.array(*(F.coalesce(F.round(F.col(f"__d{k}") / F.col("__norm"), 9), F.lit(0.0)) for k in range(len(templates))))
    best = scored.withColumn("__cos", cosines).withColumn("__score", F.array_max("__cos")).withColumn("__k", F.array_position("__cos", F.col("__score")) - 1)
    hit = F.col("__score") >= least
    match = F.struct(F.col("__score").alias("score"), "__one", (-F.col("__k")).alias("k"), F.col("__own").alias("own"))
    top = best.groupBy("__n").agg(
        F.first("__row").alias("__row"), F.greatest(F.max("__words"), F.lit(1)).alias("__words"),
        F.max(F.when(hit, match)).alias("__best"),
        F.sum(F.when(hit & (F.col("__one") == 1), F.col("__own")).otherwise(0)).alias("__alone"),
    )
    names = F.array(*(F.lit(name) for name, _ in templates))
    # Windows overlap, so of these only the best counts for the share.
    share = F.greatest("__alone", F.when(F.col("__best.__one") == 0, F.col("__best.own")).otherwise(0)) / F.col("__words")
    found, stated = F.get(names, (-F.col("__best.k")).cast("int")), F.col("__row.__stated")
    return top.select(
        *(F.col("__row")[c].alias(c) for c in keep), F.coalesce(stated, found).alias("license"),
        F.when(stated.isNotNull(), F.lit(1.0)).otherwise(F.col("__best.score")).alias("score"), share.alias("share"),
    )


def _parent(path: Column) -> Column:
    """The directory of a path, with its last slash; the root is the empty string."""
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def scan_licenses(df: DataFrame, id_col: str, path_col: str, text_col: str = "text", templates: tuple = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(id, path, license, how: file | header | inherited | none, score, from_dir), a row for each row of df."""
    rows = df.select(quoted(id_col).alias("__id"), quoted(path_col).cast("string").alias("__path"), quoted(text_col).alias("__text"))
    named = F.coalesce(F.col("__path").rlike(_NAME), F.lit(False))
    found = written(headers(rows, ["__id", "__path"], "__text", templates, least, named), "licenses")
    is_file = F.col("license").isNotNull() & (named | (F.col("share") >= 0.5))
    files = found.withColumn("__dir", _parent(F.col("__path"))).withColumn("how", F.when(is_file, "file").when(F.col("license").isNotNull(), "header"))
    at = files.where("how = 'file' AND __dir IS NOT NULL").groupBy("__dir").agg(F.min(F.struct("__path", "license")).alias("f")).select(F.col("__dir").alias("from_dir"), F.col("f.license").alias("__inherited"))
    bare = files.where("license IS NULL AND __dir IS NOT NULL").select("__dir").distinct()
    # Every ancestor of a directory, itself first: its path up to each slash, and the root.
    steps = F.split(F.col("__dir"), "/", -1)
    above = bare.select("__dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/"))))).alias("__above"))
    nearest = written(
        above.join(at, F.col("__above") == F.col("from_dir")).groupBy("__dir").agg(F.max_by(F.struct("from_dir", "__inherited"), F.length("from_dir")).alias("i")).select(F.col("__dir").alias("__d"), "i.*"),
        "directories",
    )
    out = files.join(nearest, F.col("license").isNull() & (F.col("__dir") == F.col("__d")), "left")
    return out.select(
        F.col("__id").alias(id_col), F.col("__path").alias(path_col), F.coalesce("license", "__inherited").alias("license"),
        F.coalesce("how", F.when(F.col("__inherited").isNotNull(), "inherited"), F.lit("none")).alias("how"), F.round("score", 6).alias("score"), "from_dir",
    )


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    """The documents as files of a tree that is made up, as they have no paths: a directory for each source and, in it, for each hundred ids. What is inherited here shows the operator, not a fact about these documents."""
    docs = load(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.expr("CAST(doc_id DIV 100 AS STRING)"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan_licenses(docs.withColumn("path", path), "doc_id", "path")


def _op7_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    vectors = [Counter(re.findall(_WORD, t.lower())) for _, t in TEMPLATES]
    terms = ", ".join(f"({k}, {q(w)}, {n})" for k, v in enumerate(vectors) for w, n in sorted(v.items()))
    names = ", ".join(f"({k}, {q(name)})" for k, (name, _) in enumerate(TEMPLATES))
    return f"""
WITH terms AS (SELECT * FROM (VALUES {terms}) t(k, w, tf)), names AS (SELECT * FROM (VALUES {names}) t(k, license)),
d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r, concat_ws('/', coalesce(source, 'unknown'), CAST(doc_id // 100 AS VARCHAR), concat(doc_id, '.txt')) AS path FROM documents),
segments AS (SELECT r, i, s FROM (SELECT r, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT r, string_split(regexp_replace(t, '([.;!?])[\\x20\\t]+', '\\1' || chr(10), 'g'), chr(10)) AS ss FROM d)) WHERE regexp_matches(s, {q(CUE)})),
words AS (SELECT r, i, w, count(*) AS tf FROM (SELECT r, i, unnest(regexp_extract_all(lower(s), '{_WORD}')) AS w FROM segments) GROUP BY ALL),
n AS (SELECT count(*) + {len(TEMPLATES)} AS n FROM segments),
idf AS (SELECT w, ln((1 + n) / (1.0 + own + coalesce(df, 0))) + 1 AS idf FROM (SELECT w, count(*) AS own FROM terms GROUP BY w) LEFT JOIN (SELECT w, count(*) AS df FROM words GROUP BY w) USING (w), n),
weighed AS (SELECT r, i, w, words.tf, words.tf * coalesce(idf, ln(1 + n) + 1) AS x FROM words LEFT JOIN idf USING (w), n),
templates AS (SELECT k, w, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY k)) AS y FROM terms JOIN idf USING (w)),
norms AS (SELECT r, i, sqrt(sum(x * x)) AS norm, sum(tf) AS own FROM weighed GROUP BY ALL),
cosines AS (SELECT r, i, k, own, round(sum(x * y) / any_value(norm), 9) AS c FROM weighed JOIN templates USING (w) JOIN norms USING (r, i) GROUP BY ALL),
best AS (SELECT * FROM cosines WHERE c >= {LEAST} QUALIFY row_number() OVER (PARTITION BY r, i ORDER BY c DESC, k) = 1),
headers AS (SELECT r, license, c, own FROM (SELECT r, k, c, sum(own) OVER (PARTITION BY r) AS own, row_number() OVER (PARTITION BY r ORDER BY c DESC, k) AS rank FROM best) JOIN names USING (k) WHERE rank = 1),
files AS (SELECT doc_id, path, regexp_extract(path, '^(.*/)?[^/]*$', 1) AS dir, license, c, license IS NOT NULL AND own >= 0.5 * len(regexp_extract_all(lower(t), '{_WORD}')) AS is_file FROM d LEFT JOIN headers USING (r)),
dirs AS (SELECT dir AS from_dir, arg_min(license, path) AS inherited FROM files WHERE is_file GROUP BY dir),
above AS (SELECT dir, arg_max(from_dir, length(from_dir)) AS from_dir FROM (SELECT DISTINCT dir FROM files WHERE license IS NULL) JOIN dirs ON starts_with(dir, from_dir) GROUP BY dir)
SELECT doc_id, path, coalesce(license, inherited) AS license, CASE WHEN is_file THEN 'file' WHEN license IS NOT NULL THEN 'header' WHEN inherited IS NOT NULL THEN 'inherited' ELSE 'none' END AS how, round(c, 6) AS score,
  CASE WHEN license IS NULL THEN from_dir END AS from_dir
FROM files LEFT JOIN above USING (dir) LEFT JOIN dirs USING (from_dir)
"""


OP7_SQL = _op7_sql()
