"""License notices in documents: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Templates and documents are cut into windows of the same few lengths (LADDER: length, step in words
of document windows, least template length). Template windows start at every word, and windows are
shorter than the template by more than their step, so a stretch the document holds unaltered covers
a whole document window, which equals a template window and shares every band with it for certain.
Where no such stretch is left, windows of similarity s share one of BANDS bands with probability
1 - (1 - s) ** BANDS. A band is the least hash of a window's five-word shingles under one
permutation. Documents that share a band with any template stay; their bands are joined with the
templates' to say which, and a document is then held against each template it has met: the share of
the template's shingles found within one stretch of the document. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlane.llm.common import long_array, spool
from pitlane.llm.decontaminate import tokens

SHINGLE, BANDS, CONTAINED = 5, 3, 0.75
LADDER = ((5, 1, 0), (8, 2, 12), (12, 4, 20))
#: Notices as their licenses word them, and the short forms in use.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
}


def _hashes(words):
    """Hash of each five-word shingle of an array of words; none under five words."""
    n = F.size(words) - SHINGLE + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))).otherwise(F.array().cast("array<bigint>"))


def _permuted(j: int):
    """h under permutation j."""
    return F.transform("h", lambda x: F.xxhash64(x, F.lit(j)))


def _bands(j: int, width: int, step: int):
    """Least permuted hash of each window of `width` words, one every `step` (the last ones are shorter)."""
    n = width - SHINGLE + 1
    if n == 1:
        return F.col(f"p{j}")
    last = F.greatest(F.size("h") - 1, F.lit(0))
    return F.when(F.size("h") > 0, F.transform(F.sequence(F.lit(1), last + 1, F.lit(step)), lambda i: F.array_min(F.slice(f"p{j}", i, n)))).otherwise(F.array().cast("array<bigint>"))


def template_rows(spark, templates=TEMPLATES) -> DataFrame:
    rows = [(i, name, text) for i, (name, text) in enumerate((k, t) for k, ts in templates.items() for t in ts)]
    words = spark.createDataFrame(rows, "template int, license string, text string")
    return words.select("template", "license", tokens(F.col("text")).alias("w")).withColumn("h", _hashes(F.col("w"))).withColumn("need", F.size(F.array_distinct("h")))


def _with_permutations(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"p{j}": _permuted(j) for j in range(BANDS)})


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, text_hash, license, contained (share of the best template's shingles) and start (word) of each notice found.

    A document has one row for each license. Null and short texts have none; repeated rows give one
    result; rows with a null id take part. Other columns are ignored. The template table is fixed and
    small; templates under five words cannot be found.
    """
    spark = docs.sparkSession
    known = template_rows(spark, templates)
    stored = _with_permutations(known.where("need > 0"))
    by_band: dict[tuple[int, int], list[tuple[int, int]]] = {}
    reach = 0  # of the longest template's stretch
    for r in stored.select("template", F.size("w").alias("n"), *(F.col(f"p{j}") for j in range(BANDS))).collect():
        width = max(w for w, _, least in LADDER if r["n"] >= least)
        reach = max(reach, r["n"] + -(-r["n"] // 4) - 1)
        n = width - SHINGLE + 1
        for j in range(BANDS if n > 1 else 1):
            p = r[f"p{j}"]
            by_band.setdefault((width, j), []).extend((min(p[i : i + n]), r["template"]) for i in range(len(p) - n + 1))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), tokens(F.col("text")).alias("w"))
    rows = _with_permutations(rows.withColumn("h", _hashes(F.col("w"))).drop("w"))
    steps = {w: step for w, step, _ in LADDER}
    met = F.lit(False)
    for (width, j), values in sorted(by_band.items()):
        met = met | F.arrays_overlap(_bands(j, width, steps[width]), long_array(sorted({v for v, _ in values})))
    # a generator, unlike a filter, isn't pushed below the columns it reads, where each would be computed anew for every use
    found = spool(rows.select("doc_id", "text_hash", "h", F.explode(F.when(met, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))).alias("met")).drop("met"), "licensed")
    banded = _with_permutations(found)
    windows = lambda width, j: F.transform(_bands(j, width, steps[width]), lambda v: F.struct(F.lit(width).alias("width"), F.lit(j).alias("j"), v.alias("value")))
    own = banded.select("doc_id", "text_hash", F.explode(F.concat(*(windows(*key) for key in sorted(by_band)))).alias("b")).select("doc_id", "text_hash", "b.*") if by_band else banded.select("doc_id", "text_hash", F.lit(0).alias("width"), F.lit(0).alias("j"), F.lit(0).cast("long").alias("value")).limit(0)
    table = spark.createDataFrame([(w, j, v, t) for (w, j), values in by_band.items() for v, t in set(values)], "width int, j int, value long, template int")
    met_by = own.join(F.broadcast(table), ["width", "j", "value"]).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("template").alias("__template")).distinct()
    shingles = known.select("template", "license", "need", F.size("w").alias("n"), F.explode(F.array_distinct("h")).alias("shingle"))
    at = found.select("doc_id", "text_hash", F.posexplode("h").alias("pos", "shingle")).distinct().join(F.broadcast(shingles), "shingle")
    at = at.join(met_by, at.doc_id.eqNullSafe(F.col("__id")) & (at.text_hash == F.col("__hash")) & (at.template == F.col("__template")), "left_semi")
    near = Window.partitionBy("doc_id", "text_hash", "template").orderBy("pos").rangeBetween(0, reach)
    far = at.withColumn("inside", F.collect_list(F.struct("pos", "shingle")).over(near))
    inside = F.size(F.array_distinct(F.transform(F.filter("inside", lambda x: x["pos"] < F.col("pos") + F.col("n") + F.ceil(F.col("n") / 4)), lambda x: x["shingle"])))
    share = far.withColumn("contained", inside / F.col("need")).where(F.col("contained") >= CONTAINED)
    best = share.groupBy("doc_id", "text_hash", "license").agg(F.max(F.struct("contained", (-F.col("pos")).alias("start"))).alias("m"))
    return best.select("doc_id", "text_hash", "license", "m.contained", (-F.col("m.start")).alias("start"))


def op10_license_bands(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "license", F.round("contained", 6).alias("contained"), "start")


def _oracle() -> str:
    rows = [(i, k, t) for i, (k, t) in enumerate((k, t) for k, ts in TEMPLATES.items() for t in ts)]
    values = ", ".join(f"({i}, '{k}', '{t}')" for i, k, t in rows)
    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '')"
    return rf"""with t0(template, license, text) as (values {values}),
t1 as (select template, license, {words} w from t0),
t2 as (select distinct template, license, len(w) n, list_slice(w, i, i + 4) s from (select *, unnest(range(1, len(w) - 3)) i from t1)),
t3 as (select *, count(*) over (partition by template) need from t2),
d1 as (select distinct doc_id, {words} w from documents),
d2 as (select doc_id, i - 1 pos, list_slice(w, i, i + 4) s from (select *, unnest(range(1, len(w) - 3)) i from d1)),
j as (select doc_id, template, license, n, need, pos, s from d2 join t3 using (s)),
c as (select a.doc_id, a.license, a.pos, count(distinct b.s) / a.need contained from j a join j b on a.doc_id = b.doc_id and a.template = b.template and b.pos between a.pos and a.pos + a.n + ceil(a.n / 4) - 1
  group by a.doc_id, a.license, a.template, a.pos, a.need)
select doc_id, license, round(max(contained), 6) contained, cast(arg_min(pos, (-contained, pos)) as int) as start from c where contained >= 0.75 group by doc_id, license"""


OP10_SQL = _oracle()
