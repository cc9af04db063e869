"""Licence scan: TF-IDF cosine of text lines to licence templates, then inheritance from the nearest ancestor directory.

The lines of every document (and the whole text of a licence file) are compared with the templates as sparse TF-IDF
vectors; document frequencies are counted over all documents. A line that shares only light terms with a template cannot
reach the threshold, so only lines with one of the templates' heavier terms (their prefix under that bound) are weighed;
the bound loses no line. A file without a licence of its own takes that of the nearest directory above it that has a
licence file, by a join on its ancestor paths.

Defined results: null or empty texts have no licence of their own; a null path inherits nothing; equal scores go to the
licence first in name order; several licence files of a directory: the best score, then the smallest ``doc_id``; repeated
rows are separate rows with equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

# Notices of well-known licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
)
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
THRESHOLD = 0.75
LICENCE_FILE = "LICENSE"


def terms(text):
    """Terms of a text column, in order, with repeats."""
    return F.regexp_extract_all(common.ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def document_frequency(docs: DataFrame, wanted: list[str]) -> dict[str, int]:
    """Number of documents that hold each wanted term."""
    found = docs.select(F.explode(F.array_intersect(terms(F.col("text")), F.array(*[F.lit(w) for w in wanted]))).alias("term"))
    return {r.term: r["count"] for r in found.groupBy("term").count().collect()}


def own_licences(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """``doc_id, path, text_hash, licence, score`` for every document with a line (or, in a licence file, a text) near a template."""
    spark = docs.sparkSession
    rows = docs.count()
    counts = [(name, Counter(re.findall(TERM, text.lower()))) for name, text in templates]
    vocabulary = sorted({t for _, c in counts for t in c})
    df = document_frequency(docs, vocabulary)
    weigh = lambda n: math.log((1 + rows) / (1 + n)) + 1
    prefix, entries = set(), []
    for i, (name, c) in enumerate(counts):
        w = {t: n * weigh(df.get(t, 0)) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        entries += [(i, name, t, x / norm) for t, x in w.items()]
        light, mass = set(), 0.0
        for t in sorted(w, key=lambda t: (w[t], t)):  # terms that alone cannot reach the threshold
            mass += (w[t] / norm) ** 2
            if math.sqrt(mass) >= threshold - 1e-9:
                break
            light.add(t)
        prefix |= set(w) - light

    text = F.coalesce("text", F.lit(""))
    units = F.when(F.col("path").rlike(f"(^|/){LICENCE_FILE}$"), F.concat(F.split(text, "\n", -1), F.array(text))).otherwise(F.split(text, "\n", -1))
    lines = docs.select("doc_id", "path", F.xxhash64("text").alias("text_hash"), F.posexplode(units).alias("pos", "line")).withColumn("t", terms(F.col("line"))).drop("line")
    lines = common.materialize(lines.filter(F.arrays_overlap("t", F.array(*[F.lit(p) for p in sorted(prefix)]))), "licence-lines")
    tf = lines.select("doc_id", "path", "text_hash", "pos", F.explode("t").alias("term")).groupBy("doc_id", "path", "text_hash", "pos", "term").agg(F.count(F.lit(1)).alias("tf"))
    # the other terms of these lines need their document frequencies too, for the lengths of the vectors
    known = spark.createDataFrame([(t, df.get(t, 0)) for t in vocabulary], "term string, df long")
    new = lines.select(F.explode("t").alias("term")).distinct().join(F.broadcast(known), "term", "left_anti")
    extra = docs.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(new, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df")) if new.limit(1).count() else None
    weights = known if extra is None else known.unionByName(extra)
    v = tf.join(weights, "term").withColumn("w", F.col("tf") * (F.log((1 + F.lit(rows)) / (1 + F.col("df"))) + 1))
    v = v.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id", "path", "text_hash", "pos"))))
    t = spark.createDataFrame(entries, "template int, licence string, term string, tw double")
    dots = v.join(F.broadcast(t), "term").groupBy("doc_id", "path", "text_hash", "pos", "template", "licence").agg((F.sum(F.col("w") * F.col("tw")) / F.max("norm")).alias("score"))
    best = F.min(F.struct((-F.round("score", 9)).alias("s"), "licence")).alias("b")
    out = dots.filter(F.col("score") >= threshold).groupBy("doc_id", "path", "text_hash").agg(best)
    return out.select("doc_id", "path", "text_hash", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` has doc_id, path, text. One row per document: ``doc_id, path, licence, how`` (own, inherited or none),
    ``score`` of an own licence and ``origin``, the directory an inherited one comes from."""
    own = common.materialize(own_licences(docs, threshold), "licences")
    parent = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    files = own.filter(F.col("path").rlike(f"/{LICENCE_FILE}$")).withColumn("dir", parent(F.col("path")))
    dirs = files.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "doc_id", "licence")).alias("d")).select("dir", F.col("d.licence").alias("dir_licence"))
    rows = docs.select("doc_id", "path", F.xxhash64("text").alias("text_hash"))
    o = own.select(*[F.col(c).alias(f"o_{c}") for c in own.columns])
    j = rows.join(o, F.col("doc_id").eqNullSafe(F.col("o_doc_id")) & F.col("path").eqNullSafe(F.col("o_path")) & (F.col("text_hash") == F.col("o_text_hash")), "left").select("doc_id", "path", F.col("o_licence").alias("licence"), F.col("o_score").alias("score"))
    # inheritance is a matter of directories: one row for each directory in use and each of its ancestors
    below = rows.select(parent(F.col("path")).alias("at")).filter(F.col("at") != "").distinct()
    parts = F.split("at", "/")
    below = below.select("at", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir")))).alias("a")).select("at", "a.*")
    nearest = below.join(dirs, "dir").groupBy("at").agg(F.max_by(F.struct("dir", "dir_licence"), "depth").alias("n")).select("at", "n.*")
    j = j.withColumn("at", parent(F.col("path"))).join(nearest, "at", "left")
    how = F.when(F.col("licence").isNotNull(), "own").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none")
    return j.select("doc_id", "path", F.coalesce("licence", "dir_licence").alias("licence"), how.alias("how"), "score", F.when(how == "inherited", F.col("dir")).alias("origin"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the licence of every document, filed by source and number; some are the licence files of their directories."""
    part = F.pmod(F.floor(F.col("doc_id") / 20), F.lit(20))
    top = F.concat(F.col("source"), F.lit("/d"), F.floor(F.col("doc_id") / 400).cast("string"))
    low = F.concat(top, F.lit("/e"), F.floor(F.col("doc_id") / 100).cast("string"))
    path = F.when(part == 0, F.concat(top, F.lit("/LICENSE"))).when(part == 10, F.concat(low, F.lit("/LICENSE"))).otherwise(F.concat(low, F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".txt")))
    out = scan(common.read(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))
    return out.withColumn("score", F.round("score", 6))


_VALUES = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))
ORACLE_SQL = rf"""
with d as (
  select doc_id, text, (doc_id // 20) % 20 as part, source || '/d' || (doc_id // 400) as top, source || '/d' || (doc_id // 400) || '/e' || (doc_id // 100) as low from documents
), p as (
  select doc_id, coalesce(text, '') as text, case part when 0 then top || '/LICENSE' when 10 then low || '/LICENSE' else low || '/f' || doc_id || '.txt' end as path from d
), n as (select count(*) as n from p),
df as (select term, count(*) as df from (select doc_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}'))) as term from p) group by term),
l as (
  select doc_id, path, pos, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line from (
    select doc_id, path, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from p
    union all select doc_id, path, text, 1000000 from p where path like '%/LICENSE')
), lt as (select doc_id, path, pos, term, count(*) as tf from (select doc_id, path, pos, unnest(regexp_extract_all(line, '{TERM}')) as term from l) group by all),
lw as (select lt.*, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) as w from lt join df using (term), n),
ln_ as (select doc_id, pos, sqrt(sum(w * w)) as norm from lw group by doc_id, pos),
t as (select * from (values {_VALUES}) t(template, licence, text)),
tt as (select template, licence, term, count(*) as tf from (select template, licence, unnest(regexp_extract_all(lower(text), '{TERM}')) as term from t) group by all),
tw as (select tt.*, tf * (ln((1 + n)::DOUBLE / (1 + coalesce(df, 0))) + 1) as w from tt left join df using (term), n),
tn as (select template, sqrt(sum(w * w)) as norm from tw group by template),
s as (select lw.doc_id, lw.path, lw.pos, tw.template, tw.licence, sum(lw.w * tw.w / tn.norm) / any_value(ln_.norm) as score from lw join tw using (term) join tn on tn.template = tw.template join ln_ on ln_.doc_id = lw.doc_id and ln_.pos = lw.pos group by all),
own as (select doc_id, path, licence, score from (select doc_id, path, licence, round(score, 9) as score, row_number() over (partition by doc_id order by round(score, 9) desc, licence) as k from s where score >= {THRESHOLD}) where k = 1),
dirs as (select dir, licence from (select regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, licence, row_number() over (partition by regexp_extract(path, '^(.*)/[^/]*$', 1) order by score desc, doc_id) as k from own where path like '%/LICENSE') where k = 1),
a as (select doc_id, regexp_extract(path, '^(.*)/[^/]*$', 1) as at from p),
nearest as (select doc_id, dir, licence from (select a.doc_id, dirs.dir, dirs.licence, row_number() over (partition by a.doc_id order by length(dirs.dir) desc) as k from a join dirs on a.at = dirs.dir or starts_with(a.at, dirs.dir || '/')) where k = 1)
select p.doc_id, p.path, coalesce(own.licence, nearest.licence) as licence, case when own.licence is not null then 'own' when nearest.licence is not null then 'inherited' else 'none' end as how,
       round(own.score, 6) as score, case when own.licence is null then nearest.dir end as origin
from p left join own on own.doc_id = p.doc_id left join nearest on nearest.doc_id = p.doc_id
"""
