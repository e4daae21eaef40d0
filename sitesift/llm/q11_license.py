"""Query op11: license wording in all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read
from .license_scan import Template, license_spans
from .registry import register

# The phrases of the base labels.
PHRASES = (
    Template("mit", "under the mit license"),
    Template("apache-2", "apache license version 2"),
    Template("cc-by-nc", "cc by nc"),
)
#: Names of further licenses, word for word, and notices, a fifth of whose words may be edited.
FURTHER = (
    Template("gpl-3", "GNU General Public License, version 3"),
    Template("gpl-2", "GNU General Public License, version 2"),
    Template("agpl-3", "GNU Affero General Public License, version 3"),
    Template("lgpl", "GNU Lesser General Public License"),
    Template("mpl-2", "Mozilla Public License, v. 2.0"),
    Template("mpl-2", "Mozilla Public License, version 2.0"),
    Template("bsd-3-clause", "BSD 3-Clause License"),
    Template("bsd-2-clause", "BSD 2-Clause License"),
    Template("cc-by-sa", "CC BY-SA 4.0"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
             "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", 0.2),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
             "compliance with the License. You may obtain a copy of the License at", 0.2),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
             "the following conditions are met", 0.2),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
             "Public License as published by the Free Software Foundation", 0.2),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
             "granted, provided that the above copyright notice and this permission notice appear in all copies", 0.2),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
             "not distributed with this file, You can obtain one at", 0.2),
    Template("unlicense", "This is free and unencumbered software released into the public domain", 0.2),
)
TEMPLATES = PHRASES + FURTHER

_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_ROWS = ",\n    ".join("({}, '{}', {}, '{}')".format(i, t.label, t.share, t.text.replace("'", "''")) for i, t in enumerate(TEMPLATES))

SQL = rf"""
WITH RECURSIVE
k AS (
  SELECT *, greatest(0, least(floor(share * len(w)), (len(w) - 3) // 3))::BIGINT AS most FROM (
    SELECT id, label, share, {_WORDS.format("wording")} AS w FROM (VALUES
    {_ROWS}) t(id, label, share, wording))),
o AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
p AS (SELECT r, i AS j, w[i + 1] AS word, w[i + 1:i + 3] AS gram, w[i + 1:i + 8] AS ahead FROM (SELECT *, unnest(range(len(w))) AS i FROM o)),
e AS (  -- word for word
  SELECT p.r, k.id, k.label, p.j FROM p JOIN k ON k.most = 0 AND p.gram = k.w[1:3] AND p.ahead[1:len(k.w)] = k.w),
c AS (  -- texts and templates that share three words in a row
  SELECT DISTINCT p.r, g.id FROM p JOIN (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM k WHERE most > 0) g ON p.gram = g.w[g.i:g.i + 2]),
d AS (  -- edit distance to the stretches ending before word j
  SELECT c.r, c.id, 0 AS i, j, 0::BIGINT AS cost FROM c JOIN (SELECT r, unnest(range(len(w) + 1)) AS j FROM o) q ON q.r = c.r
  UNION ALL
  SELECT r, id, i + 1, j, min(step - j) OVER (PARTITION BY r, id ORDER BY j) + j FROM (
    SELECT d.r, d.id, d.i, d.j, least(d.cost + 1, coalesce(lag(d.cost) OVER (PARTITION BY d.r, d.id ORDER BY d.j)
           + (p.word IS DISTINCT FROM k.w[d.i + 1])::BIGINT, 1000000)) AS step
    FROM d JOIN k ON k.id = d.id LEFT JOIN p ON p.r = d.r AND p.j = d.j - 1 WHERE d.i < len(k.w))),
n AS (
  SELECT d.r, k.label, 1 - min(cost) / len(k.w) AS score FROM d JOIN k ON k.id = d.id
  WHERE d.i = len(k.w) AND cost <= k.most GROUP BY d.r, d.id, k.label, k.w),
b AS (
  SELECT r, count(*) AS n_base, min(j) AS first_word, max(j) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM e WHERE id < 3 GROUP BY r),
a AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM (SELECT r, label, 1.0::DOUBLE AS score FROM e UNION ALL SELECT r, label, score FROM n) GROUP BY r)
SELECT o.doc_id, len(o.w)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word,
       b.last_word::BIGINT AS last_word, coalesce(b.base_labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
       coalesce(a.score, 0)::DOUBLE AS score
FROM o LEFT JOIN b ON b.r = o.r LEFT JOIN a ON a.r = o.r
"""


def labels_of(spans):
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")


@register("op11_license_scan", SQL)
def op11_license_scan(spark, sf_dir):
    """Every document's base phrases, all its license labels, and its best score."""
    found = license_spans(read(spark, sf_dir, "documents"), TEMPLATES)
    base = F.filter("spans", lambda s: s["template"] < len(PHRASES))
    starts = F.transform("base", lambda s: s["start"])
    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels_of("base").alias("base_labels"), labels_of("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
