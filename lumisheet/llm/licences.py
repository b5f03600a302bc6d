"""Licence scan with a positional index of rare tokens, in DataFrame operations only.

Templates are licence notices and the clauses of whole licence texts. A text that holds none of their words, by one
pattern, has its words counted and no more. In the others the words of the templates are found with their positions.
Document frequencies of these words are counted over all documents; each template is indexed by its
rarest words with their positions. A document's words of the index are looked up in these
postings, hits are grouped by template and relative position (document position minus template position), and an
alignment that covers enough of the template's weight names a candidate. It counts only if the template's mandatory
key phrase stands in or near the aligned place. Base phrases are found everywhere by exact rules and always stay.

Scale: documents are read once and never shuffled; only words of the templates (a fixed table of some hundred) leave
the scan. Alignments are made for documents that hold a key phrase, keyed by row; no key gathers more than a document's own words.

Defined results: a null or empty text has no words, no label and score 0; words are counted from 0;
repeated rows are documents of their own; ties between words go by position, then alphabetically; very long texts are
read whole, as one array of words where they hold a template's word; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

#: A word before lower-casing: letters and digits of ASCII, and all characters beyond it.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words by which a key phrase may miss the aligned place.
NEAR = 40
#: Words of a stretch in which alignments meet key phrases.
SPAN = 256

#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label, text, mandatory key phrase (both as normalised words).
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "distributed on an as is basis"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "purpose and noninfringement"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "dealings in the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "without any express or implied warranty"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "redistribute it freely"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "must be plainly marked as such"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", "permission notice appear in all copies"),
    ("cc-by", "licensed under cc by 4 0", "cc by"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "has waived all copyright"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "modify publish use compile sell or distribute"),
    ("reserved", "copyright all rights reserved", "all rights reserved"),
)

#: Words too common to tell a licence; never looked up.
STOP = frozenset(
    "a all an and any are as at be being both but by can code de des do event for form free from has have held hereby if in into is it its law let made may met must name names no non nor not of on one or original other otherwise out part shall should so such than that the their them there these they this those to under up upon use used version was were what when whether which who will with without work you your 0 2 3 4".split()
)


#: Words of the templates that are looked for, with those of the base phrases.
VOCABULARY = tuple(sorted({w for _, text, key in TEMPLATES for w in f"{text} {key}".split() if w not in STOP} | {w for p, _ in BASE for w in p.split() if w not in STOP}))


def _alternatives(words: list[str]) -> str:
    """A pattern for any of these words, sharing their beginnings."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    if list(heads) == [""]:
        return ""
    ends = heads.pop("", None) is not None
    branches = [h + _alternatives(tails) for h, tails in sorted(heads.items())]
    whole = branches[0] if len(branches) == 1 and not ends else f"(?:{'|'.join(branches)})"
    return whole + "?" if ends else whole


#: Any word of the vocabulary as a whole word, upper or lower case (ASCII).
_ANY = rf"(?i)(?<!{_WORD[:-1]}){_alternatives(list(VOCABULARY))}(?!{_WORD[:-1]})"


def _anchor(phrase: str) -> tuple[str, int]:
    """The longest word of a phrase that is looked for, and its place there."""
    words = phrase.split()
    word = max((w for w in words if w not in STOP), key=len)
    return word, words.index(word)


def _starts(phrase: str) -> Column:
    """Positions at which a phrase stands, from the columns ``hits`` and ``words``."""
    word, at = _anchor(phrase)

    def stands(hit: Column) -> Column:
        # word by word: each look-up takes one step, however long the text is
        rest = [F.translate(F.get("words", hit["pos"] - at + k), _UPPER, _LOWER) == w for k, w in enumerate(phrase.split()) if k != at]
        return reduce(Column.__and__, [hit["word"] == word, *[F.coalesce(r, F.lit(False)) for r in rest]])

    return F.transform(F.filter("hits", stands), lambda hit: hit["pos"] - at)


def _read(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text) with ``row``, ``n_words``, ``hits`` (pos, word), the places of base phrases and key phrases."""
    some = F.regexp_like("text", F.lit(_ANY))
    words = F.when(some, F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)))
    low = lambda w: F.when(F.octet_length(w) == F.octet_length(F.lower(w)), F.lower(w))  # noqa: E731  a letter beyond ASCII that falls into it changes its size
    hit = lambda w, i: F.struct(i.alias("pos"), low(w).alias("word"))
    out = docs.select("id", "text", words.alias("words"))
    out = out.withColumn("hits", F.filter(F.transform("words", hit), lambda x: x["word"].isin(*VOCABULARY)))
    base = [F.when(F.col("hits").isNotNull(), _starts(p)) for p, _ in BASE]
    named = lambda key: F.transform(_starts(key), lambda x: F.struct(F.lit(key).alias("key"), x.alias("start")))
    keys = [named(key) for key in dict.fromkeys(key for *_, key in TEMPLATES)]
    return out.select(
        "id",
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.when(F.col("words").isNotNull(), F.size("words")).otherwise(F.regexp_count("text", F.lit(_WORD))), F.lit(0)).cast("long").alias("n_words"),
        "hits",
        *[b.alias(f"base{k}") for k, b in enumerate(base)],
        F.when(F.col("hits").isNotNull(), F.flatten(F.array(*keys))).alias("keys"),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rare: int = 6, coverage: float = 0.6) -> DataFrame:
    """One row per document: id, ``n_words``, base places, ``base`` and ``labels`` (arrays), ``score``.

    ``rare``: words of highest IDF by which a template is indexed, all of which are looked up in
    every document; ``coverage``: least share of the index weight of a template in one alignment.
    """
    spark = docs.sparkSession
    report = durable(_read(docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))))
    places = [(t, label, key, len(text.split()), pos, w) for t, (label, text, key) in enumerate(TEMPLATES) for pos, w in enumerate(text.split()) if w not in STOP]
    postings = spark.createDataFrame(places, "template int, label string, key string, size int, tpos int, word string")
    vocabulary = postings.select("word").distinct()

    n = report.count()
    seen = report.select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["word"]))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    idf = vocabulary.join(F.broadcast(seen), "word", "left").select("word", F.log(F.lit(n + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)).alias("idf"))  # a row for each word of the vocabulary
    # the index: each template by its rarest words, all their places
    by_rarity = Window.partitionBy("template").orderBy(F.desc("idf"), "word")
    index = postings.join(F.broadcast(idf), "word").withColumn("k", F.dense_rank().over(by_rarity)).where(F.col("k") <= rare)
    own = Window.partitionBy("template")
    even = F.lit(1.0) / F.count("*").over(own)  # where all documents hold all indexed words, none is rarer
    index = index.withColumn("weight", F.coalesce(F.try_divide("idf", F.sum("idf").over(own)), even)).select("template", "label", "key", "size", "tpos", "word", "weight")

    keyed = report.where(F.size("keys") > 0)
    hits = keyed.select("row", F.explode("hits").alias("hit")).select("row", "hit.pos", "hit.word")
    aligned = hits.join(F.broadcast(index), "word").groupBy("row", "template", "label", "key", "size", (F.col("pos") - F.col("tpos")).alias("offset")).agg(F.sum("weight").alias("share")).where(F.col("share") >= coverage)
    # key phrases near an alignment: an interval join by stretches of SPAN words, so that a text of many licences takes steps in proportion
    low, high = F.col("offset") - NEAR, F.col("offset") + F.col("size") + NEAR
    spans = aligned.select("*", F.explode(F.sequence(F.floor(low / SPAN), F.floor(high / SPAN))).alias("span"))
    starts = keyed.select("row", F.explode("keys").alias("at")).select("row", "at.key", F.floor(F.col("at.start") / SPAN).alias("span"), "at.start")
    near = (spans["row"] == starts["row"]) & (spans["key"] == starts["key"]) & (spans["span"] == starts["span"]) & starts["start"].between(low, high)
    found = spans.join(starts, near, "left_semi").groupBy("row").agg(F.max("share").alias("share"), F.collect_set("label").alias("own"))

    both = report.join(found, "row", "left")
    every = F.flatten(F.array(*[F.coalesce(f"base{k}", F.array().cast("array<int>")) for k in range(len(BASE))]))
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"base{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)])))
    return both.select(
        F.col("id").alias(id_col), "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), base.alias("base"),
        F.array_sort(F.array_union(base, F.coalesce("own", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size(every) > 0, 1.0).otherwise(F.least(F.lit(1.0), F.round(F.coalesce("share", F.lit(0.0)), 6))).alias("score"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The report of the query: one row per document."""
    found = scan(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score")


def oracle(rare: int = 6, coverage: float = 0.6) -> str:
    """The same rules as DuckDB SQL."""
    places = ", ".join(f"({t}, '{label}', '{key}', {len(text.split())}, {pos}, '{w}')" for t, (label, text, key) in enumerate(TEMPLATES) for pos, w in enumerate(text.split()) if w not in STOP)
    keys = ", ".join(f"('{key}', {key.split()!r})" for key in dict.fromkeys(key for *_, key in TEMPLATES))
    base = ", ".join(f"({p.split()!r}, '{label}')" for p, label in BASE)
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
tok AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos, w FROM d),
base(p, label) AS (VALUES {base}),
keys(key, p) AS (VALUES {keys}),
b AS (SELECT doc_id, pos, label FROM tok JOIN base ON word = p[1] AND w[pos + 1 : pos + len(p)] = p),
bd AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM b GROUP BY doc_id),
v AS (SELECT doc_id, key, pos AS start FROM tok JOIN keys ON word = p[1] AND w[pos + 1 : pos + len(p)] = p),
postings(template, label, key, size, tpos, word) AS (VALUES {places}),
vocabulary AS (SELECT DISTINCT word FROM postings),
hits AS (SELECT doc_id, pos, word FROM tok JOIN vocabulary USING (word)),
idf AS (SELECT word, ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (coalesce(df, 0) + 1.0::DOUBLE)) AS idf FROM vocabulary LEFT JOIN (SELECT word, count(DISTINCT doc_id) AS df FROM hits GROUP BY word) USING (word)),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY template ORDER BY idf DESC, word) AS k FROM postings JOIN idf USING (word)),
ind AS (SELECT template, label, key, size, tpos, word, coalesce(idf / nullif(sum(idf) OVER (PARTITION BY template), 0), 1.0::DOUBLE / count(*) OVER (PARTITION BY template)) AS weight FROM ranked WHERE k <= {rare}),
aligned AS (SELECT doc_id, template, label, key, size, pos - tpos AS offs, sum(weight) AS share FROM hits JOIN ind USING (word) GROUP BY ALL),
own AS (SELECT doc_id, label, max(share) AS share FROM aligned JOIN v USING (doc_id, key) WHERE share >= {coverage} AND start BETWEEN offs - {NEAR} AND offs + size + {NEAR} GROUP BY doc_id, label),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION ALL SELECT doc_id, label FROM own) GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
sc AS (SELECT doc_id, max(share) AS share FROM own GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, round(coalesce(share, 0.0::DOUBLE), 6)) END AS score
FROM d LEFT JOIN bd USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN sc USING (doc_id)
"""
