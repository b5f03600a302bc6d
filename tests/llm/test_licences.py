import re
import time

import pytest

from lumisheet.llm import licences
from lumisheet.llm.common import table


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for p, label in licences.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


TEXTS = [
    "CC BY cc-by; Cc\nby cc by cc by",
    "All rights reserved. The GNU General Public License (general public license) all rights  reserved",
    "ccby cc bye xcc by écc by cc byé cc é by",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "some text before\nLicensed under the Apache License, Version 2.0.\nand after",
    "released under the Apache Software terms: licence of the version of license",
    "This work is licensed under the GNU General Public License, version 3.",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "word " * 20000 + "all rights reserved",
    "",
    None,
]


def test_phrases_and_labels(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in licences.digest(docs).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t and t[:60]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert [got[i].labels for i in (3, 4, 5, 6, 7, 9, 10)] == ["mit", "apache", "", "gpl", "bsd", "", ""]


def test_a_document_with_every_notice(spark):
    """However many licence words a document holds, none of its labels is lost."""
    text = "\n".join(t for _, t, _ in licences.TEMPLATES)
    docs = spark.createDataFrame([(0, text), *((i, f"plain words {i}") for i in range(1, 40))], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licences.digest(docs).collect()}
    assert got.pop(0).split(",") == sorted({x for x, _, _ in licences.TEMPLATES}) and not any(got.values())


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in licences.digest(docs).collect():
        t = texts[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
        assert ("mit" in r.labels.split(",")) == ("Released under the MIT License." in t)
        assert ("apache" in r.labels.split(",")) == ("Licensed under the Apache License, Version 2.0." in t)


def test_key_phrases_stand_near_the_aligned_place(spark):
    """A key phrase far away from the notice does not verify it, and letters beyond ASCII fold into none of its words."""
    notice = "you may not use this file except in compliance with the license you may obtain a copy of the license at"
    rows = [f"Apache {notice}", f"{notice} apache", "apache " + "far away " * 100 + notice, f"{notice}", "this wor\u212a is licensed under the gnu general public license version 3", "This WORK is licensed under the GNU General Public License version 3"]
    docs = spark.createDataFrame([*enumerate(rows), *((i, f"plain {i}") for i in range(10, 60))], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.digest(docs).collect()}
    assert [got[i].labels for i in range(6)] == ["apache", "apache", "", "", "gpl", "gpl"]


def test_clauses_of_whole_licences(spark):
    for label, text, key in licences.TEMPLATES:
        assert f" {key} " in f" {text} " or (label, key) == ("apache", "apache")
    docs = spark.createDataFrame([(i, f"x y z {t.upper()} and more") for i, (_, t, _) in enumerate(licences.TEMPLATES)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licences.digest(docs).collect()}
    assert all(label in got[i].split(",") for i, (label, _, key) in enumerate(licences.TEMPLATES) if key != "apache")


def test_any_word_pattern():
    for w in licences.VOCABULARY:
        assert re.search(licences._ANY, f"x {w.upper()}.") and not re.search(licences._ANY, f"x{w}é {w}qq")
    assert not re.search(licences._ANY, "plain texts about cats")


def test_sql(spark, sf_dir, odd_docs):
    duckdb = pytest.importorskip("duckdb")
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([*TEXTS, *(t for _, t, _ in licences.TEMPLATES)])], "doc_id long, text string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").union(extra)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    expected = con.execute(f"SELECT {', '.join(names)} FROM ({licences.oracle()}) ORDER BY doc_id").fetchall()
    assert list(map(tuple, licences.digest(docs).select(*names).orderBy("doc_id").collect())) == expected


def test_plan_has_no_python(spark, sf_dir):
    plan = licences.digest(table(spark, sf_dir, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(odd_docs, empty_docs):
    rows = licences.digest(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert licences.digest(empty_docs).count() == 0


def test_all_documents_carry_the_notice(spark):
    docs = spark.createDataFrame([(i, "Released under the MIT License.") for i in range(3)], "doc_id long, text string")
    assert [(r.labels, r.score) for r in licences.digest(docs).collect()] == [("mit", 1.0)] * 3


def test_a_text_of_very_many_licences(spark):
    clauses = [t for _, t, _ in licences.TEMPLATES]
    docs = spark.createDataFrame([(0, " ".join(clauses[i % len(clauses)] for i in range(800))), (1, " ".join(clauses * 200)), (2, "mit license")], "doc_id long, text string")
    licences.digest(docs.where("doc_id = 2")).collect()
    began = time.perf_counter()
    got = {r.doc_id: r for r in licences.digest(docs).collect()}
    assert time.perf_counter() - began < 30
    assert got[0].labels == got[1].labels and set(got[0].labels.split(",")) >= {label for label, _, key in licences.TEMPLATES if key != "apache"}
