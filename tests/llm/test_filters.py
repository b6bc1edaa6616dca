import re

import duckdb
from pyspark.sql import functions as F

from tidewell.llm import license_scan, url_filter


def test_rules_are_looked_up_in_order_and_consume_their_sentences(spark):
    header = "Licensed under the Apache License, Version 2.0 (the \"License\").\nYou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at http://x.y/z\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis."
    rows = [(1, header), (2, "This file is licensed under the MIT license. All rights reserved"), (3, None), (4, ""), (5, "no licence here"), (6, "This work is licensed under the MIT license.\n" * 3), (7, "x " * 50_000 + "\nAll rights reserved"), (8, "You may not use this file except in compliance with the License")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("unmatched", F.lit(1))
    got = {r["doc_id"]: (r["ids"], [(x["name"], x["n"]) for x in r["licenses"]], r["unmatched"]) for r in license_scan.scan(docs).collect()}
    assert got[1][1] == [("Apache-2.0-header", 1)] and got[1][2] == []
    assert got[2] == (["MIT", "RIGHTS"], [("MIT", 1), ("proprietary", 1)], [])
    assert got[3] == got[4] == got[5] == ([], [], [])
    assert got[6][1] == [("MIT", 3)] and got[7][1] == [("proprietary", 1)]
    assert got[8] == (["APACHE_MAY_NOT"], [], ["APACHE_MAY_NOT"])
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_urls_against_a_plain_loop(spark):
    urls = [
        "http://a.example.org/es/x", "http://example.org/es", "HTTP://EXAMPLE.org/en/12?q", "https://notexample.org/es/", "http://x.com/de/a#b", "http://x.com/fr/", "http://com/de/", "http://x.com",
        "no scheme", "", None, "x://?q", "a://b://c/de/", "http://x.com/de/\n/y", "http://x.com/" + "d" * 100_000, "http://.com/de/", "http://x.com:80/de/",
    ]
    rows = [(i, u) for i, u in enumerate(urls + urls[:3])]

    def plain(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, url_filter.DEFAULT)))

    pages = spark.createDataFrame(rows, "page_id int, url string").withColumns({"host": F.lit("mine"), "rule": F.lit(0)})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.rules_frame(spark)).collect()}
    assert got == {i: plain(u) for i, u in rows}
    assert url_filter.judge(pages.limit(0), url_filter.rules_frame(spark)).count() == 0


def test_wrapped_and_oddly_spaced_licence_texts_are_found(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining
a copy of this software, to deal in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS-IS", WITHOUT WARRANTY OF ANY KIND"""
    bsd = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:
#
# THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS
# IS" AND ANY EXPRESS OR IMPLIED WARRANTIES"""
    gpl = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of"""
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"""
    want = {
        mit: ["MIT-text"], bsd: ["BSD-text"], gpl: ["GPL-header"], apache: ["Apache-2.0-header"], apache.replace("\n", "\r\n"): ["Apache-2.0-header"],
        "This work is released under CC BY-SA 4.0.": ["CC-BY-SA"], "Distributed under CC BY 4.0": ["CC-BY"], "x.\nAll  rights\treserved\ny": ["proprietary"],
        "Licensed under Creative Commons Attribution-\nShareAlike 4.0": ["CC-BY-SA"], "All\nrights reserved": ["proprietary"], "All\n\nrights reserved": [], "not all rights reserved": [],
        "-" * 300_000 + "\n" * 3 + "; " * 100_000 + "All rights reserved": ["proprietary"], "#All rights reserved| Licensed under the MIT license": [],
    }
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id int, text string")
    got = {r["doc_id"]: [x["name"] for x in r["licenses"]] for r in license_scan.scan(docs).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


def test_every_known_sentence_has_a_word_that_texts_are_tried_for():
    words = [words for words, _, _ in license_scan.SENTENCES]
    assert all(re.search(license_scan.WORDS.replace(r"[^\p{L}\p{N}]+", " "), w) for w in words)
    assert len({*words}) == len(words)


def test_sentences_are_looked_up_whole_or_by_their_first_words(spark):
    want = {
        "SPDX-License-Identifier: GPL-3.0-or-later": "GPL_VER",
        "This file is released under the terms of the GNU General Public License, version 2 or (at your option) any later version.": "GPL_VER",
        "This work is\nlicensed under\nthe MIT\nLicense": "MIT",
        "Licensed under the MIT licenses": "",
        "Licensed under the MIT license today": "",
        "Licensed under CC BY\nSA 4.0 International": "CC_BY_SA",
        "Licensed under CC bye": "",
        "THIS SOFTWARE IS PROVIDED BY " + "A. B " * 9 + "``AS IS'' AND more": "",
        "THIS SOFTWARE IS PROVIDED BY " + "A B " * 10 + "``AS IS'' AND more": "ASIS",
        "THIS SOFTWARE IS PROVIDED BY " + "A B " * 11 + "``AS IS'' AND more": "",
        "All rights reserved\n" * 100: ",".join(["RIGHTS"] * 100),
        "All rights reserved; Licensed under the BSD license": "RIGHTS,BSD",
    }
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id int, text string")
    got = {r["doc_id"]: ",".join(r["ids"]) for r in license_scan.scan(docs).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    theirs = {r[0]: r[2] for r in con.sql(license_scan.SQL["op1_license_scan"]).fetchall()}
    assert theirs == got
