"""What operators must not leave out."""

import random
from math import comb

import brute

from weftline.llm import licences, neardup, pagetext, suffixes


def missed(stages, similarity):
    """Chance that a pair is pruned by any of the comparisons."""
    left, seen, lost = {0: 1.0}, 0, 0.0
    for n, least in stages:
        now = {}
        for m, p in left.items():
            for j in range(n - seen + 1):
                now[m + j] = now.get(m + j, 0) + p * comb(n - seen, j) * similarity**j * (1 - similarity) ** (n - seen - j)
        lost += sum(p for m, p in now.items() if m < least)
        left, seen = {m: p for m, p in now.items() if m >= least}, n
    return lost


def test_pairs_at_the_threshold_are_seldom_pruned(spark, monkeypatch):
    used, whole = [], neardup.least_matches
    monkeypatch.setattr(neardup, "least_matches", lambda *a, **b: used.append(whole(*a, **b)) or used[-1])
    neardup.join(spark.createDataFrame([(i, f"a b c d e {i}") for i in range(4)], "doc_id long, text string"))
    assert len(used) >= 2 and all(missed(stages, 0.8) < 6e-4 for stages in used)


def test_all_links_are_counted(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 16)
    rnd = random.Random(4)
    base = [[f"w{rnd.randrange(3000)}" for _ in range(150)] for _ in range(2)]

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(3000)}"
        return " ".join(words)

    texts = [edited(base[i % 3 == 0], rnd.randint(0, 5)) for i in range(80)]
    texts += texts[:5] + ["", "", "one two", "one two", "other words that nothing is like"]
    sets = [brute.shingles(t) for t in texts]
    alike = lambda a, b: bool(a and b) and len(a & b) / len(a | b) >= 0.8
    different = [{t for t, s in zip(texts, sets, strict=True) if t != texts[i] and alike(s, x)} for i, x in enumerate(sets)]
    want = {i: len(d) + (texts.count(texts[i]) - 1 if sets[i] else 0) for i, d in enumerate(different)}
    assert max(want.values()) > 20
    got = neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert {r.doc_id: r.n_links for r in got.collect()} == want


def test_text_after_odd_tags_stays():
    for odd, left in (("</>", ""), ("</3 b>", ""), ("</ p>", ""), ("<!odd>", ""), ("<!-->", ""), ("<!--->", ""), ("<!-- c --!>", ""), ("<β ", "<β "), ("<é", "<é"), ("< ", "< "), ("<3", "<3")):
        assert pagetext.main_text(f"<p>one {odd}and two</p><p>three</p>") == f"one {left}and two\nthree", odd
    for attributes in ("title=it's", "title='it's'", "don't", "a=\"x\"y\"", "a='>' b=\">\"", "a = 'x'/", "=", "a=", "a==\"b", "a=x/y"):
        assert pagetext.main_text(f"<p {attributes}>Hello</p><p>don't</p><p>\"so\" it's</p>") == "Hello\ndon't\n\"so\" it's", attributes
    assert pagetext.main_text("<p>kept</p><a href='x") == "kept"
    assert pagetext.main_text("<p>kept <β") == "kept <β"
    assert pagetext.main_text("<p>kept</p><p " + "a " * 20000 + "'\"" * 20000) == "kept"


MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE.
"""
BSD = """Copyright (c) 2020, Somebody Inc. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
{} Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
{} Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{} Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """    This program is free software{} you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation{} either version {} of the License, or
    (at your option) any later version.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""


ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.
"""


def test_every_identifier_has_a_rule():
    used = {i for _, ids in licences.RULES for i in ids}
    assert used == {*licences.SENTENCES.values(), *licences.NOTICES}


def test_wrapped_licences(spark):
    comment = lambda t, mark: "".join(f"{mark} {line}\n" for line in t.split("\n"))
    plain = [(MIT, "MIT"), (APACHE, "Apache-2.0"), (MPL, "MPL-2.0"), (" ".join(MPL.split()), "MPL-2.0"), (GPL.format(":", ",", 3), "GPL-3.0-or-later"), (GPL.format(";", ";", 2), "GPL-2.0-or-later")]
    plain += [(BSD.format(*marks), "BSD-3-Clause") for marks in (("1.", "2.", "3."), ("(1)", "(2)", "(3)"), ("a)", "b)", "c)"), ("*", "*", "*"), ("-", "-", "-"))]
    want = [(c, name) for t, name in plain for c in (t, t.replace("\n", "\r\n"), comment(t, " *"), comment(t, "//"), f"Some words\n{t}\nmore words")]
    want += [("words\nReleased under the MIT License\nwords", "MIT"), ("Released under\n\nthe MIT License", None), ("A v. Released under the MIT License.", "MIT"), ("not released under the MIT License at all", None)]
    want += [("This project is released under the MIT License.", "MIT"), ("Released under the MIT License, see LICENSE.", "MIT"), ("This project is not released under the MIT License.", None), ("Copyright 2020.\nSPDX-License-Identifier: Apache-2.0", "Apache-2.0")]
    want += [("This work is licensed under a\nCreative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"), ("All of the code here is distributed under the terms of the GNU GPL v2 or later.", "GPL-2.0-or-later")]
    want += [("Licensed under the BSD 3-Clause License", "BSD-3-Clause"), ("The mitigation is provided by the committee", None), ("All rights reserved.", None), ("// SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-or-later"), (f"{ISC}", "ISC"), (comment(ISC, "#"), "ISC")]
    got = licences.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "doc_id long, text string")).orderBy("doc_id").collect()
    for r, (text, name) in zip(got, want, strict=True):
        assert r.licence == name, (text, r)
    assert got[0].sequence == "mit-title mit-grant mit-notice mit-warranty"


def test_texts_of_equal_short_hashes_stay_apart(spark):
    text = lambda i, n: " ".join(f"w{i}x{k}" for k in range(1, n + 1))
    few, many = [text(i, 8) for i in (5047, 229156)], [text(i, 60) for i in (90370, 165305)]
    frame = lambda texts: spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    for pair in few, many:
        assert frame(pair).selectExpr("count(distinct hash(text, true)) AS n").first().n == 1
    assert sorted(r.text for r in neardup.one_of_each(frame(few)).collect()) == sorted(few)
    assert [r.n_links for r in neardup.classes(frame(few)).collect()] == [0, 0]
    texts = [*many, "and " + many[0]]
    got = [tuple(r)[1:] for r in suffixes.removal(frame(texts)).collect()]
    assert sorted(got) == sorted(brute.removal(texts))
    assert sorted(r.text for r in suffixes.without_repeats(frame(texts)).collect()) == sorted(["and ", many[1]])


def test_records_query_equals_library(spark, sf_dir):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from weftline.llm import records

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = [*coder.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in records.op6_binary_records(spark, sf_dir).orderBy("doc_id").collect()] == want
