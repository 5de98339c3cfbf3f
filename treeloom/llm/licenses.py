"""License scans by sentence rules, in DataFrame operations alone.

A text is cut into pieces at line breaks and sentence ends, each normalised (A-Z lower-cased, runs
of other characters than a-z and 0-9 as one space). A known licence sentence is a run of whole
pieces that reads as the sentence, however it is wrapped, commented, cut after an abbreviation or
numbered as an item of a list. From each piece on the first three words are looked up, which gives the
lengths of the sentences that begin so, and then the words of each such length; the longest sentence
counts, and what begins within it doesn't. Every other piece is a sentence of its
own, so a notice on one line is one. The sequence
of identifiers that results, 0 for unknown sentences, is matched against licence rules in
their order: a rule is a run of identifiers; what one rule has matched, later rules don't
see, so longer rules stand before those they contain.

The catalogue is part of the program, not of the data: it is a literal hash table in the plan, and
the scan is one projection without a shuffle, whose cost doesn't grow with the number of sentences;
a very frequent licence line costs nothing extra.

Cases: a null or empty text has no sentences and no licences; a sentence that repeats is
matched each time; a document of any length is one row; rows with one doc_id are scanned
one by one; extra columns stay.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import LOWER, UPPER

# Sentences of public licences and licence notices, by identifier.
SENTENCES = {
    1: "Licensed under the Apache License, Version 2.0.",
    2: "Released under the MIT License.",
    3: "This work is licensed under the GNU General Public License, version 3.",
    4: "Licensed under CC BY-NC 4.0.",
    5: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    6: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    7: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    8: "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    9: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    10: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    11: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    12: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    13: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    14: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    15: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    16: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    17: "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    18: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    19: "Licensed under the MIT License.",
    20: "All rights reserved.",
    21: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    22: "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    23: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    24: "This software is provided 'as-is', without any express or implied warranty.",
    25: "In no event will the authors be held liable for any damages arising from the use of this software.",
    26: "This is free and unencumbered software released into the public domain.",
    27: "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    28: "Boost Software License - Version 1.0 - August 17th, 2003",
    29: "Distributed under the Boost Software License, Version 1.0.",
    30: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    31: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    32: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    33: "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    34: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    35: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    36: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    37: "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.",
    38: "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    39: "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").",
    40: "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL.",
    41: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    42: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    43: "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    44: "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    45: "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.",
    46: "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    47: "This program is free software. It comes without any warranty, to the extent permitted by applicable law.",
    48: "Licensed under the Academic Free License version 3.0",
    49: "Licensed under the Open Software License version 3.0",
    50: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer in this position and unchanged.",
    51: "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    52: "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    53: "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    54: "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    55: "You may distribute under the terms of either the GNU General Public License or the Artistic License.",
    56: "This software is licensed under the PSF license agreement for Python.",
    57: "By obtaining, using and/or copying this work, you (the licensee) agree that you have read, understood, and will comply with the following terms and conditions.",
    58: "Licensed under the Microsoft Public License.",
    59: "Licensed under the terms of the ISC license.",
    60: "Licensed under the BSD 3-Clause License.",
    61: "Licensed under the BSD 2-Clause License.",
    62: "SPDX-License-Identifier: MIT",
    63: "SPDX-License-Identifier: Apache-2.0",
    64: "SPDX-License-Identifier: GPL-2.0-only",
    65: "SPDX-License-Identifier: GPL-2.0-or-later",
    66: "SPDX-License-Identifier: GPL-3.0-only",
    67: "SPDX-License-Identifier: BSD-3-Clause",
    68: "SPDX-License-Identifier: BSD-2-Clause",
    69: "SPDX-License-Identifier: MPL-2.0",
}

# Rules in order, a licence expression and the identifiers that stand one after another.
RULES = [
    ("MIT", (5, 6, 7)),
    ("Apache-2.0", (8, 9)),
    ("GPL-3.0-or-later", (10, 11)),
    ("BSD-4-Clause", (12, 13, 14, 51)),
    ("BSD-3-Clause", (12, 13, 14, 15)),
    ("BSD-2-Clause", (12, 13, 14)),
    ("MPL-2.0", (16, 17)),
    ("Apache-2.0", (1,)),
    ("Apache-2.0", (8,)),
    ("MIT", (2,)),
    ("MIT", (19,)),
    ("MIT", (5,)),
    ("GPL-3.0-only", (3,)),
    ("GPL-3.0-or-later", (10,)),
    ("CC-BY-NC-4.0", (4,)),
    ("CC-BY-4.0", (18,)),
    ("MPL-2.0", (16,)),
    ("LicenseRef-proprietary", (20,)),
    ("ISC", (21, 22)),
    ("ISC", (21,)),
    ("0BSD", (23, 22)),
    ("0BSD", (23,)),
    ("Zlib", (24, 25)),
    ("Unlicense", (26, 27)),
    ("Unlicense", (26,)),
    ("BSL-1.0", (28,)),
    ("BSL-1.0", (29,)),
    ("BSL-1.0", (52,)),
    ("GPL-2.0-or-later", (30, 11)),
    ("GPL-2.0-only", (31, 11)),
    ("LGPL-2.1-or-later", (32, 33)),
    ("AGPL-3.0-or-later", (34, 11)),
    ("LGPL-3.0-or-later", (35, 11)),
    ("GPL-2.0-or-later", (30,)),
    ("GPL-2.0-only", (31,)),
    ("LGPL-2.1-or-later", (32,)),
    ("AGPL-3.0-or-later", (34,)),
    ("LGPL-3.0-or-later", (35,)),
    ("EPL-2.0", (36,)),
    ("EPL-1.0", (37,)),
    ("MPL-1.1", (38,)),
    ("CDDL-1.0", (39,)),
    ("EUPL-1.2", (40,)),
    ("CC-BY-SA-4.0", (41,)),
    ("CC-BY-NC-4.0", (42,)),
    ("CC-BY-ND-4.0", (43,)),
    ("CC-BY-NC-SA-4.0", (44,)),
    ("CC0-1.0", (45,)),
    ("WTFPL", (46,)),
    ("WTFPL", (47,)),
    ("AFL-3.0", (48,)),
    ("OSL-3.0", (49,)),
    ("BSD-2-Clause-Views", (50,)),
    ("OFL-1.1", (53,)),
    ("PostgreSQL", (54,)),
    ("Artistic-1.0-Perl OR GPL-1.0-or-later", (55,)),
    ("PSF-2.0", (56,)),
    ("W3C", (57,)),
    ("MS-PL", (58,)),
    ("ISC", (59,)),
    ("BSD-3-Clause", (60,)),
    ("BSD-2-Clause", (61,)),
    ("MIT", (62,)),
    ("Apache-2.0", (63,)),
    ("GPL-2.0-only", (64,)),
    ("GPL-2.0-or-later", (65,)),
    ("GPL-3.0-only", (66,)),
    ("BSD-3-Clause", (67,)),
    ("BSD-2-Clause", (68,)),
    ("MPL-2.0", (69,)),
]

#: Between pieces: line breaks, or white space after a full stop, question or exclamation mark.
BREAK = r"[\n\r]+|(?<=[.!?])[ \t]+"
#: Stands at the cuts; SQL's engine has no look-behind, so there it is put in by a pattern of its own.
MARK = "\x01"


def normalised(s: str) -> str:
    import re

    return re.sub(r"[^a-z0-9]+", " ", s.translate(str.maketrans(UPPER, LOWER))).strip(" ")


#: The number or letter of a list's item may stand before a sentence, in its piece or in one of its own.
ITEM = "^(?:[0-9]{1,2}|[a-z]) "
#: Words that a sentence is first looked up by.
HEAD = 3
#: Pieces whose runs are settled one after another before they join those of earlier blocks.
BLOCK = 64


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _lookup(book: dict[str, Column], kind: str):
    """A hash table as a literal: keys lie in buckets by CRC-32, so a lookup costs the same whatever the number of keys."""
    n = 1 << max(4, (2 * len(book)).bit_length())
    cells: list[list] = [[] for _ in range(n)]
    for key, value in book.items():
        cells[crc32(key.encode()) % n].append(F.struct(F.lit(key).alias("key"), value.alias("value")))
    none = F.array().cast(f"array<struct<key:string,value:{kind}>>")
    table = F.array(*(F.array(*c) if c else none for c in cells))
    return lambda key: F.get(F.filter(F.get(table, (F.crc32(key) % n).cast("int")), lambda e: e["key"] == key), F.lit(0))["value"]


def _longest_runs(pieces: Column, known: dict[str, int]) -> Column:
    """For each piece (size, id, pieces) of the longest sentence that reads from there as whole pieces, null if none does."""
    lengths: dict[str, set[int]] = {}
    for x in known:
        lengths.setdefault(" ".join(x.split(" ")[:HEAD]), set()).add(x.count(" ") + 1)
    sizes = _lookup({x: F.array(*map(F.lit, sorted(n))) for x, n in lengths.items()}, "array<int>")
    identifier = _lookup({x: F.lit(i) for x, i in known.items()}, "int")
    heads = sorted({x.count(" ") + 1 for x in lengths})
    no_sizes, nothing = F.array().cast("array<int>"), F.lit(None).cast("struct<size:int,id:int,pieces:int>")

    def from_piece(_, k):
        joined = lambda n: F.concat_ws(" ", F.slice(pieces, k + 1, n))

        def run(skip, n):
            def known_run(words):
                ends = F.transform(F.sequence(F.lit(1), n + 1), lambda m: F.length(joined(m)))
                size = F.array_position(ends, skip + F.length(words)).cast("int")
                found = lambda i: F.when(i.isNotNull() & (size > 0), F.struct(F.length(words).alias("size"), i.alias("id"), size.alias("pieces"))).otherwise(nothing)
                return _let(identifier(words), found)

            return _let(F.call_function("substring_index", F.substr(joined(n + 1), skip + 1), F.lit(" "), n), known_run)

        def tried(start):
            def after(skip):
                rest = F.substr(start, skip + 1)
                tries = [F.coalesce(_let(F.substring_index(rest, " ", h), sizes), no_sizes) for h in heads]
                return F.transform(F.concat(*tries), lambda n: run(skip, n))

            return F.array_max(F.flatten(F.transform(F.array_distinct(F.array(F.lit(0), F.length(F.regexp_extract(start, ITEM, 0)))), after)))

        return _let(joined(HEAD + 1), tried)

    return F.transform(pieces, from_piece)


def _settled(found: Column) -> Column:
    """Identifiers from the first piece on: a run hides what begins within it; a piece without a run is 0."""
    runs = F.transform(found, lambda r, k: F.struct(k.alias("at"), F.coalesce(r["id"], F.lit(0)).alias("id"), F.coalesce(r["pieces"], F.lit(1)).alias("pieces")))

    def one(state, r):
        free = r["at"] >= state["free"]
        return F.struct(
            F.when(free, r["at"] + r["pieces"]).otherwise(state["free"]).alias("free"),
            F.when(free, F.concat(state["ids"], F.array(r["id"]))).otherwise(state["ids"]).alias("ids"),
        )

    def block(runs, state, at):
        start = F.struct(state["free"].alias("free"), F.array().cast("array<int>").alias("ids"))
        grown = lambda s: F.struct(s["free"].alias("free"), F.concat(state["ids"], F.array(s["ids"])).alias("ids"))
        return _let(F.aggregate(F.slice(runs, at + 1, BLOCK), start, one), grown)

    begin = F.struct(F.lit(0).alias("free"), F.array().cast("array<array<int>>").alias("ids"))
    return _let(runs, lambda r: F.aggregate(F.sequence(F.lit(0), F.size(r) - 1, F.lit(BLOCK)), begin, lambda s, at: block(r, s, at), lambda s: F.flatten(s["ids"])))


def sentence_ids(text: Column, sentences: dict[int, str]) -> Column:
    """Array of identifiers of the sentences that hold a letter or digit, 0 for unknown ones."""
    known = {x: i for i, x in reversed([(i, normalised(s)) for i, s in sentences.items()]) if x}
    cut = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), MARK, " "), BREAK, MARK)
    # the class lists its characters, as Java tests ranges one after another, seven times as slowly
    plain = F.regexp_replace(F.translate(cut, UPPER, LOWER), f"[^{LOWER}0123456789{MARK}]+", " ")
    whole = F.filter(F.split(F.regexp_replace(plain, f" ?{MARK}[ {MARK}]*", "|"), r"\|"), lambda p: F.btrim(p) != "")
    # a longer piece is part of no sentence, and stays longer than any
    pieces = F.transform(whole, lambda p: F.substring(F.btrim(p), 1, max(map(len, known), default=0) + 5))
    if not known:
        return F.transform(pieces, lambda p: F.lit(0))
    unknown = lambda found: F.array_repeat(F.lit(0), F.size(found))
    runs = lambda p: _let(_longest_runs(p, known), lambda found: F.when(F.exists(found, lambda r: r.isNotNull()), _settled(found)).otherwise(unknown(found)))
    return _let(pieces, runs)


def scan(docs: DataFrame, text_col: str = "text", sentences: dict[int, str] | None = None, rules: list | None = None) -> DataFrame:
    """The rows with n_sentences, n_known and ``matches``: an array of (rule, license, n) in rule order.

    Rules are numbered from 1. Columns of these names are replaced.
    """
    sentences, rules = sentences or SENTENCES, RULES if rules is None else rules
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), sentence_ids(F.col(f"`{text_col}`"), sentences).alias("ids"))
    seq = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), "")
    book = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(name).alias("license"), F.lit("".join(f"<{i}>" for i in run)).alias("run")) for n, (name, run) in enumerate(rules, 1)))
    start = F.struct(seq.alias("seq"), F.array().cast("array<struct<rule:int,license:string,n:int>>").alias("hits"))

    def step(state, rule):
        rest = F.replace(state["seq"], rule["run"], F.lit("<0>"))
        # every match shortens the sequence by the same length; of a one-identifier rule too, counted by its run
        n = F.floor((F.length(state["seq"]) - F.length(F.replace(state["seq"], rule["run"], F.lit("")))) / F.length(rule["run"])).cast("int")
        hit = F.array(F.struct(rule["rule"].alias("rule"), rule["license"].alias("license"), n.alias("n")))
        return F.struct(rest.alias("seq"), F.when(n > 0, F.concat(state["hits"], hit)).otherwise(state["hits"]).alias("hits"))

    known = F.size(F.filter("ids", lambda i: i > 0))
    hits = F.when(known > 0, F.aggregate(book, start, step, lambda s: s["hits"])).otherwise(F.array().cast("array<struct<rule:int,license:string,n:int>>"))
    new = {"n_sentences": F.size("ids").cast("long"), "n_known": known.cast("long"), "matches": hits}
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new), *(v.alias(k) for k, v in new.items()))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """Per document: n_sentences, n_known, n_matches, the licences found (sorted, joined by comma) and the rules as ``rule:count``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    m = F.col("matches")
    return scan(docs).select(
        "doc_id", "n_sentences", "n_known",
        F.aggregate(F.transform(m, lambda x: x["n"].cast("long")), F.lit(0).cast("long"), lambda a, b: a + b).alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["license"]))), ",").alias("licenses"),
        F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["rule"].cast("string"), x["n"].cast("string"))), ",").alias("rules"),
    )


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({q(normalised(s))}, {i})" for i, s in SENTENCES.items())
    steps, last = [], "q0"
    for n, (name, run) in enumerate(RULES, 1):
        r = q("".join(f"<{i}>" for i in run))
        steps.append(f"q{n} AS (SELECT * REPLACE (replace(seq, {r}, '<0>') AS seq), ((length(seq) - length(replace(seq, {r}, ''))) / {len(r) - 2})::BIGINT AS n{n} FROM {last})")
        last = f"q{n}"
    each = range(1, len(RULES) + 1)
    names = ", ".join(f"CASE WHEN n{n} > 0 THEN {q(RULES[n - 1][0])} END" for n in each)
    shown = ", ".join(f"CASE WHEN n{n} > 0 THEN '{n}:' || n{n} END" for n in each)
    return rf"""
WITH parts AS (
  SELECT doc_id, unnest(range(1, len(p) + 1)) AS pos, unnest(p) AS s FROM (
    SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '[\n\r]+', chr(1), 'g'), '([.!?])[ \t]+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents)),
kept AS (SELECT doc_id, pos, trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' ') AS s
  FROM parts WHERE regexp_matches(s, '[A-Za-z0-9]')),
known(s, id) AS (VALUES {known}),
ids AS (SELECT doc_id, pos, coalesce(id, 0) AS id FROM kept LEFT JOIN known USING (s)),
q0 AS (SELECT d.doc_id, count(i.pos)::BIGINT AS n_sentences, count(i.pos) FILTER (id > 0)::BIGINT AS n_known,
    coalesce(string_agg('<' || id || '>', '' ORDER BY pos), '') AS seq
  FROM documents d LEFT JOIN ids i ON d.doc_id = i.doc_id GROUP BY d.doc_id),
{", ".join(steps)}
SELECT doc_id, n_sentences, n_known, ({" + ".join(f"n{n}" for n in each)})::BIGINT AS n_matches,
  array_to_string(list_sort(list_distinct([x FOR x IN [{names}] IF x IS NOT NULL])), ',') AS licenses,
  array_to_string([x FOR x IN [{shown}] IF x IS NOT NULL], ',') AS rules
FROM {last}
"""


OP1_SQL = _sql()
