"""License scans by sentence rules, with DataFrame functions only.

Texts are split into sentences; a sentence, reduced to its ASCII letters and digits in lower case with single blanks,
may be a known licence sentence with an identifier; some sentences hold a name, which may be any. The identifiers of a text, in order, are then matched against
rules: a licence is found where the identifiers of one of its rules stand one after another (other sentences may lie
between them). Sentences and rules are a fixed set, stated below; they are literals of the plan.

A sentence may also be cut itself, where its line is wrapped or by punctuation within ("v. 2.0", "free software: you"):
pieces that start a known sentence are joined with those after them until they are one. Its place is that of its first
piece. The SQL form knows sentences in one piece only, and not HEADERS.

Nulls and empty texts have no sentences. A text that states several licences has all of them; repeats count once. Very
long texts and sentences are read whole. Rows are independent, so ties and repeated rows need no care; an empty table
gives an empty result. Columns sentence_ids and licenses of the input are replaced, others pass through.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence sentences, by identifier, as they stand after normalising.
SENTENCES = {
    "mit-short": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-short": "licensed under the apache license version 2 0",
    "apache-may-not": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "ccbync4": "licensed under cc by nc 4 0",
    "ccby4": "licensed under cc by 4 0",
    "ccbysa4": "licensed under cc by sa 4 0",
    "cc0": "licensed under cc0 1 0",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "gpl2-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl21-redistribute": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "agpl3-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "reserved": "all rights reserved",
}
#: Identifiers that stand after "SPDX-License-Identifier:"; each is a sentence and a rule.
SPDX = [
    "0BSD", "AFL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0",
    "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "MIT", "MIT-0", "MPL-2.0", "MS-PL", "NCSA", "OFL-1.1", "OpenSSL", "PostgreSQL", "PSF-2.0", "Unlicense", "UPL-1.0", "WTFPL", "X11", "Zlib",
]
SENTENCES |= {f"spdx-{name.lower()}": "spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower()) for name in SPDX}
#: Sentences that hold a name, by identifier: how they begin, and the whole of them, after normalising.
SLOTS = {"bsd-endorse": ("neither the name of", "neither the name of [a-z0-9 ]+ may be used to endorse or promote products derived from this software without specific prior written permission")}
#: A licence and the sentences, in order, that state it; longer rules of a licence first.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-licensed",)),
    ("Apache-2.0", ("apache-short", "apache-may-not", "apache-copy")),
    ("Apache-2.0", ("apache-short",)),
    ("GPL-3.0", ("gpl-redistribute", "gpl-hope")),
    ("GPL-3.0", ("gpl-redistribute",)),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-2.0", ("gpl2-redistribute", "gpl-hope")),
    ("GPL-2.0", ("gpl2-redistribute",)),
    ("LGPL-2.1", ("lgpl21-redistribute",)),
    ("AGPL-3.0", ("agpl3-redistribute",)),
    ("CC-BY-NC-4.0", ("ccbync4",)),
    ("CC-BY-4.0", ("ccby4",)),
    ("CC-BY-SA-4.0", ("ccbysa4",)),
    ("CC0-1.0", ("cc0",)),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution",)),
    ("MPL-2.0", ("mpl2",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense",)),
    ("Proprietary", ("reserved",)),
    *((re.sub("-(only|or-later)$", "", name), (f"spdx-{name.lower()}",)) for name in SPDX),
]
#: Further forms of the sentences in standard headers.
HEADERS = {
    "licensed under the apache license version 2 0 the license": "apache-short",
}
#: Every sentence has one of these; texts without them are not searched for sentences in several pieces.
ANCHORS = "(?i)licen|permission|warranty|redistribution|endorse|unencumbered|rights"
#: Ends of sentences: punctuation before white space or at the end of the text, and line ends.
SENTENCE_END = "[.;:!?]+(?:[ \\t\\r\\f]+|\\z)|[.;:!?]*[\\r\\f]*\\n"
#: Joined pieces, as they stand after normalising, of this many characters or more are no known sentence: the longest has fewer.
LONGEST = 600
#: A sentence of fewer characters is no known one: the shortest has 19 letters and blanks after normalising.
SHORTEST = 10


def sentence_ids(text: Column) -> Column:
    """(at, id) of the known sentences of a text, in order; at counts the sentences before."""
    forms = {s: i for i, s in SENTENCES.items()} | HEADERS
    known = F.create_map(*(F.lit(x) for pair in forms.items() for x in pair))
    slotted = lambda s: F.coalesce(*(F.when(s.startswith(front) & s.rlike(f"^{whole}$"), F.lit(i)) for i, (front, whole) in SLOTS.items()))
    of = lambda s: F.coalesce(known[s], slotted(s))
    pieces = F.split(F.coalesce(text, F.lit("")), SENTENCE_END)
    sentences = F.transform(pieces, lambda s, i: F.struct(i.alias("at"), s.alias("s")))
    normal = lambda s: F.lower(F.trim(F.regexp_replace(s, "[^A-Za-z0-9]+", " ")))
    short = F.filter(sentences, lambda x: F.length(x["s"]) >= SHORTEST)
    found = F.transform(short, lambda x: F.struct(x["at"].alias("at"), of(normal(x["s"])).alias("id")))
    found = F.filter(found, lambda x: x["id"].isNotNull())
    fronts = [front for front, _ in SLOTS.values()]
    begun = lambda s: F.exists(F.array(*map(F.lit, [*forms, *fronts])), lambda k: k.startswith(F.concat(s, F.lit(" "))))
    starts = lambda s: begun(s) | F.exists(F.array(*map(F.lit, fronts)), lambda k: s.startswith(k))

    def joined(state: Column, piece: Column) -> Column:
        longer = F.concat_ws(" ", state["s"], piece["s"])
        return F.when(state["id"].isNotNull() | (F.length(state["s"]) >= LONGEST), state).otherwise(F.struct(longer.alias("s"), of(longer).alias("id")))

    def several(p: Column) -> Column:
        """p: pieces that are not empty; each adds two characters at least, so LONGEST bounds how many can matter."""
        run = lambda x, i: F.aggregate(F.slice(p, i + 2, LONGEST // 2), F.struct(x["s"].alias("s"), F.lit(None).cast("string").alias("id")), joined)["id"]
        return F.filter(F.transform(p, lambda x, i: F.struct(x["at"].alias("at"), F.when(starts(x["s"]), run(x, i)).alias("id"))), lambda x: x["id"].isNotNull())

    full = F.filter(F.transform(sentences, lambda x: F.struct(x["at"].alias("at"), normal(x["s"]).alias("s"))), lambda x: x["s"] != "")
    whole = lambda one: F.array_sort(F.concat(one, F.filter(F.transform(F.array(full), several)[0], lambda x: ~F.exists(one, lambda y: y["at"] == x["at"]))))
    return F.when(F.coalesce(text, F.lit("")).rlike(ANCHORS), F.transform(F.array(found), whole)[0]).otherwise(found)


def find_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with sentence_ids and licenses, both in order, as arrays of (at, id) and of names.

    Longer rules come first and take their sentences: what a longer rule covers does not count for a shorter one.
    """
    rules = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(ids).alias("ids")) for name, ids in by_length()))
    line = F.concat(F.lit("|"), F.array_join(F.transform("sentence_ids", lambda x: x["id"]), "||"), F.lit("|"))
    start = F.struct(line.alias("line"), F.array().cast("array<string>").alias("found"))
    step = lambda s, r: F.when(F.instr(s["line"], r["ids"]) > 0, F.struct(F.replace(s["line"], r["ids"], F.lit("#")).alias("line"), F.array_append(s["found"], r["license"]).alias("found"))).otherwise(s)
    matched = F.array_sort(F.array_distinct(F.aggregate(rules, start, step, lambda s: s["found"])))
    none = F.array().cast("array<string>")
    return docs.withColumn("sentence_ids", sentence_ids(F.col(text))).withColumn("licenses", F.when(F.size("sentence_ids") > 0, matched).otherwise(none))


def by_length() -> list[tuple[str, str]]:
    """Rules as licence and identifiers in bars, those of most sentences first."""
    return [(name, "|" + "||".join(ids) + "|") for name, ids in sorted(RULES, key=lambda r: -len(r[1]))]
