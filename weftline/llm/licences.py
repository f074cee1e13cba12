"""License scan by sentence rules (op8): built-in functions only.

A text is cut into sentences at blank lines and where a full stop, ``!``, ``?`` or ``;`` is followed by white space. A newline, a list mark
in brackets and the stop of ``v.`` may end a sentence or stand within it, so that wrapped sentences and one-line notices are both found; the
longest known sentence that begins at a place counts. A sentence is normalised: lower case, runs of other characters than a-z and 0-9
become one blank, trimmed. It maps to an identifier if it is one of SENTENCES, or if it is a notice: LEAD, the name of a licence (NOTICES)
and, on the same line, TAIL. The identifiers of a text, in order, form a sequence. A rule is an ordered list of identifiers; it matches
where they stand next to each other in the sequence. The first rule in RULES that matches anywhere gives ``licence``; ``matched`` lists all
rules that match, in the order of RULES. Every sentence of every text is looked up; nothing is shuffled, since a text's own row is enough.

A null or empty text has no sentences, an empty sequence and no licence (null). Repeated rows each give a row; further columns of the
input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import shared

#: Known sentences, normalised, by identifier (fixed values, from the public licence texts and notices).
SENTENCES = {
    "mit license": "mit-title",
    "the mit license": "mit-title",
    "the mit license mit": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "licensed under the apache license version 2 0 the license": "apache2-head",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-asis",
    "gnu general public license": "gpl-title",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-terms",
    "either version 2 of the license or at your option any later version": "gpl2-either",
    "either version 3 of the license or at your option any later version": "gpl3-either",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-ref",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advert",
    "version 3 29 june 2007": "gpl3-date",
    "version 2 june 1991": "gpl2-date",
    "gnu lesser general public license": "lgpl-title",
    "version 2 1 february 1999": "lgpl21-date",
    "gnu affero general public license": "agpl-title",
    "version 3 19 november 2007": "agpl3-date",
    "this library is free software": "lgpl-free",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-terms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-terms",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-free",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "boost software license version 1 0 august 17th 2003": "boost-title",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost-grant",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law": "cc0-deed",
    "the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights defined below upon the creator and subsequent owner s each and all an owner of an original work of authorship and or a database each a work": "cc0-purpose",
    "distributed under the boost software license version 1 0": "boost-ref",
}

#: Known sentences with variable parts, such as the holder's name, by identifier (patterns of fixed values, normalised).
HOLDER = r"(?:[a-z0-9]+ ){1,16}"
VARIABLE = {
    "bsd-names": rf"neither the names? of {HOLDER}(?:nor|or) the names of (?:its|any|the|their|his|her) contributors may be used to endorse or promote products derived from this software without(?: specific)?(?: prior)? written permission",
    "bsd-name-of": rf"the names? of {HOLDER}may not be used to endorse or promote products derived from this software without(?: specific)?(?: prior)? written permission",
    "bsd-advert-of": rf"all advertising materials mentioning features or use of this software must display the following acknowledge?ment this product includes software developed by {HOLDER}?[a-z0-9]+",
}

#: What names a licence in a notice, normalised, by identifier; the first that fits counts (patterns of fixed values).
NOTICES = {
    "agpl3-ref": r"(?:gnu )?(?:affero general public license|agpl)(?: version)? ?v?3(?: 0)?(?: only| or later)?",
    "lgpl3-ref": r"(?:gnu )?(?:lesser general public license|lgpl)(?: version)? ?v?3(?: 0)?(?: only| or later)?",
    "lgpl21-ref": r"(?:gnu )?(?:lesser general public license|lgpl)(?: version)? ?v?2 1(?: only| or later)?",
    "gpl3-later-ref": r"(?:gnu )?(?:general public license|gpl)(?: version)? ?v?3(?: 0)? or (?:any )?later(?: version)?",
    "gpl2-later-ref": r"(?:gnu )?(?:general public license|gpl)(?: version)? ?v?2(?: 0)? or (?:any )?later(?: version)?",
    "gpl3-ref": r"(?:gnu )?(?:general public license|gpl)(?: version)? ?v?3(?: 0)?(?: only)?",
    "gpl2-ref": r"(?:gnu )?(?:general public license|gpl)(?: version)? ?v?2(?: 0)?(?: only)?",
    "apache2-ref": r"apache(?: software)?(?: license)?(?: version)? ?v?2(?: 0)?",
    "mpl2-ref": r"(?:mozilla public license|mpl)(?: version)? ?v? ?2(?: 0)?",
    "epl2-ref": r"(?:eclipse public license|epl)(?: version)? ?v? ?2(?: 0)?",
    "boost-ref": r"(?:boost software license|bsl)(?: version)? ?v?1(?: 0)?",
    "bsd3-ref": r"(?:(?:new|modified|revised) bsd|(?:bsd )?(?:3|three) clause(?: bsd)?)",
    "bsd2-ref": r"(?:(?:simplified|freebsd) bsd|(?:bsd )?(?:2|two) clause(?: bsd)?)",
    "ccbyncsa4-ref": r"(?:creative commons )?(?:cc )?(?:by nc sa|attribution non ?commercial share ?alike) 4 0(?: international)?",
    "ccbyncnd4-ref": r"(?:creative commons )?(?:cc )?(?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s) 4 0(?: international)?",
    "ccbync4-ref": r"(?:creative commons )?(?:cc )?(?:by nc|attribution non ?commercial) 4 0(?: international)?",
    "ccbysa4-ref": r"(?:creative commons )?(?:cc )?(?:by sa|attribution share ?alike) 4 0(?: international)?",
    "ccbynd4-ref": r"(?:creative commons )?(?:cc )?(?:by nd|attribution no ?deriv(?:ative)?s) 4 0(?: international)?",
    "ccbysa3-ref": r"(?:creative commons )?(?:cc )?(?:by sa|attribution share ?alike) 3 0(?: unported| international)?",
    "ccby3-ref": r"(?:creative commons )?(?:cc )?(?:by|attribution) 3 0(?: unported| international)?",
    "artistic2-ref": r"artistic(?: license)?(?: version)? ?v? ?2(?: 0)?",
    "eupl12-ref": r"(?:european union public licen[sc]e|eupl)(?: version)? ?v? ?1 2",
    "ccby4-ref": r"(?:creative commons )?(?:cc )?(?:by|attribution) 4 0(?: international)?",
    "cc0-ref": r"(?:creative commons )?(?:cc0|cc zero)(?: ?1 0)?(?: universal)?(?: public domain dedication)?",
    "isc-ref": r"isc",
    "zlib-ref": r"zlib",
    "unlicense-ref": r"unlicense",
    "mit-ref": r"(?:mit|expat)(?: x11)?",
}
#: What stands before the name: a tag, or a verb with a subject of a few words, not negated.
LEAD = (
    r"(?:spdx license identifier |licen[sc]e[s:]?\x20"
    r"|(?:(?:this|the|all|our|these|its) (?:[a-z0-9]+ ){1,5}(?:is|are) |(?:[a-z0-9]+ )?(?:code|source|software|text|content|data|documentation|project|work|package|library|program) (?:is |are )?)?"
    r"(?:licensed|released|distributed|available|published|provided|made available) (?:under|by|with) (?:the terms (?:and conditions )?of )?(?:the |an? )?)"
)
#: What may follow it.
TAIL = r"(?: licen[sc]e)?(?: (?:see|refer|for|which|as|c|copyright|http|https|found|available|file|in|text|terms|by|you)(?: [a-z0-9]+){0,24})?"

#: Licence and the identifiers that stand for it, in order; more specific rules first (fixed values).
RULES = [
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert-of"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name-of"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-title", "mit-grant"]),
    ("Apache-2.0", ["apache2-head", "apache2-comply", "apache2-copy", "apache2-asis"]),
    ("Apache-2.0", ["apache2-head", "apache2-comply", "apache2-copy"]),
    ("GPL-3.0-or-later", ["gpl3-grant"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-terms", "gpl3-either"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-terms", "gpl2-either"]),
    ("LGPL-2.1-or-later", ["lgpl-free", "lgpl21-terms"]),
    ("LGPL-3.0-or-later", ["lgpl-free", "lgpl3-terms"]),
    ("AGPL-3.0-or-later", ["agpl3-grant"]),
    ("AGPL-3.0-or-later", ["gpl-free", "agpl3-terms"]),
    ("GPL-3.0-only", ["gpl-title", "gpl3-date"]),
    ("GPL-2.0-only", ["gpl-title", "gpl2-date"]),
    ("LGPL-2.1-only", ["lgpl-title", "lgpl21-date"]),
    ("LGPL-3.0-only", ["lgpl-title", "gpl3-date"]),
    ("AGPL-3.0-only", ["agpl-title", "agpl3-date"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("Unlicense", ["unlicense-free", "unlicense-grant"]),
    ("BSL-1.0", ["boost-title", "boost-grant"]),
    ("CC0-1.0", ["cc0-deed"]),
    ("CC0-1.0", ["cc0-purpose"]),
    ("Apache-2.0", ["apache2-head"]),
    ("Unlicense", ["unlicense-free"]),
    ("AGPL-3.0-only", ["agpl3-ref"]),
    ("LGPL-3.0-only", ["lgpl3-ref"]),
    ("LGPL-2.1-only", ["lgpl21-ref"]),
    ("GPL-3.0-or-later", ["gpl3-later-ref"]),
    ("GPL-2.0-or-later", ["gpl2-later-ref"]),
    ("GPL-3.0-only", ["gpl3-ref"]),
    ("GPL-2.0-only", ["gpl2-ref"]),
    ("Apache-2.0", ["apache2-ref"]),
    ("MPL-2.0", ["mpl2-ref"]),
    ("EPL-2.0", ["epl2-ref"]),
    ("BSL-1.0", ["boost-ref"]),
    ("BSD-3-Clause", ["bsd3-ref"]),
    ("BSD-2-Clause", ["bsd2-ref"]),
    ("CC-BY-NC-SA-4.0", ["ccbyncsa4-ref"]),
    ("CC-BY-NC-ND-4.0", ["ccbyncnd4-ref"]),
    ("CC-BY-NC-4.0", ["ccbync4-ref"]),
    ("CC-BY-SA-4.0", ["ccbysa4-ref"]),
    ("CC-BY-ND-4.0", ["ccbynd4-ref"]),
    ("CC-BY-4.0", ["ccby4-ref"]),
    ("CC-BY-SA-3.0", ["ccbysa3-ref"]),
    ("CC-BY-3.0", ["ccby3-ref"]),
    ("Artistic-2.0", ["artistic2-ref"]),
    ("EUPL-1.2", ["eupl12-ref"]),
    ("CC0-1.0", ["cc0-ref"]),
    ("ISC", ["isc-ref"]),
    ("Zlib", ["zlib-ref"]),
    ("Unlicense", ["unlicense-ref"]),
    ("MIT", ["mit-ref"]),
]

#: Short forms whose stop ends no sentence, besides an initial within a name.
SHORT = "v|ver|inc|ltd|corp|co|llc|gmbh|univ"
ENDS = rf"[.!?;](?=\s)(?<!\b(?i:{SHORT})\.)(?<![A-Za-z] [A-Z]\.)"
#: A notice on a line of its own isn't one where the line before ends so.
DENIED = r"\b(?:not|never|isn t|aren t|neither|nor|without being)(?:| [a-z0-9]{1,16}| [a-z0-9]{1,16} [a-z0-9]{1,16})"
#: What may end a sentence or not, besides a newline.
EITHER = r"(?<=\b[vV]|\b[vV]er)\.\s+|(?<=\n)[^a-zA-Z0-9\n]*\(?(?:[0-9]{1,2}|[a-zA-Z])\)(?=\s)"
#: A known sentence between marks; a single mark may stand for a blank, but for those of TAIL.
KNOWN = (
    r"(?<=\|)(?:" + "|".join(s.replace(" ", "[ |]") for s in sorted(SENTENCES, key=len, reverse=True))
    + "|" + "|".join(VARIABLE.values()).replace(" ", "[ |]") + f"|(?<!{DENIED}\\|)" + LEAD.replace(" ", "[ |]") + "(?:" + "|".join(NOTICES.values()).replace(" ", "[ |]") + ")" + TAIL + r")(?=\|)"
)


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    # an identifier is sought only for sentences with a word that all known ones have one of
    hint = "(?i)licen|warrant|permi|redistribut|copyright|free|compliance|version|neither|advertising|available|released|distributed|published|provided|dedicated|anyone|confer"
    near = F.filter(F.split(F.coalesce(text, F.lit("")), ENDS), lambda s: s.rlike(hint))
    plain = F.transform(near, lambda s: F.regexp_replace(F.lower(F.regexp_replace(s, EITHER, "\n")), "[^a-z0-9\n]+", " "))
    marked = F.transform(plain, lambda s: F.concat(F.lit("|"), F.regexp_replace(F.trim(s), " *\n *", "|"), F.lit("|")))
    found = F.transform(F.flatten(F.transform(marked, lambda s: F.regexp_extract_all(s, F.lit(KNOWN), F.lit(0)))), lambda s: F.translate(s, "|", " "))

    def notice(s):
        return F.coalesce(*[F.when(s.rlike(f"^{form}$"), id) for id, form in VARIABLE.items()], *[F.when(s.rlike(f"^{LEAD}{name}{TAIL}$"), id) for id, name in NOTICES.items()])

    return F.transform(found, lambda s: F.coalesce(F.try_element_at(known, s), notice(s)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sequence, matched (both joined by ' '), licence of every row of docs."""
    path = F.concat(F.lit(" "), F.col("sequence"), F.lit(" "))
    hit = [path.contains(f" {' '.join(ids)} ") for _, ids in RULES]
    ids = docs.select("doc_id", identifiers(F.col("text")).alias("_ids"))
    found = ids.select("doc_id", F.size("_ids").alias("n_sentences"), F.array_join("_ids", " ").alias("sequence"))
    matched = F.array_join(F.array_distinct(F.filter(F.array(*[F.when(h, name) for h, (name, _) in zip(hit, RULES, strict=True)]), lambda x: x.isNotNull())), " ")
    return found.select("doc_id", "n_sentences", "sequence", matched.alias("matched"), F.coalesce(*[F.when(h, name) for h, (name, _) in zip(hit, RULES, strict=True)]).alias("licence"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(shared.table(spark, sf_dir, "documents"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)


OP8_SQL = f"""
WITH known(sentence, id) AS (VALUES {_values(SENTENCES.items())}),
rules(k, licence, ids) AS (VALUES {_values((k, name, ' ' + ' '.join(ids) + ' ') for k, (name, ids) in enumerate(RULES))}),
notices(k, pattern, id) AS (VALUES {_values((k, p, id) for k, (id, p) in enumerate([*VARIABLE.items(), *[(id, f"{LEAD}{name}{TAIL}") for id, name in NOTICES.items()]]))}),
rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
pieces AS (
  SELECT r, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos
  FROM (SELECT r, string_split(regexp_replace(replace(regexp_replace(regexp_replace(text, '\\b((?i:{SHORT}))\\.', '\\1', 'g'), '([A-Za-z] [A-Z])\\.', '\\1', 'g'), chr(10), chr(1)), '[.!?;]([ \\t\\r])', chr(1) || '\\1', 'g'), chr(1)) AS s FROM rows)),
bare AS (SELECT r, pos, trim(regexp_replace(lower(sentence), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM pieces),
plain AS (SELECT *, coalesce(regexp_matches(lag(sentence) OVER (PARTITION BY r ORDER BY pos), '{DENIED}$'), false) AS denied FROM bare),
ids AS (
  SELECT r, pos, id FROM plain JOIN known USING (sentence)
  UNION ALL
  SELECT r, pos, arg_min(id, k) FROM plain JOIN notices ON regexp_full_match(sentence, pattern)
  WHERE regexp_matches(sentence, 'licen|released|distributed|available|published|provided|spdx|name|advert') AND NOT denied AND sentence NOT IN (SELECT sentence FROM known) GROUP BY r, pos),
sequences AS (SELECT r, count(*) AS n, string_agg(id, ' ' ORDER BY pos) AS sequence FROM ids GROUP BY r),
hits AS (SELECT r, k, licence, row_number() OVER (PARTITION BY r, licence ORDER BY k) AS first FROM sequences JOIN rules ON contains(' ' || sequence || ' ', ids)),
best AS (SELECT r, string_agg(licence, ' ' ORDER BY k) AS matched, arg_min(licence, k) AS licence FROM hits WHERE first = 1 GROUP BY r)
SELECT doc_id, coalesce(n, 0)::INT AS n_sentences, coalesce(sequence, '') AS sequence, coalesce(matched, '') AS matched, licence
FROM rows LEFT JOIN sequences USING (r) LEFT JOIN best USING (r)
"""
