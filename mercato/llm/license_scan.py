"""License scans by sentence rules.

A text is cut into sentences: line breaks and comment marks inside a notice are
blanks; sentences end at full stops, blank lines, list items, colons at a line's
end and before lines that open a notice.  Each is normalised (lower case, runs of
other than letters and digits become one blank) and looked up among known licence
sentences; one that is not known is looked up clause by clause (";" and ":"), and
an unknown clause line by line, so a notice without a full stop is found between
other lines.  This gives the text a sequence of sentence identifiers.  Ordered
rules, the most specific first, match runs of the sequence; what a rule matched
is taken out, so a general rule cannot claim it again.  Identifiers that no rule
takes are reported as unmatched.  A tag names its licence itself: the expression
it states follows the licences of the rules.

DataFrame functions only and no shuffle: texts without a licence word are done
after a substring test, and only sentences with such a word are normalised.

Defined results: null, empty or licence-free text gives empty lists; a notice
that occurs twice is reported once per occurrence run in `sequence` and once in
`licenses`; repeated rows get equal results; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

# Words one of which every known sentence has, in one piece as written.
WORDS = ("licen", "copyright", "permission", "warrant", "redistribut", "unencumbered", "liab", "endorse", "reserved",
         "distributed", "advertising", "dedicated")

# Identifier -> normalised sentence (a whole-sentence pattern).
SENTENCES = {
    "spdx-tag": r"spdx license identifier [a-z0-9 ]+",
    "copyright-line": r"(c )?copyright (c )?[0-9 ]+.*|copyright (c )?[a-z].*",
    "rights-reserved": r"all rights reserved",
    "mit-name": r".*(released|licensed|distributed|available|covered) under (the )?(terms of )?(the )?mit licen[sc]e",
    "mit-permission": r"permission is hereby granted free of charge to any person obtaining a copy of this software.*",
    "mit-condition": r"the above copyright notice and this permission notice.* shall be included in all copies.*",
    "mit-no-warranty": r"the software is provided as is without warranty of any kind.*",
    "mit-no-liability": r"in no event shall the authors or copyright holders be liable.*",
    "isc-permission": r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted.*",
    "isc-no-warranty": r"the software is provided as is and the author disclaims all warranties.*",
    "bsd-name": r".*under (the )?(terms of )?(the )?(new |simplified |modified |[234] clause )?bsd (style )?licen[sc]e",
    "bsd-permission": r"redistribution and use in source and binary forms with or without modification are permitted.*",
    "bsd-source": r"(1 )?redistributions of source code must retain.*",
    "bsd-binary": r"(2 )?redistributions in binary form must reproduce.*",
    "bsd-advertising": r"(3 )?all advertising materials mentioning features or use of this software must display.*",
    "bsd-endorsement": r"([34] )?neither the names? of .* may be used to endorse or promote products.*",
    "bsd-no-warranty": r"this software is provided by .*as is and any express or implied warranties.*are disclaimed",
    "bsd-no-liability": r"in no event shall .* be liable for any direct indirect incidental.*",
    "apache-2-name": r".*licensed under the apache license version 2( 0)?( the license)?",
    "apache-2-compliance": r"you may not use this file except in compliance with the license",
    "apache-2-copy": r"you may obtain a copy of the license at.*",
    "apache-2-as-is": r"unless required by applicable law or agreed to in writing software distributed under the license.*",
    "gpl-2-name": r".*licensed under the (terms of the )?gnu general public license version 2( 0)?( only)?",
    "gpl-3-name": r".*licensed under the (terms of the )?gnu general public license version 3( 0)?( only)?",
    "gpl-or-later": r".*redistribute it and or modify it under the terms of the gnu general public license as published.*either version 2.*",
    "gpl-3-or-later": r".*redistribute it and or modify it under the terms of the gnu general public license as published.*either version 3.*",
    "lgpl-2.1-name": r".*under the (terms of the )?gnu lesser general public license( as published by .*)? (version )?2 1.*",
    "lgpl-3-name": r".*under the (terms of the )?gnu lesser general public license( as published by .*)? (version )?3.*",
    "lgpl-name": r".*under the (terms of the )?gnu (lesser|library) general public license.*",
    "agpl-3-name": r".*under the (terms of the )?gnu affero general public license( as published by .*)? (version )?3.*",
    "agpl-name": r".*under the (terms of the )?gnu affero general public license.*",
    "gpl-no-warranty": r"(this program|it) is distributed in the hope that it will be useful but without any warranty.*",
    "gpl-copy": r"you should have received a copy of the gnu (lesser |library |affero )?general public license.*",
    "mpl-2-name": r".*subject to the terms of the mozilla public license v(ersion)? 2 0",
    "mpl-copy": r"if a copy of the mpl was not distributed with this file.*",
    "epl-2-name": r".*under the terms of the eclipse public license (v )?2 0.*",
    "cc0-name": r".*(licensed under|dedicated .*) (creative commons zero|cc0)( 1 0)?.*",
    "cc-by-4-name": r".*licensed under (the )?(creative commons attribution|cc by) 4 0( international)?( license)?",
    "cc-by-sa-4-name": r".*licensed under (the )?(creative commons attribution sharealike|cc by sa) 4 0( international)?( license)?",
    "cc-by-name": r".*licensed under (the )?(creative commons attribution|cc by)( (1|2|3|4)( 0)?)?( international)?( license)?",
    "cc-by-sa-name": r".*licensed under (the )?(creative commons attribution sharealike|cc by sa)( (1|2|3|4)( 0)?)?( international)?( license)?",
    "cc-by-nc-name": r".*licensed under (the )?(creative commons attribution noncommercial|cc by nc)( (1|2|3|4)( 0)?)?( international)?( license)?",
    "cc-by-nd-name": r".*licensed under (the )?(creative commons attribution noderivatives|cc by nd)( (1|2|3|4)( 0)?)?( international)?( license)?",
    "unlicense-domain": r"this is free and unencumbered software released into the public domain",
    "zlib-no-warranty": r"this software is provided as is without any express or implied warranty",
    "zlib-permission": r"permission is granted to anyone to use this software for any purpose.*",
    "boost-name": r".*under the boost software license version 1 0.*",
    "gpl-2-head": r"gnu general public license version 2 june 1991.*",
    "gpl-3-head": r"gnu general public license version 3 29 june 2007.*",
    "lgpl-2.1-head": r"gnu lesser general public license version 2 1 february 1999.*",
    "lgpl-3-head": r"gnu lesser general public license version 3 29 june 2007.*",
    "agpl-3-head": r"gnu affero general public license version 3 19 november 2007.*",
    "mpl-2-head": r"mozilla public license version 2 0",
    "apache-2-head": r"apache license version 2 0 january 2004.*",
}

# Licence and the run of sentences it takes, in the order they are tried.
RULES = (
    ("MIT", ("mit-permission", "mit-condition", "mit-no-warranty", "mit-no-liability")),
    ("MIT", ("mit-permission", "mit-condition", "mit-no-warranty")),
    ("MIT-0", ("mit-permission", "mit-no-warranty", "mit-no-liability")),
    ("ISC", ("isc-permission", "isc-no-warranty")),
    ("BSD-4-Clause", ("bsd-permission", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorsement", "bsd-no-warranty")),
    ("BSD-3-Clause", ("bsd-permission", "bsd-source", "bsd-binary", "bsd-endorsement", "bsd-no-warranty")),
    ("BSD-2-Clause", ("bsd-permission", "bsd-source", "bsd-binary", "bsd-no-warranty")),
    ("Apache-2.0", ("apache-2-name", "apache-2-compliance", "apache-2-copy", "apache-2-as-is")),
    ("Apache-2.0", ("apache-2-name",)),
    ("GPL-3.0-or-later", ("gpl-3-or-later", "gpl-no-warranty", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl-3-or-later",)),
    ("GPL-2.0-or-later", ("gpl-or-later", "gpl-no-warranty", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl-or-later",)),
    ("GPL-3.0-only", ("gpl-3-name",)),
    ("GPL-2.0-only", ("gpl-2-name",)),
    ("LGPL-2.1", ("lgpl-2.1-name",)),
    ("LGPL-3.0", ("lgpl-3-name",)),
    ("LGPL", ("lgpl-name",)),
    ("AGPL-3.0", ("agpl-3-name",)),
    ("AGPL", ("agpl-name",)),
    ("MPL-2.0", ("mpl-2-name", "mpl-copy")),
    ("MPL-2.0", ("mpl-2-name",)),
    ("EPL-2.0", ("epl-2-name",)),
    ("CC0-1.0", ("cc0-name",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-name",)),
    ("CC-BY-SA", ("cc-by-sa-name",)),
    ("CC-BY-NC", ("cc-by-nc-name",)),
    ("CC-BY-ND", ("cc-by-nd-name",)),
    ("CC-BY-4.0", ("cc-by-4-name",)),
    ("CC-BY", ("cc-by-name",)),
    ("Unlicense", ("unlicense-domain",)),
    ("Zlib", ("zlib-no-warranty", "zlib-permission")),
    ("BSL-1.0", ("boost-name",)),
    ("MIT", ("mit-name",)),
    ("BSD", ("bsd-name",)),
    ("GPL-2.0-only", ("gpl-2-head",)),
    ("GPL-3.0-only", ("gpl-3-head",)),
    ("LGPL-2.1", ("lgpl-2.1-head",)),
    ("LGPL-3.0", ("lgpl-3-head",)),
    ("AGPL-3.0", ("agpl-3-head",)),
    ("MPL-2.0", ("mpl-2-head",)),
    ("Apache-2.0", ("apache-2-head",)),
)

# The identifier of a tag, and the licence expression it states.
TAG = "spdx-tag"
STATED = (r"(?i)spdx-license-identifier[ \t]*[:=]?[ \t]*\(?((?:[a-z0-9][a-z0-9.+-]*)?[a-z0-9+]"
          r"(?:\)?[ \t]+(?:or|and|with)[ \t]+\(?(?:[a-z0-9][a-z0-9.+-]*)?[a-z0-9+])*)")

# Replacements that cut a lower-case text, in this order.  "\f" ends a sentence,
# "\n" is a line break inside one.
SENTENCE_CUTS = (
    (r"\r\n?|\f", "\n"),
    (r"(?m)^[ \t]*(?:(?:/\*+|\*+/?|//+!?|#+|;+|--+|<!--+|%+|(?:dnl|rem)\b)[ \t]*)*", ""),    # comment marks
    (r"(?:\*+/|--+>)[ \t]*(?=\n|$)", ""),
    (r"\n{2,}|(?<=:)[ \t]*\n", "\f"),
    (r"(?<!version)\n(?=[0-9]{1,2}[.)][ \t]|\(?[0-9a-z]\)[ \t]|[-+•][ \t])", "\f"),         # list items
    (r"\n(?=\(c\) |©|copyright (?:\(c\)|©|[0-9])|all rights reserved|spdx-license-identifier|(?:licensed|released) under )", "\f"),
    (r"(?<!\bv)([.?!][\"')\]]*)(?<!\b(?:inc|ltd|corp|co)\.(?=\s{1,9}(?:nor|or|and|may|be|[\"'`“]{0,2}as is)\b))\s+", "$1\f"),
    (r"((?:^|\f)(?:\(c\)|©|copyright\b|spdx-license-identifier)[^\n\f]*)\n", "$1\f"),       # one line each
)
CLAUSE_END = r"(?<=[;:])[ \t\n]+"
ORDER = list(dict.fromkeys(name for name, _ in RULES))


def _any_word(text):
    test = F.lit(False)
    for k in WORDS:
        test = test | F.contains(text, F.lit(k))
    return test


def _identify(sentence):
    """The identifier of a normalised sentence, null if it is not known."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(SENTENCES.items()):
        found = F.when(sentence.rlike(f"^(?:{pattern})$"), name).otherwise(found)
    return found


def _known(pieces, smaller=None):
    """The identifiers of the known pieces in order; a piece that is not known gives those of its smaller ones."""
    def one(s):
        return F.struct(s.alias("s"), _identify(F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))).alias("id"))

    found = F.transform(F.filter(pieces, _any_word), one)
    if smaller is None:
        return F.transform(F.filter(found, lambda r: r["id"].isNotNull()), lambda r: r["id"])
    return F.flatten(F.transform(found, lambda r: F.when(r["id"].isNotNull(), F.array(r["id"])).otherwise(smaller(r["s"]))))


def _identifiers(text):
    """The identifiers of a lower-case text: sentence by sentence, else clause by clause, else line by line."""
    for pattern, by in SENTENCE_CUTS:
        text = F.regexp_replace(text, pattern, by)
    return _known(F.split(text, "\f"), lambda s: _known(F.split(s, CLAUSE_END), lambda c: _known(F.split(c, "\n"))))


def _wrap(ids) -> str:
    return "".join(f"<{i}>" for i in ids)


def scan(docs: DataFrame, out: str = "license_scan") -> DataFrame:
    """`docs` plus the struct column `out`: sequence (known sentences in order),
    licenses (each once, in the order of the rules) and unmatched."""
    low = F.coalesce(F.lower("text"), F.lit(""))
    none = F.array().cast("array<string>")
    ids = F.when(_any_word(F.col("_low")), _identifiers(F.col("_low"))).otherwise(none)
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_wrap(run)).alias("run")) for name, run in RULES])
    start = F.struct(F.array_join(F.transform("_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("rest"),
                     none.alias("found"))
    taken = F.aggregate(rules, start, lambda acc, r: F.when(F.contains(acc["rest"], r["run"]), F.struct(
        F.replace(acc["rest"], r["run"], F.lit("")).alias("rest"),
        F.array_union(acc["found"], F.array(r["name"])).alias("found"))).otherwise(acc))
    empty = F.struct(F.lit("").alias("rest"), none.alias("found"))
    stated = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(STATED)))
    stated = F.when(F.array_contains("_ids", TAG), stated).otherwise(none)
    d = packed(docs, "text").withColumn("_low", low).withColumn("_ids", ids)
    d = d.withColumn("_taken", F.when(F.size("_ids") > 0, taken).otherwise(empty))
    rest = F.filter(F.split(F.regexp_replace(F.col("_taken.rest"), "[<>]+", ";"), ";"), lambda i: i != "")
    d = d.withColumn("_stated", stated).withColumn("_rest", rest)
    rest = F.when(F.size("_stated") > 0, F.array_remove("_rest", TAG)).otherwise(F.col("_rest"))
    result = F.struct(F.col("_ids").alias("sequence"), F.array_union("_taken.found", "_stated").alias("licenses"), rest.alias("unmatched"))
    return d.select(*unpacked(docs.columns, out), result.alias(out))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: licences, the sequence they came from, what no rule took."""
    d = scan(docs.select("doc_id", "text"), out="s")
    return d.select("doc_id", F.size("s.sequence").cast("long").alias("n_sentences"), F.array_join("s.sequence", ",").alias("sequence"),
                    F.array_join("s.licenses", ",").alias("licenses"), F.array_join("s.unmatched", ",").alias("unmatched"))


def oracle() -> str:
    """The same rows in DuckDB SQL, whose patterns know no context: lines are put
    together one by one, places that must not be cut are marked, sentences, clauses
    and lines are rows, rules are nested steps.  No prefilter."""
    marks = r"(?m)^[ \t]*((/\*+|\*+/?|//+!?|#+|;+|--+|<!--+|%+|(dnl|rem)\b)[ \t]*)*"
    item = r"^([0-9]{1,2}[.)][ \t]|\(?[0-9a-z]\)[ \t]|[-+•][ \t])"
    opens = r"^(\(c\) |©|copyright (\(c\)|©|[0-9])|all rights reserved|spdx-license-identifier|(licensed|released) under )"
    keep = r"\b((inc|ltd|corp|co)\.)([ \t\n\x0B]{1,9}((nor|or|and|may|be)\b|[\"''`“]{0,2}as is\b))"
    stop = r"([.?!][\"'')\]]*)[ \t\n\x0B]+"
    alone = r"((^|\f)(\(c\)|©|copyright\b|spdx-license-identifier)[^\n\f]*)\n"
    tag = STATED.replace("(?i)", "")
    case = "CASE " + " ".join(f"WHEN regexp_full_match(s, '{p}') THEN '{i}'" for i, p in SENTENCES.items()) + " END"
    say = lambda c: f"trim(regexp_replace({c}, '[^a-z0-9]+', ' ', 'g'))"
    step = "SELECT k, n, seq, tagged AS rest, '' AS found FROM seqs"
    for name, run in RULES:
        w = _wrap(run)
        step = (f"SELECT k, n, seq, replace(rest, '{w}', '') AS rest, CASE WHEN contains(rest, '{w}') AND NOT contains("
                f"found || ',', ',{name},') THEN found || ',{name}' ELSE found END AS found FROM ({step})")

    def known(name: str, source: str, place: str, parts: str) -> str:
        """Pieces of one size as rows, with their identifiers; {name}_no holds the unknown ones."""
        return f"""
{name} AS MATERIALIZED (SELECT *, {case} AS id FROM (SELECT *, {say("piece")} AS s FROM (
  SELECT k, {place}, unnest({parts}) AS piece, generate_subscripts({parts}, 1) AS {name}_at FROM {source})))"""
    split = "string_split({}, chr(12))"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
a AS (SELECT k, regexp_replace(replace(replace(replace(lower(text), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(12), chr(10)), '{marks}', '', 'g') AS t FROM docs),
b AS (SELECT k, regexp_replace(regexp_replace(t, '(\*+/|--+>)[ \t]*(\n|$)', '\2', 'g'),
                               '(:)(\n{{2,}}|[ \t]*\n)|\n{{2,}}', '\1' || chr(12), 'g') AS t FROM a),
c AS (SELECT k, string_split(t, chr(10)) AS l FROM b),
d AS (SELECT k, array_to_string(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i = 1 THEN ''
        WHEN regexp_matches(l[i], '{opens}') OR (regexp_matches(l[i], '{item}') AND NOT ends_with(l[i - 1], 'version')) THEN chr(12)
        ELSE chr(10) END || l[i]), '') AS t FROM c),
e AS (SELECT k, regexp_replace(regexp_replace(t, '\b(v[.?!][\"'')\]]*)([ \t\n\x0B])', '\1' || chr(2) || '\2', 'g'), '{keep}', '\1' || chr(2) || '\3', 'g') AS t FROM d),
f AS (SELECT k, regexp_replace(replace(regexp_replace(t, '{stop}', '\1' || chr(12), 'g'), chr(2), ''), '{alone}', '\1' || chr(12), 'g') AS t FROM e),
{known("st", "f", "0 AS x", split.format("t"))},
{known("cl", "(SELECT k, st_at, piece AS t FROM st WHERE id IS NULL)", "st_at",
       split.format(r"regexp_replace(t, '([;:])[ \t\n]+', '\1' || chr(12), 'g')"))},
{known("li", "(SELECT k, st_at, cl_at, piece AS t FROM cl WHERE id IS NULL)", "st_at, cl_at", "string_split(t, chr(10))")},
ids AS (SELECT k, st_at AS x, 0 AS y, 0 AS z, id FROM st UNION ALL SELECT k, st_at, cl_at, 0, id FROM cl
        UNION ALL SELECT k, st_at, cl_at, li_at, id FROM li),
seqs AS (SELECT k, count(*) AS n, string_agg(id, ',' ORDER BY x, y, z) AS seq, string_agg('<' || id || '>', '' ORDER BY x, y, z) AS tagged
         FROM ids WHERE id IS NOT NULL GROUP BY k),
done AS ({step}),
inorder AS (SELECT k, string_agg(tag, ',' ORDER BY i) AS stated FROM (
              SELECT k, tag, min(i) AS i FROM (SELECT k, unnest(regexp_extract_all(text, '{tag}', 1, 'i')) AS tag,
                generate_subscripts(regexp_extract_all(text, '{tag}', 1, 'i'), 1) AS i FROM docs) GROUP BY k, tag) GROUP BY k),
fin AS (
SELECT doc_id, n, seq, string_split(coalesce(substr(found, 2), ''), ',') AS lic, rest,
       CASE WHEN contains(',' || seq || ',', ',{TAG},') THEN string_split(stated, ',') END AS stated
FROM docs LEFT JOIN done USING (k) LEFT JOIN inorder USING (k))
SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(seq, '') AS sequence,
       array_to_string(list_filter(list_concat(lic, list_filter(coalesce(stated, []), lambda g: NOT list_contains(lic, g))), lambda g: g <> ''), ',') AS licenses,
       coalesce(trim(regexp_replace(CASE WHEN stated IS NOT NULL THEN replace(rest, '<{TAG}>', '') ELSE rest END, '[<>]+', ',', 'g'), ','), '') AS unmatched
FROM fin"""
