"""License scans by sentence rules.

Comment marks at the ends of lines go, lines are joined up to the next blank one, and texts are cut into sentences after
``.``, ``!`` or ``?`` before white space, so that sentences wrapped over lines are seen whole. A normalised sentence
(lower case, white space single) is mapped to the identifiers of the known licence sentences that it holds, in order
of place; a general one (``GPL``) gives way to a more exact one (``GPL2``) of the same sentence. The identifiers of a
text, in order, are matched against ordered licence rules: a rule is a run of identifiers; where it occurs, its
licence is found and the run is used up, so that a more exact rule must stand before a more general one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TAG = r"spdx-license-identifier: *[(]?"
#: identifier, expression over a normalised sentence. The expressions mean the same in Java's and in RE2's dialect.
SENTENCES = (
    ("AGPL3", r"gnu affero general public licen[cs]e,? (v|version )3|" + _TAG + r"agpl-3[.]0"),
    ("LGPL21", r"gnu lesser general public licen[cs]e,? (v|version )2[.]1|" + _TAG + r"lgpl-2[.]1"),
    ("LGPL3", r"gnu lesser general public licen[cs]e,? (v|version )3|" + _TAG + r"lgpl-3[.]0"),
    ("LGPL", r"gnu (lesser|library) general public licen[cs]e"),
    ("GPL2", r"gnu general public licen[cs]e(,? (v|version )2| as published by the free software foundation[;,] (either )?version 2)|" + _TAG + r"gpl-2[.]0"),
    ("GPL3", r"gnu general public licen[cs]e(,? (v|version )3| as published by the free software foundation[;,] (either )?version 3)|" + _TAG + r"gpl-3[.]0"),
    ("GPL", r"gnu general public licen[cs]e|[( ]gpl[) ]"),
    ("LaterVersion", r"or .{0,20}any later version|" + _TAG + r"[al]?gpl-[0-9.]+([+]|-or-later)"),
    ("Apache2", r"apache licen[cs]e,? (v|version )?2([.]0)?|apache[.]org/licenses/license-2[.]0|" + _TAG + r"apache-2[.]0"),
    ("Apache", r"apache licen[cs]e"),
    ("MITgrant", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MITnotice", r"above copyright notice and this permission notice shall be included"),
    ("MIT", r"(^|[^a-z])mit licen[cs]e|licensed under (the )?mit([^a-z]|$)|" + _TAG + r"mit([^a-z-]|$)"),
    ("BSDredist", r"redistribution and use in source and binary forms, with or without modification"),
    ("BSDsource", r"redistributions of source code must retain the above copyright notice"),
    ("BSDbinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BSDendorse", r"neither the name of .{0,80} may be used to endorse or promote"),
    ("BSD3", r"(bsd 3-clause|3-clause bsd|new bsd|modified bsd) licen[cs]e|" + _TAG + r"bsd-3-clause"),
    ("BSD2", r"(bsd 2-clause|2-clause bsd|simplified bsd) licen[cs]e|" + _TAG + r"bsd-2-clause"),
    ("BSD", r"bsd licen[cs]e"),
    ("MPL2", r"mozilla public licen[cs]e,? (v|version )?[.]? ?2[.]0|" + _TAG + r"mpl-2[.]0"),
    ("EPL", r"eclipse public licen[cs]e|" + _TAG + r"epl-"),
    ("ISC", r"(^|[^a-z])isc licen[cs]e|permission to use, copy, modify, and.or distribute this software for any purpose with or without fee|" + _TAG + r"isc([^a-z-]|$)"),
    ("CCBYNCSA", r"cc[ -]by[ -]nc[ -]sa|attribution-noncommercial-sharealike"),
    ("CCBYNCND", r"cc[ -]by[ -]nc[ -]nd|attribution-noncommercial-noderiv"),
    ("CCBYNC", r"cc[ -]by[ -]nc|attribution-noncommercial"),
    ("CCBYSA", r"cc[ -]by[ -]sa|attribution-sharealike"),
    ("CCBYND", r"cc[ -]by[ -]nd|attribution-noderiv"),
    ("CCBY", r"cc[ -]by|creative commons attribution"),
    ("CC0", r"(^|[^a-z])cc0|creative commons zero"),
    ("PublicDomain", r"(released|dedicated|placed) (in|into|to) the public domain|this is free and unencumbered software released into the public domain"),
    ("Reserved", r"all rights reserved"),
    ("Warranty", r"without warranty of any kind|provided .{0,4}as is"),
    ("SPDX", r"spdx-license-identifier: *[a-z0-9(]"),
    ("Unknown", r"licen[cs]ed under|licen[cs]e agreement|under the terms of .{0,60}licen[cs]e"),
)  # fmt: skip

#: identifier -> what it gives way to in the same sentence; ``Unknown`` and ``SPDX`` give way to any other.
EXACT = {
    "LGPL": ("LGPL21", "LGPL3"), "GPL": ("GPL2", "GPL3"), "Apache": ("Apache2",), "BSD": ("BSD2", "BSD3"), "CCBYNC": ("CCBYNCSA", "CCBYNCND"),
    "CCBY": ("CCBYNCSA", "CCBYNCND", "CCBYNC", "CCBYSA", "CCBYND"),
    "SPDX": tuple(n for n, _ in SENTENCES if n not in ("SPDX", "Unknown")), "Unknown": tuple(n for n, _ in SENTENCES if n != "Unknown"),
}  # fmt: skip

#: licence, run of identifiers; in this order.
RULES = (
    ("AGPL-3.0-or-later", ("AGPL3", "LaterVersion")), ("AGPL-3.0", ("AGPL3",)),
    ("GPL-2.0-or-later", ("GPL2", "LaterVersion")), ("GPL-3.0-or-later", ("GPL3", "LaterVersion")), ("GPL-or-later", ("GPL", "LaterVersion")),
    ("LGPL-2.1", ("LGPL21",)), ("LGPL-3.0", ("LGPL3",)), ("LGPL", ("LGPL",)), ("GPL-2.0", ("GPL2",)), ("GPL-3.0", ("GPL3",)), ("GPL", ("GPL",)),
    ("Apache-2.0", ("Apache2",)), ("Apache", ("Apache",)),
    ("MIT", ("MIT", "MITgrant", "MITnotice", "Warranty")), ("MIT", ("MITgrant", "MITnotice", "Warranty")), ("MIT", ("MITgrant", "MITnotice")), ("MIT", ("MITgrant",)), ("MIT", ("MIT",)),
    ("BSD-3-Clause", ("BSDredist", "BSDsource", "BSDbinary", "BSDendorse")), ("BSD-2-Clause", ("BSDredist", "BSDsource", "BSDbinary")), ("BSD-2-Clause", ("BSDredist",)),
    ("BSD-3-Clause", ("BSD3",)), ("BSD-2-Clause", ("BSD2",)), ("BSD", ("BSD",)),
    ("MPL-2.0", ("MPL2",)), ("EPL", ("EPL",)), ("ISC", ("ISC",)),
    ("CC-BY-NC-SA", ("CCBYNCSA",)), ("CC-BY-NC-ND", ("CCBYNCND",)), ("CC-BY-NC", ("CCBYNC",)), ("CC-BY-SA", ("CCBYSA",)), ("CC-BY-ND", ("CCBYND",)), ("CC-BY", ("CCBY",)), ("CC0-1.0", ("CC0",)),
    ("public-domain", ("PublicDomain",)), ("SPDX", ("SPDX",)), ("proprietary", ("Reserved",)), ("unknown", ("Unknown",)),
)  # fmt: skip

#: Every known sentence holds one of these. None has an inner space, which a text before normalising may write otherwise.
HINTS = ("licen", "copyright", "spdx", "gpl", "permission", "redistribution", "neither", "cc-", "cc0", "cc ", "attribution", "creative", "domain", "reserved", "warranty", "provided", "later")
#: In a raw text white space may be other than a space.
TEXT_HINTS = (*HINTS, "cc\t", "cc\r", "cc\n")
_END = "\x1e"


def sentences(text: Column) -> Column:
    """Normalised sentences of a lower-cased text."""
    t = F.regexp_replace(text, r"(^|\n)[ \t\r*#/;%!<>-]+", "$1")
    t = F.regexp_replace(t, r"[ \t\r*#/]+(\n|$)", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"\n\n+", _END), r"[ \t\r\n]+", " ")
    return F.filter(F.split(F.regexp_replace(t, "([.!?]) ", f"$1{_END}"), _END, -1), lambda s: F.exists(F.array(*map(F.lit, HINTS)), lambda h: F.contains(s, h)))


def identifiers(sentence: Column) -> Column:
    """The identifiers of a sentence, by place, then in the order of ``SENTENCES``."""
    at = F.array(*(F.struct(F.regexp_instr(sentence, F.lit(rule)).alias("at"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, rule) in enumerate(SENTENCES)))
    found = F.filter(at, lambda x: x["at"] > 0)
    less = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in EXACT.items() for x in kv))
    # Bound once, for each identifier looks at the others.
    keep = lambda all_: F.filter(all_, lambda x: ~F.exists(all_, lambda y: F.coalesce(F.array_contains(F.try_element_at(less, x["name"]), y["name"]), F.lit(False))))  # noqa: E731
    return F.transform(F.array_sort(F.element_at(F.transform(F.array(found), keep), 1)), lambda x: F.concat(F.lit("<"), x["name"], F.lit(">")))


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, ``sentence_ids`` (``<A><B>``...), ``licenses`` (joined by ``,``, in the rules' order, each
    once) and ``n_sentences`` (of identifiers) for every row, rows without a licence included.

    Null text is empty. Rows are scanned one by one in their own task, whole, so repeated rows are alike and
    skew does not matter. Null ids are kept. Only the id and the text are read, so names cannot clash; an empty table
    stays empty.
    """
    t = df.select(F.col(f"`{id_col}`").alias("__id"), F.lower(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("__t"))
    hint = F.lit(False)
    for h in TEXT_HINTS:
        hint = hint | F.contains(F.col("__t"), F.lit(h))
    t = t.select("__id", F.when(hint, F.col("__t")).otherwise("").alias("__t"))
    t = t.select("__id", F.flatten(F.transform(sentences(F.col("__t")), identifiers)).alias("__i"))
    t = t.select("__id", F.size("__i").cast("long").alias("n_sentences"), F.array_join("__i", "").alias("sentence_ids"))
    t = t.withColumn("__left", F.col("sentence_ids")).withColumn("__found", F.lit(""))
    for licence, run in RULES:
        mark = "".join(f"<{x}>" for x in run)
        new = F.contains(F.col("__left"), F.lit(mark)) & ~F.contains(F.concat(F.lit(","), F.col("__found")), F.lit(f",{licence},"))
        t = t.select("__id", "n_sentences", "sentence_ids", F.when(new, F.concat("__found", F.lit(licence + ","))).otherwise(F.col("__found")).alias("__found"), F.replace("__left", F.lit(mark), F.lit("")).alias("__left"))
    return t.select(F.col("__id").alias(id_col), "sentence_ids", F.expr("trim(trailing ',' from __found)").alias("licenses"), "n_sentences")


def oracle(table: str = "documents") -> str:
    """The same scan as DuckDB SQL. Where a sentence is found is where its match first occurs."""
    q = lambda s: s.replace("'", "''")  # noqa: E731
    rules = ", ".join(f"({k}, '{n}', '{q(r)}')" for k, (n, r) in enumerate(SENTENCES))
    exact = ", ".join(f"('{n}', '{x}')" for n, xs in EXACT.items() for x in xs)
    hints = " or ".join(f"contains({{0}}, '{h}')" for h in HINTS)
    # Line by line: marks go at both ends, and what is left of a paragraph is joined.
    sql = rf"""with rules(k, name, rule) as (values {rules}), exact(name, other) as (values {exact}),
    a as (select row_number() over () r, doc_id, lower(coalesce(text, '')) t from {table}),
    b as (select r, regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda s: regexp_replace(regexp_replace(s, '^[ 	*#/;%!<>-]+', ''), '[ 	*#/]+$', '')), chr(10)), '

+', chr(30), 'g') t from a),
    c as (select r, string_split(regexp_replace(regexp_replace(t, '[ 	
]+', ' ', 'g'), '([.!?]) ', '' || chr(30), 'g'), chr(30)) l from b),
    d as (select r, unnest(l) s, generate_subscripts(l, 1) i from c), e as (select * from d where {hints.format("s")}),
    f as (select r, i, k, name, strpos(s, regexp_extract(s, rule)) p from e, rules where regexp_matches(s, rule)),
    g as (select f.* from f where not exists (select 1 from f o join exact x on o.name = x.other where x.name = f.name and o.r = f.r and o.i = f.i)),
    h as (select r, count(*) n, string_agg('<' || name || '>', '' order by i, p, k) ids from g group by r),
    r0 as (select doc_id, coalesce(n, 0) n_sentences, coalesce(ids, '') sentence_ids, coalesce(ids, '') l, '' f from a left join h using (r))"""
    for k, (licence, run) in enumerate(RULES):
        mark = "".join(f"<{x}>" for x in run)
        sql += f", r{k + 1} as (select doc_id, n_sentences, sentence_ids, replace(l, '{mark}', '') l, case when contains(l, '{mark}') and not contains(',' || f, ',{licence},') then f || '{licence},' else f end f from r{k})"
    return sql + f" select doc_id, sentence_ids, rtrim(f, ',') licenses, n_sentences from r{len(RULES)}"
