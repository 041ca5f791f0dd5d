"""Licence recognition: known sentences become identifiers, ordered rules match identifier sequences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.skew import fits_broadcast

SALTS = 32
GAP = 20  # words that ``*`` in a known sentence stands for, at most
MAX_BEGINNINGS = 1_000  # of known sentences; with more, every part of a text is looked up

# Licence sentences in normalised form (lower case, letters, digits and single blanks) with their identifiers.
SENTENCES = [
    ("agpl3_notice", "licensed under the gnu affero general public license version 3"),
    ("all_rights", "all rights reserved"),
    ("apache2_notice", "licensed under the apache license version 2 0"),
    ("apache2_notice", "licensed under the apache license version 2 0 the license"),
    ("apache2_use", "you may not use this file except in compliance with the license"),
    ("apache2_copy", "you may obtain a copy of the license at"),
    ("bsd_permit", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd_endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc0_notice", "licensed under cc0 1 0"),
    ("cc_by_notice", "licensed under cc by 4 0"),
    ("cc_by_nc_notice", "licensed under cc by nc 4 0"),
    ("cc_by_sa_notice", "licensed under cc by sa 4 0"),
    ("gpl2_notice", "this work is licensed under the gnu general public license version 2"),
    ("gpl3_notice", "this work is licensed under the gnu general public license version 3"),
    ("gpl_redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl_warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("mit_notice", "released under the mit license"),
    ("mit_permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit_keep", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl2_notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]

# Rules in order of precedence, each a licence and the sentence identifiers that must follow each other.
RULES = [
    ("Apache-2.0", ["apache2_notice", "apache2_use", "apache2_copy"]),
    ("MIT", ["mit_permission", "mit_keep"]),
    ("GPL-3.0-or-later", ["gpl_redistribute", "gpl_warranty"]),
    ("BSD-3-Clause", ["bsd_permit", "bsd_endorse"]),
    ("AGPL-3.0", ["agpl3_notice"]),
    ("Apache-2.0", ["apache2_notice"]),
    ("BSD", ["bsd_permit"]),
    ("CC0-1.0", ["cc0_notice"]),
    ("CC-BY-4.0", ["cc_by_notice"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_notice"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_notice"]),
    ("GPL-2.0", ["gpl2_notice"]),
    ("GPL-3.0", ["gpl3_notice"]),
    ("GPL-3.0-or-later", ["gpl_redistribute"]),
    ("MIT", ["mit_notice"]),
    ("MIT", ["mit_permission"]),
    ("MPL-2.0", ["mpl2_notice"]),
    ("proprietary", ["all_rights"]),
]


def _more() -> tuple[list[tuple[str, str]], list[tuple[str, list[str]]]]:
    """Sentences and rules of further texts and of the usual variants of notices."""
    said, rules = [], []

    def one(name: str, *sentences: str) -> None:
        key = "_" + name
        said.extend((key, x) for x in sentences)
        rules.append((name, [key]))

    conditions = "the above copyright notice this list of conditions and the following disclaimer"
    use = "may be used to endorse or promote products derived from this software without specific prior written permission"
    not_use = use.replace("may be", "may not be")
    said += [
        ("bsd_source", f"redistributions of source code must retain {conditions}"),
        ("bsd_binary", f"redistributions in binary form must reproduce {conditions} in the documentation and or other materials provided with the distribution"),
        ("bsd_advert", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
        ("bsd_thanks", "this product includes software developed by *"),
        ("bsd_endorse", f"neither the name of * nor the names of its contributors {use}"),
        ("bsd_endorse", f"neither the name of * nor the names of * contributors {use}"),
        ("bsd_endorse", f"neither the names of * nor the names of * contributors {use}"),
        ("bsd_endorse", f"the name of * {not_use}"), ("bsd_endorse", f"the names of * {not_use}"),
    ]
    clauses = ["bsd_permit", "bsd_source", "bsd_binary"]
    for name, ids in [("BSD-4-Clause", [*clauses, "bsd_advert", "bsd_thanks", "bsd_endorse"]), ("BSD-3-Clause", [*clauses, "bsd_endorse"]),
                      ("BSD-2-Clause", clauses), ("BSD-3-Clause", ["bsd_permit", "bsd_endorse"]), ("BSD", ["bsd_permit"])]:
        rules += [(name, ["all_rights", *ids]), (name, ids)]  # the usual line above the text reserves nothing beyond it

    families = [("GPL", "general", "1 2 3"), ("LGPL", "lesser general", "2.1 3"), ("LGPL", "library general", "2"), ("AGPL", "affero general", "3")]
    things = ["program", "library", "software", "file"]
    said += [("gpl_warranty", f"this {x} is distributed in the hope that it will be useful but without any warranty without even the implied "
              "warranty of merchantability or fitness for a particular purpose") for x in things]
    grants = [f"{x}you {can} redistribute it and or modify it under the terms of"
              for x in ["", *[f"this {y} is free software " for y in things]] for can in ("can", "may")]
    by = "as published by the free software foundation"
    later = "or at your option any later version"
    tags = []
    for family, kind, versions in families:
        for number in versions.split():
            name = f"{family}-{number if '.' in number else number + '.0'}"
            version, licence = f"version {number.replace('.', ' ')}", f"the gnu {kind} public license"
            only = [f"{licence} {version} {by}", f"{licence} {by} {version}", f"{licence} {by} {version} of the license", f"{version} of {licence} {by}"]
            open_ = [f"{licence} {by} either {version} of the license {later}", f"{licence} {by} {version} of the license {later}",
                     f"{licence} {by} either {version} {later}", f"{licence} {by} {version} {later}", f"either {version} of {licence} {by} {later}"]
            key = {"GPL-3.0": "gpl"}.get(name, name)
            said += [(f"{key}_redistribute", f"{g} {x}") for g in grants for x in open_]
            rules += [(f"{name}-or-later", [f"{key}_redistribute", "gpl_warranty"]), (f"{name}-or-later", [f"{key}_redistribute"])]
            one(name, *[f"{g} {x}" for g in grants for x in only])
            tags += [(name, name), (name, f"{name}-only"), (f"{name}-or-later", f"{name}-or-later")]
            said += [("_" + name, f"{x} {y}") for x in NOTICES for y in (f"{licence} {version}", f"{licence} {version} 0", f"{licence} v{number.replace('.', ' ')}",
                     f"{licence} {family.lower()} {version}", f"the {family.lower()} v{number.replace('.', ' ')}", f"{name.lower().replace('-', ' v').replace('.', ' ')}")]
    said += [("_GPL-2.0", "gnu general public license version 2 june 1991"), ("_GPL-3.0", "gnu general public license version 3 29 june 2007"),
             ("_LGPL-2.1", "gnu lesser general public license version 2 1 february 1999"), ("_LGPL-3.0", "gnu lesser general public license version 3 29 june 2007"),
             ("_LGPL-2.0", "gnu library general public license version 2 june 1991"), ("_AGPL-3.0", "gnu affero general public license version 3 19 november 2007")]

    def named(name: str, *names: str, own: tuple[str, ...] = ()) -> None:
        one(name, *own, *[f"{x} {y}" for x in NOTICES for y in names])
        tags.append((name, name))

    named("MIT", "the mit license", "mit license", "the mit license mit", "an mit license", "mit", own=("mit license", "the mit license mit"))
    named("Apache-2.0", "the apache license version 2 0", "apache license version 2 0", "apache license 2 0", "the apache license 2 0", "the apache 2 0 license", "apache 2 0",
          own=("apache license version 2 0 january 2004",))
    named("BSD-2-Clause", "the bsd 2 clause license", "a bsd 2 clause license", "the 2 clause bsd license", "the simplified bsd license", own=("bsd 2 clause license",))
    named("BSD-3-Clause", "the bsd 3 clause license", "a bsd 3 clause license", "the 3 clause bsd license", "the new bsd license", own=("bsd 3 clause license",))
    tags.append(("BSD-4-Clause", "BSD-4-Clause"))
    one("BSD", *[f"{x} {y}" for x in NOTICES for y in ("the bsd license", "a bsd license", "a bsd style license")],
        "use of this source code is governed by a bsd style license that can be found in the license file")
    named("ISC", "the isc license", "isc license", own=("isc license", *[
        f"permission to use copy modify and {x}distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies" for x in ("", "or ")]))
    named("Unlicense", "the unlicense", own=("this is free and unencumbered software released into the public domain",))
    named("MPL-2.0", "the mozilla public license version 2 0", "the mozilla public license v 2 0", "the mozilla public license 2 0", "mpl 2 0", "the mpl 2 0",
          own=("mozilla public license version 2 0",))
    for number, forms in [("1.0", ["v1 0", "v 1 0", "1 0", "version 1 0"]), ("2.0", ["v2 0", "v 2 0", "2 0", "version 2 0"])]:
        made = "this program and the accompanying materials are made available under the terms of the eclipse public license"
        named(f"EPL-{number}", *[f"the eclipse public license {f}" for f in forms], own=(
            *[f"{made} {f}{x}" for f in forms for x in ("", " which accompanies this distribution", " which accompanies this distribution and is available at *", " which is available at *")],
            *[f"eclipse public license {f}" for f in forms]))
    for code, words in [("BY", "attribution"), ("BY-NC", "attribution noncommercial"), ("BY-SA", "attribution sharealike"), ("BY-ND", "attribution noderivatives"),
                        ("BY-NC-SA", "attribution noncommercial sharealike"), ("BY-NC-ND", "attribution noncommercial noderivatives")]:
        forms = [f"cc {code.lower().replace('-', ' ')} 4 0"]
        for w in {words, words.replace("noncommercial", "non commercial").replace("sharealike", "share alike").replace("noderivatives", "no derivatives")}:
            forms += [f"{a}creative commons {w} 4 0{i}{b}" for a in ("a ", "the ") for i in ("", " international") for b in ("", " license")]
        named(f"CC-{code}-4.0", *forms, own=(f"{words} 4 0 international", f"creative commons {words} 4 0 international public license"))
    named("CC0-1.0", "cc0 1 0", "cc0 1 0 universal", "cc0", "a creative commons zero v1 0 universal license", own=("cc0 1 0 universal", "creative commons legal code cc0 1 0 universal"))
    for name, tag in tags:
        tag = "spdx license identifier " + " ".join(re.findall("[a-z0-9]+", tag.lower()))
        said += [("_" + name, tag), ("_" + name, f"{tag} with *")]
        rules.append((name, ["_" + name]))
    return said, rules


# What stands before the name of a licence in a notice; the rest of the sentence may point to the full text.
NOTICES = [
    f"{x}{verb} under{terms}" for terms in ("", " the terms of") for x, verb in [
        *[("", v) for v in ("licensed", "released", "distributed", "available")],
        *[(f"{what} is ", v) for what in ("this work", "this project", "this software", "this program", "this library")
          for v in ("licensed", "released", "distributed", "available")]]
]
_said, _rules = _more()
_known = {sentence for _, sentence in SENTENCES}
_said = [*_said, *[(i, f"{x} see *") for i, x in _said if x.startswith(tuple(NOTICES))]]
SENTENCES += [(i, x) for x, i in {x: i for i, x in reversed(_said) if x not in _known}.items()]
# Long rules before short ones of the same sentences; the given order holds otherwise.
RULES = RULES[:3] + [r for r in _rules if len(r[1]) > 1] + RULES[3:] + [(n, [i]) for n, i in dict.fromkeys((n, i[0]) for n, i in _rules if len(i) == 1)]

# A sentence ends at a blank line (comment marks do not fill a line) and at closing punctuation before white space, not after a short form.
_ENDS = r"[.!?](?<!\b(?:v|ver|no|inc|ltd|co|corp)\.)[ \t\n\r]+|[\n\r][^a-z0-9]*[\n\r]"
_WORDS = r"[\n\r][ \t]*(?:rem|dnl)\b"  # comment marks that are words
_PARTS = r"[;:)][ \t]+"
_MARK = "^(?:[0-9]{1,2}|[a-z]|[ivx]+)$"  # number of a list item


def _any_of(beginnings: list[str]) -> str:
    """Pattern of lower-case texts that hold one of the beginnings, whatever stands between their words."""
    first: dict[str, list[str]] = {}
    for key in beginnings:
        word, _, more = key.partition(" ")
        first.setdefault(word, []).append(f"[^a-z0-9]+{more}" if more else "")
    letters = "".join(sorted({word[0] for word in first}))
    return f"(?<![a-z0-9])(?=[{letters}])(?:" + "|".join(f"{w}(?:{'|'.join(sorted(m))})" for w, m in sorted(first.items())) + ")(?![a-z0-9])"


def parts_of(text: Column, beginnings: list[str] | None = None) -> Column:
    """Parts of the sentences of a text, in order: ``u`` number of the sentence, ``n`` number of the line or sentence, ``s`` normalised text.

    A sentence goes on over single line breaks; a part of it ends there and at ``;``, ``:`` and ``)`` before a blank. Normalising
    lower-cases A-Z and turns every run of characters outside a-z and 0-9 into one blank. No part is empty.
    With ``beginnings``, a text that holds none of them gives null, and a line of a sentence that holds none is one part ``-``, unless
    it is short when normalised, as a list number is.
    """
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lower = F.replace(F.concat(F.lit("\n"), lower), F.lit("\r\n"), F.lit("\n"))
    lower = F.regexp_replace(lower, _WORDS, "\n")
    for number in ("0", "1"):  # GPL-2.0+ and LGPL-2.1+
        lower = F.replace(lower, F.lit(f".{number}+"), F.lit(f".{number} or later"))
    has = lambda x: F.lit(True)
    if beginnings is not None:
        if not beginnings:
            return F.lit(None).cast("array<struct<u:int,n:int,s:string>>")
        has = lambda x: x.rlike(_any_of(beginnings))
        lower = F.when(has(lower), lower)
    sentences = F.transform(F.split(lower, _ENDS), lambda x, u: F.struct(u.alias("u"), x.alias("x"), has(x).alias("has")))
    lines = F.flatten(F.transform(sentences, lambda x: F.transform(
        F.split(x["x"], r"[\n\r]+|[.!?][ \t]+"), lambda line: F.struct(x["u"].alias("u"), x["has"].alias("has"), line.alias("line")))))
    lines = F.filter(lines, lambda x: x["line"].rlike("[a-z0-9]"))
    plain = lambda part: F.trim(F.regexp_replace(part, "[^a-z0-9]+", " "))
    pieces = lambda x: F.when(x["has"] | (F.length(plain(x["line"])) < 10), F.transform(F.split(x["line"], _PARTS), plain))
    parts = F.flatten(F.transform(lines, lambda x, n: F.transform(F.coalesce(pieces(x), F.array(F.lit("-"))), lambda part: F.struct(
        x["u"].alias("u"), n.alias("n"), part.alias("s")))))
    return F.filter(parts, lambda x: x["s"] != "")


def _starts(parts: Column, beginnings: list[str] | None, reach: int) -> Column:
    """Parts where a known sentence may begin: place, beginnings, the sentence from there on, its line numbers, and whether a list number is before.

    ``reach`` is the number of words of the longest known sentence, and no part has fewer words than one.
    """

    def start(x: Column, i: Column) -> Column:
        after = F.get(parts, i + 1)["s"]
        two = F.substring_index(F.when(x["s"].contains(" "), x["s"]).otherwise(F.concat_ws(" ", x["s"], after)), " ", 2)
        keys = F.array_distinct(F.array(F.substring_index(x["s"], " ", 1), two))
        if beginnings is not None:
            keys = F.filter(keys, lambda k: k.isin(beginnings))
        rest = F.filter(F.slice(parts, i + 1, reach), lambda y: y["u"] == x["u"])
        return F.when(F.size(keys) > 0, F.struct(
            i.alias("at"), keys.alias("keys"), F.array_join(F.transform(rest, lambda y: y["s"]), "\n").alias("rest"),
            F.transform(rest, lambda y: y["n"]).alias("lines"),
            F.coalesce(F.when(i > 0, F.get(parts, i - 1)["s"].rlike(_MARK)), F.lit(False)).alias("marked")))

    return F.filter(F.transform(parts, start), lambda x: x.isNotNull())


def sentence_table(spark: SparkSession, sentences=SENTENCES) -> DataFrame:
    return spark.createDataFrame(sentences, "sentence_id string, sentence string")


def scan_licenses(documents: DataFrame, sentences: DataFrame, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """Licences that the texts of ``documents`` (``doc_id, text``) state.

    ``sentences`` holds ``sentence_id, sentence`` (normalised, ``*`` for 1 to GAP words of any kind). A known sentence is met where it fills whole parts of one
    sentence (:func:`parts_of`), however its lines are wrapped; of known sentences that overlap, the earlier and then the longer one is met. A rule matches where its identifiers stand
    on sentences that follow each other directly, numbers of list items aside. Of matches that share a sentence, the earlier rule wins, then the
    earlier place. Returns one row per input row: ``doc_id, licenses`` (distinct names, sorted), ``n_matches`` and
    ``matches`` (``first, last`` number of the line or sentence from 0, ``license``, in text order).

    Null and empty texts match nothing. Rows are never merged: equal ids or texts give one row each. Other
    columns are not read. Empty tables give no rows.

    Only places where a known sentence may begin are shuffled, by row; a single text is the largest group.
    """
    spark = documents.sparkSession
    known = sentences.select("sentence", "sentence_id").dropna().filter(F.col("sentence").rlike(r"^[a-z0-9]+(?: (?:[a-z0-9]+|\*))*$"))
    known = known.groupBy("sentence").agg(F.min("sentence_id").alias("_id"))
    known = known.withColumn("_key", F.regexp_extract("sentence", "^[a-z0-9]+(?: [a-z0-9]+)?", 0))
    reach = known.agg(F.max(F.size(F.split("sentence", " ")) + GAP * F.regexp_count("sentence", F.lit(r"\*")))).first()[0] or 1
    beginnings = [r["_key"] for r in known.select("_key").distinct().limit(MAX_BEGINNINGS + 1).collect()]
    rows = documents.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    beginnings = beginnings if len(beginnings) <= MAX_BEGINNINGS else None
    rows = rows.select("_row", "doc_id", parts_of(F.col("text"), beginnings).alias("_parts"))
    starts = _starts(F.col("_parts"), beginnings, reach)
    said = rows.select("_row", "doc_id", F.explode_outer(starts).alias("_s")).select("_row", "doc_id", "_s", F.explode_outer("_s.keys").alias("_key"))
    steps = [
        (ids[k], order, k, len(ids), name) for order, (name, ids) in enumerate(rules) for k in range(len(ids))
    ]
    steps = spark.createDataFrame(steps, "_id string, _rule int, _step int, _size int, _license string")
    known = known.join(F.broadcast(steps), "_id")  # the rules of a sentence
    known = known.groupBy("_key", "sentence").agg(F.collect_list(F.struct("_rule", "_step", "_size", "_license")).alias("_steps"))
    known = known.withColumn("_prefix", F.substring_index("sentence", "*", 1))
    pattern = F.replace(F.replace("sentence", F.lit(" "), F.lit("[ \\n]")), F.lit("*"), F.lit(f"[a-z0-9]+(?:[ \\n][a-z0-9]+){{0,{GAP - 1}}}"))
    known = known.withColumn("_pattern", F.concat(F.lit("^("), pattern, F.lit(")(?:\\n|\\z)")))
    known = known.drop("sentence")
    on = ["_key"]
    if fits_broadcast(known):
        known = F.broadcast(known)
    else:  # a beginning that every third text holds is dealt over copies of its rows
        said = said.withColumn("_salt", F.pmod(F.xxhash64("_row", "_s.at"), F.lit(SALTS)).cast("int"))
        known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = ["_key", "_salt"]
    said, known = said.alias("said"), known.alias("known")
    same = F.expr(" AND ".join(f"said.{c} = known.{c}" for c in on) + " AND startswith(translate(said._s.rest, '\\n', ' '), known._prefix)")
    met = said.join(known, same, "left").withColumn("_found", F.expr("regexp_extract(_s.rest, _pattern, 1)"))
    more = F.length("_found") - F.length(F.replace("_found", F.lit("\n"), F.lit("")))  # parts after the first
    per_text = met.groupBy("_row", "doc_id").agg(F.collect_list(F.when(F.col("_found") != "", F.struct(
        F.col("_s.at").alias("at"), (-more).alias("less"), F.col("_s.marked").alias("marked"), F.get("_s.lines", F.lit(0)).alias("n"),
        F.get("_s.lines", more).alias("m"), F.col("_steps").alias("steps")))).alias("_met"))
    # Sentences that follow each other directly get numbers that do, all others leave one out.
    got = "array<struct<at:int,n:int,m:int,steps:array<struct<_rule:int,_step:int,_size:int,_license:string>>>>"
    begin = F.struct(F.lit(-2).alias("end"), F.lit(-2).alias("at"), F.array().cast(got).alias("got"))

    def follow(a: Column, m: Column) -> Column:
        next_to = (m["at"] == a["end"] + 1) | (m["marked"] & (m["at"] == a["end"] + 2))
        at = a["at"] + F.when(next_to, 1).otherwise(2)
        one = F.struct(at.alias("at"), m["n"].alias("n"), m["m"].alias("m"), m["steps"].alias("steps"))
        return F.when(m["at"] <= a["end"], a).otherwise(F.struct(
            (m["at"] - m["less"]).alias("end"), at.alias("at"), F.concat(a["got"], F.array(one)).alias("got")))

    per_text = per_text.withColumn("_met", F.aggregate(F.array_sort("_met"), begin, follow)["got"])
    # Each step votes for the place where its rule would begin; a rule with all its votes matches there.
    votes = F.flatten(F.transform("_met", lambda m: F.transform(m["steps"], lambda s: F.struct(
        s["_rule"].alias("rule"), (m["at"] - s["_step"]).alias("first"), s["_size"].alias("size"),
        s["_license"].alias("license"), s["_step"].alias("step"), m["n"].alias("n"), m["m"].alias("m"),
    ))))
    per_text = per_text.withColumn("_votes", F.sort_array(F.array_distinct(votes)))
    # Votes of one rule for one place lie together, in step order: the first of a full set is `size - 1` before the last.
    def whole(v: Column, i: Column) -> Column:
        end = F.get(F.col("_votes"), i + v["size"] - 1)
        return F.when((v["step"] == 0) & (end["rule"] == v["rule"]) & (end["first"] == v["first"]), F.struct(
            v["rule"].alias("rule"), v["first"].alias("first"), v["size"].alias("size"), v["license"].alias("license"),
            v["n"].alias("n"), end["m"].alias("m")))

    per_text = per_text.withColumn("_full", F.filter(F.transform("_votes", whole), lambda v: v.isNotNull()))
    span = "array<struct<rule:int,first:int,size:int,license:string,n:int,m:int>>"
    chosen = F.aggregate("_full", F.array().cast(span), lambda taken, v: F.when(
        F.exists(taken, lambda t: (t["first"] < v["first"] + v["size"]) & (v["first"] < t["first"] + t["size"])), taken
    ).otherwise(F.concat(taken, F.array(v))))
    matches = F.sort_array(F.transform(chosen, lambda v: F.struct(
        v["n"].alias("first"), v["m"].alias("last"), v["license"].alias("license"))))
    return per_text.withColumn("matches", matches).select(
        "doc_id", F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))).alias("licenses"),
        F.size("matches").cast("long").alias("n_matches"), "matches",
    )
