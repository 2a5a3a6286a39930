"""License detection with ordered signature rules.

Texts become words (digits, lower-case letters, everything beyond ASCII) joined by spaces. A
rule is a regular expression over them, gated by a keyword: it is tried only where its keyword
begins a word, and no rule is tried in a text without any gate word. Whatever a rule matches has
its keyword and a gate word, so gates save time and never lose a detection. Rules have a priority (0 is the
strongest). A detection is suppressed when one of equal or stronger priority covers its
interval; of equal intervals the stronger, then the earlier rule stays. Base phrases are always
kept and counted.

Everything is built-in expressions over one scan. Detections of a document are placed and
compared with windows, so time is linear in them up to sorting.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float
    base: bool = False


# Base phrases of the contract: phrase and label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Words of which a text needs one before any rule is tried.
GATES = ("licen", "copyright", "copyleft", "spdx", "public domain", "warrant", "rights reserved", "commons",
         "permission", "redistribut", "confidential", "free software", "as is")

# Label, keyword, names as patterns, SPDX words as a pattern (the part after the name is optional). Every name has
# the keyword; names or SPDX words that share none have lines of their own. None: no forms of that kind.
FAMILIES = (
    ("mit", "mit", r"(?:the )?mit", r"mit(?: 0)?"),
    ("mit", "expat", r"(?:the )?expat", None),
    ("mit", "x11", r"(?:the )?x11", None),
    ("apache", "apache", r"(?:the )?apache(?: software)?", r"apache [12] [01]"),
    ("gpl", "gpl", r"(?:the )?(?:gnu )?gpl(?:v[123])?", r"gpl [123] 0(?: only| or later)?"),
    ("gpl", "general public", r"(?:the )?gnu general public", r"gnu general public"),
    ("lgpl", "lgpl", r"(?:the )?(?:gnu )?lgpl(?:v[23])?", r"lgpl [23] [01](?: only| or later)?"),
    ("lgpl", "lesser general", r"(?:the )?(?:gnu )?lesser general public", r"gnu lesser"),
    ("lgpl", "library general", r"(?:the )?(?:gnu )?library general public", r"gnu library"),
    ("agpl", "agpl", r"(?:the )?(?:gnu )?agpl(?:v3)?", r"agpl [13] 0(?: only| or later)?"),
    ("agpl", "affero", r"(?:the )?(?:gnu )?affero(?: general)? public", r"gnu affero"),
    ("gfdl", "free documentation", r"(?:the )?gnu free documentation", r"gfdl 1 [123](?: only| or later)?"),
    ("bsd", "bsd", r"(?:the )?(?:new |modified |simplified |original )?(?:[0234] clause )?bsd", r"bsd [1234] clause"),
    ("bsd", "0bsd", None, r"0bsd"),
    ("mpl", "mozilla", r"(?:the )?mozilla public", r"mozilla"),
    ("mpl", "mpl", r"(?:the )?mpl", r"mpl [12] [01]"),
    ("epl", "eclipse", r"(?:the )?eclipse(?: public| distribution)?", r"epl [12] 0"),
    ("eupl", "european union", r"(?:the )?european union public", r"eupl 1 [012]"),
    ("cddl", "common development", r"(?:the )?common development and distribution", r"cddl 1 [01]"),
    ("cpl", "common public", r"(?:the )?common public", r"cpl 1 0"),
    ("cc0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("cc-by", "attribution", r"(?:creative commons )attribution(?: [1234] 0)?(?: international)?", r"cc by [1234] 0"),
    ("cc-by-sa", "sharealike", r"(?:creative commons )?attribution sharealike(?: [1234] 0)?", r"cc by sa [1234] 0"),
    ("cc-by-nc", "noncommercial", r"(?:creative commons )?attribution noncommercial(?: [1234] 0)?", r"cc by nc [1234] 0"),
    ("cc-by-nd", "noderiv", r"(?:creative commons )?attribution noderiv(?:s|atives)(?: [1234] 0)?", r"cc by nd [1234] 0"),
    ("cc", "commons", r"(?:a )?creative commons", r"cc"),
    ("isc", "isc", r"(?:the )?isc", r"isc"),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)?", r"zlib"),
    ("libpng", "libpng", r"(?:the )?libpng", r"libpng(?: 2 0)?"),
    ("boost", "boost", r"(?:the )?boost software", r"bsl 1 0"),
    ("bsl", "business source", r"(?:the )?business source", r"busl 1 1"),
    ("artistic", "artistic", r"(?:the )?(?:perl )?artistic", r"artistic [12] 0"),
    ("python", "python", r"(?:the )?python(?: software foundation)?", r"python 2 0"),
    ("python", "psf", r"(?:the )?psf", r"psf 2 0"),
    ("php", "php", r"(?:the )?php", r"php 3 01?"),
    ("ruby", "ruby", r"(?:the )?ruby", r"ruby"),
    ("w3c", "w3c", r"(?:the )?w3c(?: software)?(?: notice and)?", r"w3c(?: 20150513)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"(?:the )?wtfpl", r"wtfpl"),
    ("ofl", "open font", r"(?:the )?(?:sil )?open font", r"ofl 1 [01](?: rfn| no rfn)?"),
    ("odbl", "database", r"(?:the )?open (?:data commons )?(?:open )?database", r"odbl 1 0"),
    ("odc-by", "data commons", r"(?:the )?open data commons attribution", r"odc by 1 0"),
    ("pddl", "public domain dedication", r"(?:the )?(?:open data commons )?public domain dedication(?: and)?", r"pddl 1 0"),
    ("ms-pl", "microsoft", r"(?:the )?microsoft (?:public|reciprocal|limited public)", r"ms (?:pl|rl)"),
    ("openssl", "openssl", r"(?:the )?openssl", r"openssl"),
    ("postgresql", "postgresql", r"(?:the )?postgresql", r"postgresql"),
    ("vim", "vim", r"(?:the )?vim", r"vim"),
    ("curl", "curl", r"(?:the )?curl", r"curl"),
    ("afl", "academic free", r"(?:the )?academic free", r"afl [123] [012]"),
    ("osl", "open software", r"(?:the )?open software", r"osl [123] [01]"),
    ("ncsa", "ncsa", r"(?:the )?(?:university of illinois )?ncsa(?: open source)?", r"ncsa"),
    ("upl", "universal permissive", r"(?:the )?universal permissive", r"upl 1 0"),
    ("sspl", "side public", r"(?:the )?server side public", r"sspl 1 0"),
    ("elastic", "elastic", r"(?:the )?elastic", r"elastic 2 0"),
)
# The forms in which a family is named: pattern, priority, confidence, keyword.
FORMS = (
    (r"(?:licensed|distributed|released|available|published|provided) under (?:the terms of )?{name} licen[cs]e(?:s)?(?: (?:version |v)[0-9]+(?: [0-9]+)?)?", 1, 0.98, "{name}"),
    (r"spdx license identifier {spdx}", 1, 1.0, "identifier {spdx}"),
    (r"licenses? {spdx}(?: (?:html|txt|php))?", 3, 0.85, "{spdx}"),
    (r"{name} licen[cs]e (?:version |v)[0-9]+(?: [0-9]+)?", 2, 0.95, "{name}"),
    (r"{name} (?:public )?licen[cs]e", 3, 0.9, "{name}"),
)
# Full notices and general references.
NOTICES = (
    Rule("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 1, 0.97),
    Rule("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose", 1, 0.95),
    Rule("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 1, 0.95),
    Rule("zlib", "as is", r"this software is provided as is without any express or implied warranty in no event will the authors", 1, 0.93),
    Rule("gpl", "free software", r"this program is free software you can redistribute it and or modify it", 1, 0.93),
    Rule("unlicense", "public domain", r"this is free and unencumbered software released into the public domain", 1, 0.97),
    Rule("public-domain", "public domain", r"(?:released |placed |dedicated )?(?:in|into|to) the public domain", 3, 0.7),
    Rule("proprietary", "rights reserved", r"all rights reserved", 4, 0.6),
    Rule("proprietary", "confidential", r"proprietary and confidential", 3, 0.8),
    Rule("copyright", "copyright", r"copyright (?:c )?[0-9]{4}(?: [0-9]{4})?", 4, 0.5),
    Rule("reference", "licen", r"(?:see|read) (?:the )?(?:accompanying )?licen[cs]e(?: file| txt| md)?", 5, 0.3),
    Rule("reference", "licensed under", r"licensed under", 5, 0.4),
    Rule("no-warranty", "warrant", r"without (?:any )?warrant(?:y|ies)(?: of any kind)?", 5, 0.3),
)
PRIORITIES = 6


def beginning(pattern: str) -> str:
    """The words with which everything that ``pattern`` matches begins."""
    plain = re.match(r"[a-z0-9 ]*", pattern)[0]
    return (plain[:-1] if pattern[len(plain) :].startswith("?") else plain).rstrip()


def default_rules() -> list[Rule]:
    """Base phrases, notices, and every form of every family: about 280 rules in fixed order."""
    rules = [Rule(label, phrase, phrase, 3, 0.9, True) for phrase, label in BASE]
    rules += NOTICES
    for label, keyword, name, spdx in FAMILIES:
        for form, priority, confidence, key in FORMS:
            if (name if "{name}" in form else spdx) is not None:
                gate = key.format(name=keyword, spdx=beginning(spdx or ""))
                rules.append(Rule(label, gate, form.format(name=name, spdx=spdx), priority, confidence))
    return rules


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def detections(
    docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(row, doc_id, n_words, rule, label, base, priority, confidence, start, stop, suppressed).

    One row per detection, in word positions (``stop`` exclusive); a document without any has
    one row with nulls from ``rule`` on. ``row`` tells repeated ids and rows apart. A null text
    is empty: no words. Empty input gives no rows; other columns are not read.
    """
    rules = default_rules() if rules is None else rules
    table = F.array(
        *[
            F.struct(
                F.lit(i).alias("rule"),
                F.lit(f" {r.keyword}").alias("keyword"),
                F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern"),
            )
            for i, r in enumerate(rules)
        ]
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # lower() folds more than A-Z; it only widens the gate
    gated = reduce(lambda a, b: a | b, [F.lower("flat").contains(g) for g in GATES])
    flat = docs.select(F.col(id_col).alias("doc_id"), F.btrim(F.regexp_replace(text, BREAKS, " ")).alias("flat"))
    said = flat.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.when(F.col("flat") == "", 0).otherwise(spaces(F.col("flat")) + 1).cast("long").alias("n_words"),
        F.when(gated, F.concat(F.lit(" "), F.translate("flat", UPPER, LOWER), F.lit(" "))).alias("said"),
    )

    def places(r: Column) -> Column:
        between = F.transform(F.split(F.col("said"), r["pattern"], -1), lambda p: spaces(p) - 1)
        sizes = F.transform(
            F.regexp_extract_all(F.col("said"), r["pattern"], F.lit(0)), lambda m: spaces(m) + 1
        )
        return F.struct(r["rule"].alias("rule"), between.alias("gap"), sizes.alias("size"))

    meets = F.filter(table, lambda r: F.col("said").contains(r["keyword"]) & F.rlike(F.col("said"), r["pattern"]))
    found = F.transform(meets, places)
    hits = (
        said.select("row", "doc_id", "n_words", F.when(F.col("said").isNotNull(), found).alias("found"))
        .select("row", "doc_id", "n_words", F.explode_outer("found").alias("f"))
        .select(
            "row", "doc_id", "n_words", F.col("f.rule").alias("rule"),
            F.posexplode_outer(F.arrays_zip(F.slice("f.gap", 1, F.size("f.size")).alias("gap"), F.col("f.size").alias("size"))).alias("k", "z"),
        )
    )
    hits = hits.repartition("row")  # every window and group below is by row
    so_far = Window.partitionBy("row", "rule").orderBy("k")
    placed = hits.select(
        "row", "doc_id", "n_words", "rule", F.col("z.size").alias("size"),
        (F.sum(F.col("z.gap") + F.col("z.size")).over(so_far) - F.col("z.size")).alias("start"),
    )
    names = F.array(
        *[
            F.struct(
                F.lit(r.label).alias("label"), F.lit(r.base).alias("base"),
                F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence"),
            )
            for r in rules
        ]
    )
    named = placed.withColumn("stop", F.col("start") + F.col("size")).withColumn("r", F.get(names, F.col("rule")))
    earlier = (
        Window.partitionBy("row")
        .orderBy("start", F.desc("stop"), F.col("r.priority"), "rule")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    reach = F.array(
        *[F.max(F.when(F.col("r.priority") <= p, F.col("stop"))).over(earlier) for p in range(PRIORITIES)]
    )
    return named.withColumn("reach", reach).select(
        "row", "doc_id", "n_words", "rule", "r.label", "r.base", "r.priority", "r.confidence", "start", "stop",
        (F.coalesce(F.get("reach", F.col("r.priority")) >= F.col("stop"), F.lit(False)) & ~F.col("r.base")).alias("suppressed"),
    )


def scan(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_found), one row per row.

    ``score`` is the confidence of the surest surviving detection, 0 without any. ``n_found``
    counts surviving detections. Nulls, empty texts and repeated rows as in ``detections``.
    """
    found = detections(docs, rules, id_col, text_col)
    live = F.col("rule").isNotNull() & ~F.col("suppressed")
    base = F.col("base")

    def names(when: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")

    return found.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(live).alias("labels"),
        F.coalesce(F.max(F.when(live, F.col("confidence"))), F.lit(0.0)).alias("score"),
        F.count(F.when(live, 1)).alias("n_found"),
    ).drop("row")
