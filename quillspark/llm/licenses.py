"""License detection by ordered signature rules, in DataFrame operations only."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import table

#: Phrases whose places are counted as they are.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Public license names (label, words of the name as a pattern, words of the SPDX identifier).
NAMES = (
    ("0bsd", "(?:zero clause bsd|bsd zero clause)", "0bsd"),
    ("afl-3", "academic free license(?: version| v)? ?3(?: 0)?", "afl 3 0"),
    ("agpl-3", "(?:gnu )?affero general public license(?: version| v)? ?3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("apache-1.1", "apache (?:software )?license(?: version| v)? ?1 1", "apache 1 1"),
    ("apache-2", "apache (?:software )?license(?: version| v)? ?2(?: 0)?", "apache 2 0"),
    ("apsl-2", "apple public source license(?: version| v)? ?2(?: 0)?", "apsl 2 0"),
    ("artistic-2", "artistic license(?: version| v)? ?2(?: 0)?", "artistic 2 0"),
    ("artistic-1", "artistic license(?: version| v)? ?1(?: 0)?", "artistic 1 0"),
    ("beerware", "beerware", "beerware"),
    ("blueoak-1", "blue oak model license(?: 1 0 0)?", "blueoak 1 0 0"),
    ("bsd-2", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", "bsd 2 clause"),
    ("bsd-3", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", "bsd 3 clause"),
    ("bsd-4", "(?:bsd 4 clause|4 clause bsd|original bsd)", "bsd 4 clause"),
    ("bsl-1", "boost software license(?: version| v)?(?: 1 0)?", "bsl 1 0"),
    ("busl-1.1", "business source license(?: version| v)?(?: 1 1)?", "busl 1 1"),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative|ativ|ation)e?s?)(?: [1-4] [05])?", "cc by nc nd [1-4] [05]"),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?", "cc by nc sa [1-4] [05]"),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?", "cc by nc [1-4] [05]"),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?derivatives)(?: [1-4] [05])?", "cc by nd [1-4] [05]"),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?", "cc by sa [1-4] [05]"),
    ("cc-by", "(?:cc by|creative commons attribution)(?: [1-4] [05])?", "cc by [1-4] [05]"),
    ("cc0", "(?:cc0(?: 1 0)?|creative commons zero)", "cc0 1 0"),
    ("cddl-1", "common development and distribution license(?: version| v)?(?: 1 [01])?", "cddl 1 [01]"),
    ("cecill-2", "cecill(?: version| v)?(?: 2 [01])?", "cecill 2 [01]"),
    ("cpl-1", "common public license(?: version| v)?(?: 1 0)?", "cpl 1 0"),
    ("ecl-2", "educational community license(?: version| v)?(?: 2 0)?", "ecl 2 0"),
    ("epl-1", "eclipse public license(?: version| v)? ?1(?: 0)?", "epl 1 0"),
    ("epl-2", "eclipse public license(?: version| v)? ?2(?: 0)?", "epl 2 0"),
    ("eupl-1.2", "european union public licen[cs]e(?: version| v)?(?: 1 [12])?", "eupl 1 [12]"),
    ("gfdl-1.3", "(?:gnu )?free documentation license(?: version| v)?(?: 1 [123])?", "gfdl 1 [123](?: only| or later)?"),
    ("gpl-1", "(?:gnu )?general public license(?: version| v)? ?1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2", "(?:gnu )?general public license(?: version| v)? ?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3", "(?:gnu )?general public license(?: version| v)? ?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("hpnd", "historical permission notice and disclaimer", "hpnd"),
    ("isc", "isc", "isc"),
    ("json", "json", "json"),
    ("lgpl-2", "(?:gnu )?library general public license(?: version| v)? ?2(?: 0)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "(?:gnu )?lesser general public license(?: version| v)? ?2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "(?:gnu )?lesser general public license(?: version| v)? ?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("libpng", "libpng", "libpng(?: 2 0)?"),
    ("lppl-1.3", "latex project public license(?: version| v)?(?: 1 3 ?c?)?", "lppl 1 3c?"),
    ("mit-0", "mit no attribution", "mit 0"),
    ("mit", "(?:mit|expat)", "mit"),
    ("mpl-1.1", "mozilla public license(?: version| v)? ?1 1", "mpl 1 1"),
    ("mpl-2", "mozilla public license(?: version| v)? ?2(?: 0)?", "mpl 2 0"),
    ("ms-pl", "microsoft public license", "ms pl"),
    ("ms-rl", "microsoft reciprocal license", "ms rl"),
    ("mulan-2", "mulan permissive software license(?: version| v)?(?: 2)?", "mulanpsl 2 0"),
    ("ncsa", "(?:university of illinois )?ncsa(?: open source)?", "ncsa"),
    ("odbl-1", "open (?:data commons open )?database license", "odbl 1 0"),
    ("ofl-1.1", "(?:sil )?open font license(?: version| v)?(?: 1 1)?", "ofl 1 1"),
    ("openssl", "openssl", "openssl"),
    ("osl-3", "open software license(?: version| v)? ?3(?: 0)?", "osl 3 0"),
    ("php-3", "php license(?: version| v)?(?: 3 01?)?", "php 3 01?"),
    ("postgresql", "postgresql", "postgresql"),
    ("psf-2", "python software foundation", "(?:psf|python) 2 0"),
    ("qpl-1", "q public license(?: version| v)?(?: 1 0)?", "qpl 1 0"),
    ("ruby", "ruby", "ruby"),
    ("sspl-1", "server side public license(?: version| v)?(?: 1)?", "sspl 1 0"),
    ("unlicense", "unlicense", "unlicense"),
    ("upl-1", "universal permissive license(?: version| v)?(?: 1 0)?", "upl 1 0"),
    ("vim", "vim", "vim"),
    ("w3c", "w3c(?: software)?", "w3c"),
    ("wtfpl", "do what the fuck you want to public license", "wtfpl"),
    ("x11", "x11", "x11"),
    ("zlib", "zlib", "zlib"),
    ("zpl-2", "zope public license(?: version| v)?(?: 2 [01])?", "zpl 2 [01]"),
)

#: Sentences of license texts and notices, by hand: label, keyword, pattern, priority.
TEXTS = (
    ("mit", "free of charge", "permission is hereby granted free of charge to any person obtaining a copy", 1),
    ("mit", "substantial portions", "shall be included in all copies or substantial portions of the software", 1),
    ("isc", "with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee", 1),
    ("bsd-2", "source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted", 2),
    ("bsd-3", "endorse or promote", "may be used to endorse or promote products derived from this software", 1),
    ("bsd-4", "mentioning features", "all advertising materials mentioning features or use of this software", 1),
    ("apache-2", "apache org licenses", "(?:www )?apache org licenses license 2 0", 1),
    ("apache-2", "except in compliance", "you may not use this file except in compliance with the license", 2),
    ("gpl-2", "either version 2", "either version 2 of the license or at your option any later version", 1),
    ("gpl-3", "either version 3", "either version 3 of the license or at your option any later version", 1),
    ("gpl", "free software foundation", "general public license as published by the free software foundation", 2),
    ("gpl", "gnu org licenses", "(?:www )?gnu org licenses gpl(?: 3 0| 2 0)?", 2),
    ("lgpl", "gnu org licenses", "(?:www )?gnu org licenses lgpl(?: 3 0| 2 1)?", 2),
    ("agpl-3", "gnu org licenses", "(?:www )?gnu org licenses agpl(?: 3 0)?", 2),
    ("mpl-2", "mozilla org", "mozilla org mpl 2 0", 1),
    ("epl-2", "eclipse org", "(?:www )?eclipse org legal epl(?: 2 0| v20)", 1),
    ("bsl-1", "boost org", "(?:www )?boost org license 1 0", 1),
    ("cc0", "publicdomain zero", "creativecommons org publicdomain zero 1 0", 1),
    ("cc-by", "creativecommons org", "creativecommons org licenses by [1-4] [05]", 1),
    ("cc-by-sa", "creativecommons org", "creativecommons org licenses by sa [1-4] [05]", 1),
    ("cc-by-nc", "creativecommons org", "creativecommons org licenses by nc [1-4] [05]", 1),
    ("cc-by-nc-sa", "creativecommons org", "creativecommons org licenses by nc sa [1-4] [05]", 1),
    ("cc-by-nc-nd", "creativecommons org", "creativecommons org licenses by nc nd [1-4] [05]", 1),
    ("cc-by-nd", "creativecommons org", "creativecommons org licenses by nd [1-4] [05]", 1),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 1),
    ("public-domain", "public domain", "(?:released|placed|dedicated|put)(?: in| into| to)? the public domain", 2),
    ("public-domain", "public domain", "(?:is|are) in the public domain", 3),
    ("zlib", "as is", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 1),
    ("all-rights-reserved", "all rights reserved", "all rights reserved", 3),
    ("proprietary", "confidential and proprietary", "confidential and proprietary", 2),
    ("proprietary", "proprietary license", "proprietary license", 2),
    ("proprietary", "without permission", "may not be (?:copied|reproduced|distributed)(?: or (?!without )\\w+)*+ without permission", 2),
    ("warranty-disclaimer", "without warrant", "without warrant(?:y|ies) of any kind(?: express or implied)?", 4),
    ("gpl", "general public license", "(?:gnu )?general public license", 4),
    ("lgpl", "lesser general public license", "(?:gnu )?lesser general public license", 4),
    ("cc", "creative commons", "creative commons(?: license)?", 4),
    ("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9][0-9]", 4),
)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Confidence by priority.
SCORES = (1.0, 0.9, 0.7, 0.4)


def _plain(name: str) -> str:
    """Longest run of plain words of a pattern, for the prefilter; empty if it has none."""
    runs = re.split(r"\(.*?\)\??|\[.*?\]\??|.\?", re.sub(r"\((?:[^()]|\([^()]*\))*\)\??", "(x)", name))
    return max((r.strip() for r in runs), key=len, default="")


def _keys(pattern: str) -> list[str]:
    """Plain words of which a match of ``pattern`` holds at least one: one for each alternative of a leading group."""
    def word(own: str) -> str:
        key = _plain(own)
        return " " + key if own.startswith(key) else key

    if not pattern.startswith("(?:"):
        return [word(pattern)]
    depth, cuts = 0, [2]  # places of the colon and of the bars
    for i, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 1:
            cuts.append(i)
        if not depth:
            break
    rest = pattern[i + 1:]
    if rest.startswith("?"):
        return [word(pattern)]
    return [word(pattern[x + 1:y] + rest) for x, y in zip(cuts, [*cuts[1:], i])]


def rules() -> list[dict]:
    """The signatures in order: for each license those of the templates, then the sentences.

    Templates are an identifier after 'SPDX license identifier', one further on in
    a list after it or after a grant (its interval is the part that ``last`` finds), and
    a grant and a mention of the name and of the identifier or short form.  A match
    holds ``gate`` and one of ``keys``, so ``pattern`` is tried only if they stand
    in the text; a lower ``priority`` is the surer kind.
    """
    grant = ("(?:licensed|licenced|released|distributed|available|provided|published|shared|offered)(?: to you)? under"
             "(?: the)?(?: terms)?(?: and)?(?: conditions)?(?: of)?(?: the)? ")
    word = "[a-z0-9]+"
    known = "|".join(short for _, _, short in (_forms(*n) for n in NAMES))
    link = f"(?:{known}|licenseref(?: {word}){{1,3}}|(?:{word} ){{1,4}}exception(?: [0-9]{{1,2}}){{0,2}})(?: licen[cs]e)? (?:or|and|with)(?: the)? "
    # a list is walked without giving back, up to the license's own part: such a loop needs no stack, however long the list
    before = lambda short: f"(?!{short}(?: licen[cs]e)? (?:or|and|with) )"
    spdx, out = "spdx license identifier ", []
    for label, name, ids in NAMES:
        _, own, short = _forms(label, name, ids)
        named = dict(label=label, keys=_keys(name))
        by_id = dict(label=label, keys=_keys(short))
        out.append(by_id | dict(gate=spdx, pattern=f"{spdx}{short}", priority=1))
        out.append(by_id | dict(gate=spdx, pattern=f"{spdx}(?:{before(short)}{link})++{short}", last=f" {short}$", priority=1))
        out.append(named | dict(gate=" under ", pattern=f"{grant}{name}(?: licen[cs]e)?", priority=2))
        out.append(named | dict(gate="licen", pattern=f"(?:the )?{name}(?: licen[cs]e)" if "licen" not in name else f"(?:the )?{name}", priority=3))
        if own:
            out.append(by_id | dict(gate=" under ", pattern=f"{grant}{short}(?: licen[cs]e)?", priority=2))
            out.append(by_id | dict(gate=" licen", pattern=f"(?:the )?{short}(?: licen[cs]e)", priority=3))
        out.append(by_id | dict(gate=" under ", pattern=f"{grant}(?:{before(short)}{link})++{short}(?: licen[cs]e)?", last=f" {short}(?: licen[cs]e)?$", priority=2))
    out += [dict(label=label, gate=key, keys=[key], pattern=pattern, priority=priority) for label, key, pattern, priority in TEXTS]
    return [dict(last="") | r | dict(rule=i, pattern=f" (?:{r['pattern']})(?= )") for i, r in enumerate(out)]


#: Usual short forms besides the identifier.
SHORT = {
    "apache-2": "apache ?v?2(?: 0)?", "apache-1.1": "apache 1 1", "agpl-3": "(?:gnu )?agpl ?v?3(?: 0)?", "gpl-1": "(?:gnu )?gpl ?v?1(?: 0)?",
    "gpl-2": "(?:gnu )?gpl(?: version)? ?v?2(?: 0)?", "gpl-3": "(?:gnu )?gpl(?: version)? ?v?3(?: 0)?", "lgpl-2": "(?:gnu )?lgpl(?: version)? ?v?2(?: 0)?",
    "lgpl-2.1": "(?:gnu )?lgpl(?: version)? ?v?2 1", "lgpl-3": "(?:gnu )?lgpl(?: version)? ?v?3(?: 0)?", "mpl-1.1": "mpl ?v?1 1", "mpl-2": "mpl ?v?2(?: 0)?",
    "epl-1": "epl ?v?1(?: 0)?", "epl-2": "epl ?v?2(?: 0)?", "eupl-1.2": "eupl ?v?1 [12]", "bsl-1": "bsl ?v?1(?: 0)?", "cddl-1": "cddl ?v?1 [01]",
    "gfdl-1.3": "(?:gnu )?(?:gfdl|fdl) ?v?1 [123]"}


def _forms(label: str, name: str, ids: str) -> tuple[str, bool, str]:
    """Label, whether it has forms that ``name`` lacks, and the pattern of identifier and short forms, '+' and 'only' with it."""
    short = SHORT.get(label)
    if short is None:
        return label, not re.fullmatch(name, ids), f"(?:{ids})"
    later = "(?: only| or later| plus)?" if "gpl" in label or "gfdl" in label else ""
    return label, True, f"(?:{ids}|{short}{later})"


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _labels(items: Column) -> Column:
    return F.concat_ws(",", F.array_sort(F.array_distinct(items)))


def license_scan(docs: DataFrame, signatures: list[dict] | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections``.

    Words are those of the whole text, A-Z in lower case; signatures are tried
    on them with one blank between.  A signature whose gate or keywords are missing
    costs no match; both are words that any match of it holds.  Every place of every signature is a
    detection (an interval of words).  One inside another of the same or a surer
    priority is dropped; containment is transitive, so one pass in order of start
    (a running maximum of ends for each priority) settles it.  Base labels stay.

    Null text is empty (no words, no labels, score 0); a null ``doc_id`` stays;
    repeated rows each give their row; other columns are ignored.
    """
    own = signatures if signatures is not None else rules()
    levels = sorted({r["priority"] for r in own}) or [1]
    groups: dict = {}
    for rule in own:
        groups.setdefault(rule["gate"], {}).setdefault(tuple(rule["keys"]), []).append(rule)
    kind = "array<struct<gate:string,sets:array<struct<keys:array<string>,rules:array<struct<rule:int,label:string,pattern:string,last:string,priority:int>>>>>>"
    signature = F.from_json(F.lit(json.dumps([dict(gate=g, sets=[dict(keys=k, rules=v) for k, v in sets.items()]) for g, sets in groups.items()])), kind)
    words = F.trim(F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "), _UPPER, _UPPER.lower()))
    norm = F.col("norm")
    places = [(F.contains(norm, F.lit(f" {p} ")), p, label) for p, label in BASE]
    spot = lambda make: [F.when(has, make(p)) for has, p, _ in places]
    gated = F.flatten(F.transform(F.filter(signature, lambda g: F.contains(norm, g["gate"])), lambda g: g["sets"]))
    tried = F.flatten(F.transform(F.filter(gated, lambda k: F.exists(k["keys"], lambda w: F.contains(norm, w))), lambda k: k["rules"]))
    rows = (docs.select(F.monotonically_increasing_id().alias("number"), F.col("doc_id").cast("long"), words.alias("words"))
            .select("number", "doc_id", F.concat(F.lit(" "), "words", F.lit(" ")).alias("norm"),
                    F.when(F.col("words") == "", 0).otherwise(_spaces(F.col("words")) + 1).cast("long").alias("n_words")))
    base = rows.select(
        "number", "doc_id", "norm", "n_words",
        sum((F.when(has, F.regexp_count(norm, F.lit(f" {p}(?= )"))).otherwise(0) for has, p, _ in places), F.lit(0)).cast("long").alias("n_base"),
        F.least(*spot(lambda p: _spaces(F.substring_index(norm, f" {p} ", 1)))).cast("long").alias("first_word"),
        F.greatest(*spot(lambda p: _spaces(F.regexp_extract(norm, f"(?s)^(.*) {p} ", 1)))).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(has, F.lit(label)) for has, _, label in places])).alias("base"),
        F.explode_outer(tried).alias("r"))
    kept = ["number", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    found = F.arrays_zip(F.split("norm", F.col("r.pattern"), -1).alias("gap"), F.regexp_extract_all("norm", F.col("r.pattern"), F.lit(0)).alias("match"))
    at = (base.select(*kept, F.col("r.rule").alias("rule"), F.col("r.label").alias("label"), F.col("r.last").alias("last"), F.col("r.priority").alias("priority"),
                      F.posexplode_outer(F.when(F.col("r.pattern").isNotNull() & F.rlike("norm", F.col("r.pattern")),
                                                F.filter(found, lambda x: x["match"].isNotNull()))).alias("pos", "m"))
          .select(*kept, "rule", "label", "priority", "pos", _spaces(F.col("m.gap")).alias("gap"), _spaces(F.col("m.match")).alias("size"),
                  _spaces(F.when(F.col("last") == "", F.col("m.match")).otherwise(F.regexp_substr("m.match", F.col("last")))).alias("own_size"))
          .repartition("number"))
    turn = Window.partitionBy("number", "rule").orderBy("pos")
    spans = at.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(turn)).withColumn("start", F.col("end") - F.col("own_size"))
    before = (Window.partitionBy("number").orderBy(F.col("start"), F.desc("end"), "priority", "rule")
              .rowsBetween(Window.unboundedPreceding, -1))
    inside = F.lit(False)
    for p in levels:
        inside = inside | ((F.col("priority") >= p) & (F.max(F.when(F.col("priority") == p, F.col("end"))).over(before) >= F.col("end")))
    left = spans.withColumn("inside", F.coalesce(inside, F.lit(False)))
    stands = F.col("pos").isNotNull() & ~F.col("inside")
    grade = F.element_at(F.array(*map(F.lit, SCORES)), F.col("priority"))
    first = [F.first(c).alias(c) for c in kept[1:]]
    return (left.groupBy("number").agg(*first, F.collect_set(F.when(stands, F.col("label"))).alias("own"),
                                       F.max(F.when(stands, grade)).alias("best"),
                                       F.sort_array(F.collect_list(F.when(stands, F.struct("start", "end", "label", "rule")))).alias("detections"))
            .select("doc_id", "n_words", "n_base", "first_word", "last_word", _labels(F.col("base")).alias("base_labels"),
                    _labels(F.concat("base", "own")).alias("labels"),
                    F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(SCORES[1])).otherwise(0.0)).alias("score"),
                    "detections"))


def op4_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")
