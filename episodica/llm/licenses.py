"""License scans with ordered signature rules, in native column functions.

Rules are regexes with a label, gate keywords, a priority (0 is the most specific) and a confidence. They are made from
the families below: each license's name goes through the wording templates, and a few notices stand alone. A text without
any gate stem is skipped; in the others only rules of which a keyword occurs are tried. Every match of a rule holds one of
its keywords, so gates drop nothing. Detections are ordered by start, longest first; one that lies within a detection of
the same or a more specific priority is suppressed, and so is a mention of a shorter name in a longer one.

Base phrases are matched on words (A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) and are never suppressed.
The score is the highest confidence of what is left, 0 without a detection.

Nulls, empty and wordless texts have no words, no places, empty labels and score 0. Offsets are code points. Very long texts
are scanned whole; of detections with one start the longest comes first, and equal ones are ordered by priority and label. No
rows give no rows. Other columns come along; a column of the output's name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Our own families: label, SPDX identifiers, names in running text, gate keywords (a|b).
LICENSES = (
    ("apache", r"apache-[0-9.]+", r"apache(?: software)?", "apache"),
    ("mit", r"mit(?:-0)?", r"(?:mit|expat|x11)", "mit|expat|x11"),
    ("bsd", r"(?:0bsd|bsd-[0-9]-clause[a-z-]*)", r"(?:(?:new|modified|simplified|revised|[0-9]-clause) )?bsd", "bsd"),
    ("isc", r"isc", r"isc", "isc"),
    ("zlib", r"zlib[a-z-]*", r"zlib(?:/libpng)?", "zlib"),
    ("boost", r"bsl-1\.0", r"boost(?: software)?", "b"),
    ("unlicense", r"unlicense", r"unlicense", "unlicense"),
    ("wtfpl", r"wtfpl", r"(?:wtfpl|do what the f\S+ you want to(?: public)?)", "wt|do what"),
    ("agpl", r"agpl-[0-9.]+[a-z+-]*", r"(?:agpl|(?:gnu )?affero general public)", "a"),
    ("lgpl", r"lgpl-[0-9.]+[a-z+-]*", r"(?:lgpl|(?:gnu )?(?:lesser|library) general public)", "l"),
    ("gpl", r"gpl-[0-9.]+[a-z+-]*", r"(?:gpl|gnu general public)", "g"),
    ("gfdl", r"gfdl-[0-9.]+[a-z-]*", r"(?:gfdl|gnu free documentation)", "g"),
    ("mpl", r"mpl-[0-9.]+[a-z-]*", r"(?:mpl|mozilla public)", "m"),
    ("epl", r"epl-[0-9.]+", r"(?:epl|eclipse public)", "e"),
    ("edl", r"edl-1\.0", r"eclipse distribution", "edl|eclipse"),
    ("cddl", r"cddl-[0-9.]+", r"(?:cddl|common development and distribution)", "d"),
    ("cpl", r"cpl-1\.0", r"(?:cpl|common public)", "c"),
    ("eupl", r"eupl-[0-9.]+", r"(?:eupl|european union public)", "eu"),
    ("osl", r"osl-[0-9.]+", r"open software", "osl|open software"),
    ("afl", r"afl-[0-9.]+", r"academic free", "afl|academic"),
    ("artistic", r"artistic-[0-9.]+[a-z0-9-]*", r"(?:clarified )?artistic", "artistic"),
    ("python", r"(?:psf|python)-2\.0", r"(?:psf|python(?: software foundation)?)", "p"),
    ("ruby", r"ruby", r"ruby", "ruby"),
    ("php", r"php-3\.[0-9]+", r"php", "php"),
    ("vim", r"vim", r"vim", "vim"),
    ("curl", r"curl", r"curl", "curl"),
    ("openssl", r"openssl", r"openssl(?:/ssleay)?", "openssl"),
    ("ncsa", r"ncsa", r"(?:ncsa|university of illinois/ncsa open source)", "ncsa"),
    ("ofl", r"ofl-1\.[01]", r"(?:ofl|sil open font)", "o"),
    ("postgresql", r"postgresql", r"postgresql", "postgresql"),
    ("sleepycat", r"sleepycat", r"sleepycat", "sleepycat"),
    ("qpl", r"qpl-1\.0", r"(?:qpl|q public)", "q"),
    ("ms-pl", r"ms-pl", r"(?:ms-pl|microsoft public)", "m"),
    ("ms-rl", r"ms-rl", r"(?:ms-rl|microsoft reciprocal)", "m"),
    ("cecill", r"cecill-[0-9.a-z]+", r"cecill(?:-[abc])?", "cecill"),
    ("odbl", r"odbl-1\.0", r"(?:odbl|open database)", "o"),
    ("odc-by", r"odc-by-1\.0", r"(?:odc-by|open data commons attribution)", "o"),
    ("cdla", r"cdla-[a-z]+-[0-9.]+", r"(?:cdla|community data license agreement)", "c"),
    ("openrail", r"[a-z]*openrail[a-z+-]*", r"(?:creativeml |bigscience )?(?:open)?rail(?:-m)?", "rail"),
    ("elastic", r"elastic-2\.0", r"elastic", "elastic"),
    ("sspl", r"sspl-1\.0", r"(?:sspl|server side public)", "s"),
    ("busl", r"busl-1\.1", r"(?:busl|business source)", "bus"),
    ("commons-clause", r"commons-clause", r"commons clause", "commons"),
    ("json", r"json", r"json", "json"),
    ("icu", r"icu", r"(?:icu|unicode)", "u"),
    ("cc0", r"cc0-1\.0", r"(?:cc0|cc zero|creative commons zero)", "c"),
    ("cc-by-nc-nd", r"cc-by-nc-nd-[0-9.]+", r"(?:cc[ -]by-nc-nd|creative commons attribution-noncommercial-noderiv[a-z]*)", "c"),
    ("cc-by-nc-sa", r"cc-by-nc-sa-[0-9.]+", r"(?:cc[ -]by-nc-sa|creative commons attribution-noncommercial-sharealike)", "c"),
    ("cc-by-nc", r"cc-by-nc-[0-9.]+", r"(?:cc[ -]by-nc|creative commons attribution-noncommercial)(?!-)", "c"),
    ("cc-by-nd", r"cc-by-nd-[0-9.]+", r"(?:cc[ -]by-nd|creative commons attribution-noderiv[a-z]*)", "c"),
    ("cc-by-sa", r"cc-by-sa-[0-9.]+", r"(?:cc[ -]by-sa|creative commons attribution-sharealike)", "c"),
    ("cc-by", r"cc-by-[0-9.]+", r"(?:cc[ -]by|creative commons attribution)(?!-)", "c"),
)
#: Our own wording around an identifier or a name, priority, confidence, and the stem each needs.
TEMPLATES = (
    (r"\bspdx-license-identifier:\s*(?:[a-z0-9.+() -]+ (?:or|and) )?{id}\b", 0, 1.0, "spdx"),
    (r"\b(?:licen[sc]ed|released|distributed|available|published|redistributed|covered|provided) (?:under|by) "
     r"(?:the (?:terms of the )?|an? )?{name}(?: (?:public )?licen[sc]e)?(?:,? (?:version|v\.?) ?[0-9.]*[0-9])?(?![a-z0-9])", 1, 0.9, "e"),
    (r"\b{name} (?:public )?licen[sc]e(?:,? (?:version|v\.?) ?[0-9.]*[0-9])?(?![a-z0-9])", 2, 0.8, "licen"),
    (r"\blicen[sc]e\s*[:=]\s*[\"']?(?:{id}|{name})(?![a-z0-9])", 1, 0.85, "licen"),
    (r"\bpermission [^.\n]{{0,80}}\b{name}(?![a-z0-9])", 3, 0.6, "permission"),
)
#: Our own notices that stand alone: label, pattern, gate keywords (a|b), priority, confidence.
NOTICES = (
    ("copyright", r"\bcopyright (?:\(c\)|©)? ?[0-9]{4}(?:\s*[-,]\s*[0-9]{4})*", "copyright", 2, 0.6),
    ("copyright", r"(?:©|\(c\)) ?[0-9]{4}", "©|(c)", 3, 0.5),
    ("reserved", r"\ball rights (?:are )?reserved\b", "rights", 1, 0.7),
    ("reserved", r"\b(?:some|no) rights reserved\b", "rights", 2, 0.5),
    ("public-domain", r"\b(?:dedicated|released|placed) (?:in|in)to the public domain\b", "public domain", 1, 0.9),
    ("public-domain", r"\bpublic domain(?: work)?\b", "public domain", 3, 0.4),
    ("mit", r"\bpermission is hereby granted, free of charge, to any person obtaining a copy\b", "hereby granted", 0, 1.0),
    ("isc", r"\bpermission to use, copy, modify, and(?:/or)? distribute this software\b", "permission to use", 0, 0.95),
    ("bsd", r"\bredistribution and use in source and binary forms\b", "redistribution", 0, 0.95),
    ("warranty", r"\bprovided \"?as[ -]is\"?,? without (?:any )?warrant(?:y|ies)\b", "warrant", 2, 0.5),
    ("proprietary", r"\b(?:proprietary and confidential|unauthorized copying of this)\b", "proprietary|unauthorized", 1, 0.8),
    ("gpl", r"\bfree software[:;,] you can redistribute it and/or modify it under the terms of the gnu\b", "free software", 0, 1.0),
    ("cc", r"\bcreativecommons\.org/licenses/[a-z/-]+[0-9.]*", "creativecommons", 0, 0.95),
    ("noai", r"\b(?:noai|no[- ]ai[- ]training)\b", "no", 2, 0.7),
)
#: A text without any of these has no detection.
_STEMS = ("licen", "copyright", "rights", "spdx", "public domain", "warrant", "creative", "permission", "redistribut",
          "proprietary", "unauthorized", "noai", "no-ai", "no ai", "(c)", "©", "released ", "distributed ", "available ", "published ",
          "covered ", "provided ", "free software")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DETECTION = "array<struct<start:bigint,last:bigint,priority:int,label:string,confidence:double>>"


def rules() -> list[tuple[str, str, str, str, int, float]]:
    """(label, pattern, keywords, stem, priority, confidence), in order of priority."""
    out = [(label, template.format(id=ids, name=name), keyword, stem, priority, confidence)
           for template, priority, confidence, stem in TEMPLATES for label, ids, name, keyword in LICENSES]
    out += [(label, pattern, keyword, "", priority, confidence) for label, pattern, keyword, priority, confidence in NOTICES]
    return sorted(out, key=lambda r: r[4])


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rule_array() -> Column:
    items = ",".join(f"named_struct('label',{_literal(a)},'pattern',{_literal(p)},'keywords',array({','.join(map(_literal, k.split('|')))}),'stem',{_literal(s)},"
                     f"'priority',{n},'confidence',{c}D)" for a, p, k, s, n, c in rules())
    return F.expr(f"array({items})")


def _matches(low: Column, rule: Column) -> Column:
    """Detections of one rule: match texts, and where they start from the pieces between them."""
    found = F.regexp_extract_all(low, rule["pattern"], F.lit(0))
    between = F.split(low, rule["pattern"], -1)

    def add(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.element_at(between, i))
        end = start + F.length(F.element_at(found, i))
        one = F.struct(start.alias("start"), (-end).alias("last"), rule["priority"].alias("priority"),
                       rule["label"].alias("label"), rule["confidence"].alias("confidence"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_DETECTION).alias("out"))
    kind = f"struct<at:bigint,out:{_DETECTION}>"
    return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(1), F.size(found)), start.cast(kind),
                                                 lambda acc, i: add(acc, i).cast(kind), lambda acc: acc["out"]))


def _unsuppressed(found: Column) -> Column:
    """Detections (ordered by start, longest first) that lie in none of the same or a more specific priority."""
    levels = 4
    kind = f"struct<ends:array<bigint>,out:{_DETECTION}>"
    start = F.struct(F.array(*[F.lit(-1)] * levels).alias("ends"), F.array().cast(_DETECTION).alias("out")).cast(kind)

    def step(acc: Column, d: Column) -> Column:
        inside = F.array_max(F.slice(acc["ends"], 1, d["priority"] + 1)) >= -d["last"]
        ends = F.transform(acc["ends"], lambda e, k: F.when(k == d["priority"], F.greatest(e, -d["last"])).otherwise(e))
        return F.struct(ends.alias("ends"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(d))).alias("out")).cast(kind)

    return F.aggregate(F.array_sort(found), start, step, lambda acc: acc["out"])


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - len(parts) + 1, F.lit(1)))

    def here(i: Column) -> Column:
        test = F.get(words, i - 1) == parts[0]
        for k, part in enumerate(parts[1:]):
            test = test & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return F.coalesce(test, F.lit(False))

    return F.transform(F.filter(at, here), lambda i: (i - 1).cast("bigint"))


def scan_licenses(docs: DataFrame, text: str = "text", output: str = "license") -> DataFrame:
    """``docs`` with a struct of word count, base places, kept detections, labels and score."""
    columns = [F.col(f"`{c}`") for c in docs.columns if c != output]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.struct(*columns).alias("_row"), body.alias("_text"),
                       F.trim(F.regexp_replace(body, r"[\x00-\x2F:-@\[-`{-\x7F]+", " ")).alias("_line"))
    any_phrase, any_stem = F.lit(False), F.lit(False)
    for phrase, _ in BASE:
        any_phrase = any_phrase | F.col("_padded").contains(f" {phrase} ")
    for stem in _STEMS:
        any_stem = any_stem | F.col("_gate").contains(stem)
    rows = rows.select("*", F.lower("_text").alias("_gate"), F.concat(F.lit(" "), F.lower("_line"), F.lit(" ")).alias("_padded"))
    rows = rows.select(
        "_row", (F.length("_line") - F.length(F.replace("_line", F.lit(" "), F.lit(""))) + (F.col("_line") != "").cast("int"))
        .cast("bigint").alias("n_words"),
        F.when(any_phrase,
               F.split(F.translate("_line", _UPPER, _LOWER), " ")).alias("_words"),
        F.when(any_stem, F.translate("_text", _UPPER, _LOWER)).alias("_low"))
    low = F.col("_low")
    none = F.array().cast(_DETECTION)
    tried = F.filter(_rule_array(), lambda r: low.contains(r["stem"]) & F.exists(r["keywords"], lambda k: low.contains(k)))
    found = F.when(low.isNotNull(), F.flatten(F.filter(F.transform(tried, lambda r: _matches(low, r)), lambda x: x.isNotNull())))
    rows = rows.withColumn("_found", F.coalesce(found, none))
    rows = rows.withColumn("_kept", F.when(F.size("_found") > 0, _unsuppressed(F.col("_found"))).otherwise(none))
    places = [F.coalesce(F.when(F.col("_words").isNotNull(), _places(F.col("_words"), p)), F.array().cast("array<bigint>")) for p, _ in BASE]
    rows = rows.withColumns({f"_p{k}": p for k, p in enumerate(places)})
    base = F.filter(F.array(*[F.when(F.size(f"_p{k}") > 0, label) for k, (_, label) in enumerate(BASE)]), lambda x: x.isNotNull())
    every = F.concat(*[F.col(f"_p{k}") for k in range(len(BASE))])
    confidence = F.array_max(F.concat(F.transform("_kept", lambda d: d["confidence"]),
                                      F.when(F.size(every) > 0, F.array(F.lit(0.5))).otherwise(F.array(F.lit(0.0)))))
    detections = F.transform("_kept", lambda d: F.struct(d["start"].alias("start"), (-d["last"]).alias("end"), d["label"].alias("label"),
                                                         d["priority"].alias("priority"), d["confidence"].alias("confidence")))
    result = F.struct("n_words", F.size(every).cast("bigint").alias("n_base"), F.array_min(every).alias("first_word"),
                      F.array_max(every).alias("last_word"), F.array_sort(base).alias("base_labels"),
                      F.array_sort(F.array_distinct(F.concat(base, F.transform("_kept", lambda d: d["label"])))).alias("labels"),
                      confidence.alias("score"), detections.alias("detections"))
    return rows.select("_row.*", result.alias(output))
