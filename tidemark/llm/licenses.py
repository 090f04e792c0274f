"""License scans by ordered signature rules (operator 10), with DataFrame functions alone.

A text is read as words: runs of letters and digits of ASCII, in lower case, and of any other character. A keyword
prefilter, one search of the raw text, spares all other work for texts without any keyword. The rest are written as
words with single spaces, and every rule whose own keyword is there is searched in them.

A rule has a class (1: a notice or an identifier; 2: a name with its version; 3: a name), a keyword, a label and a
regular expression over words. A detection is an interval of words. It is suppressed if a detection of the same or a
better class contains it; of two equal intervals the one of the better class stays, then the one of the earlier rule.

Base places stand beside the rules: a phrase's words one after another, and their labels always stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Characters between words of a text, as it stands and in lower case (a class of a Java regular expression).
GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Rule:
    rank: int
    level: int
    keyword: str
    label: str
    pattern: str


def _rules() -> list[Rule]:
    """The signatures, written by hand by family. ``V`` in a pattern stands for one of the family's versions, in the
    label it is written with a dash. Words that may be there or not end in ``?``.
    """
    opening = "(?:licensed|released|distributed|available|published|provided|covered|governed)"
    notice = f"{opening} (?:under|by) (?:the )?(?:terms of )?(?:the )?"
    version = "(?:,? ?(?:version|ver|v|release) ?)?"
    # label, keyword, names, versions ("" is a name without one); a name that lacks the keyword has its own before it
    families = [
        ("apache", "apache", ["apache(?: software)? license", "apache public license", ("asl", "asl"), "apache"], ["1.0", "1.1", "2.0", "2"]),
        ("gpl", "general public", ["(?:gnu )?general public license", ("gpl", "gnu gpl")], ["1.0", "2.0", "3.0", "1", "2", "3"]),
        ("gpl", "gpl", ["gnu gpl", "gplv", "gpl"], ["1.0", "2.0", "3.0", "1", "2", "3"]),
        ("lgpl", "lesser general", ["(?:gnu )?lesser general public license"], ["2.1", "3.0", "3"]),
        ("lgpl", "library general", ["(?:gnu )?library general public license"], ["2.0", "2"]),
        ("lgpl", "lgpl", ["gnu lgpl", "lgplv", "lgpl"], ["2.0", "2.1", "3.0", "3"]),
        ("agpl", "affero", ["(?:gnu )?affero general public license", "gnu affero"], ["1.0", "3.0", "3"]),
        ("agpl", "agpl", ["gnu agpl", "agplv", "agpl"], ["1.0", "3.0", "3"]),
        ("gfdl", "free documentation", ["(?:gnu )?free documentation license"], ["1.1", "1.2", "1.3"]),
        ("mpl", "mozilla", ["mozilla public license"], ["1.0", "1.1", "2.0"]),
        ("mpl", "mpl", ["mpl"], ["1.0", "1.1", "2.0"]),
        ("epl", "eclipse", ["eclipse public license"], ["1.0", "2.0"]),
        ("edl", "eclipse", ["eclipse distribution license"], ["1.0"]),
        ("cddl", "common development", ["common development and distribution license"], ["1.0", "1.1"]),
        ("cddl", "cddl", ["cddl"], ["1.0", "1.1"]),
        ("cpl", "common public", ["common public license"], ["1.0"]),
        ("cpal", "common public", ["common public attribution license"], ["1.0"]),
        ("eupl", "european union", ["european union public licen[cs]e"], ["1.0", "1.1", "1.2"]),
        ("eupl", "eupl", ["eupl"], ["1.0", "1.1", "1.2"]),
        ("artistic", "artistic", ["(?:the )?artistic license", "perl artistic"], ["1.0", "2.0"]),
        ("bsl", "boost", ["boost software license"], ["1.0"]),
        ("busl", "business source", ["business source license"], ["1.1"]),
        ("osl", "open software", ["open software license"], ["1.0", "1.1", "2.0", "2.1", "3.0"]),
        ("afl", "academic free", ["academic free license"], ["1.1", "1.2", "2.0", "2.1", "3.0"]),
        ("psf", "python", ["python software foundation license", ("psf", "psf license")], ["2.0", "2"]),
        ("php", "php", ["php license"], ["3.0", "3.01"]),
        ("zpl", "zope", ["zope public license"], ["1.1", "2.0", "2.1"]),
        ("ofl", "font", ["(?:sil )?open font license"], ["1.0", "1.1"]),
        ("odbl", "database", ["open database license", "open data commons open database"], ["1.0"]),
        ("odc-by", "attribution", ["open data commons attribution license"], ["1.0"]),
        ("pddl", "public domain", ["public domain dedication and license"], ["1.0"]),
        ("cecill", "cecill", ["cecill", "cecill free software license"], ["1.0", "1.1", "2.0", "2.1"]),
        ("ms-pl", "microsoft", ["microsoft public license"], []),
        ("ms-rl", "microsoft", ["microsoft reciprocal license"], []),
        ("ncsa", "ncsa", ["(?:university of illinois )?ncsa open source license"], []),
        ("upl", "universal", ["universal permissive license"], ["1.0"]),
        ("mulan", "mulan", ["mulan (?:permissive software|psl|public) ?(?:license)?"], ["1.0", "2.0"]),
        ("sspl", "server side", ["server side public license"], ["1.0", "1"]),
        ("elastic", "elastic", ["elastic license"], ["1.0", "2.0"]),
        ("rail", "rail", ["(?:big ?science |creativeml )?open rail(?: m)?", ("responsible ai", "responsible ai license")], ["1.0"]),
        ("wtfpl", "wtfpl", ["wtfpl"], ["1.0", "2.0"]),
        ("zlib", "zlib", ["zlib(?: libpng)? license"], []),
        ("libpng", "libpng", ["libpng license"], []),
        ("isc", "isc", ["isc license"], []),
        ("unlicense", "unlicense", ["(?:the )?unlicense"], []),
        ("mit", "mit licen", ["mit licen[cs]e"], []),
        ("mit", "mit x11", ["mit x11 licen[cs]e"], []),
        ("mit", "mit style", ["mit style licen[cs]e"], []),
        ("mit", "expat", ["expat licen[cs]e"], []),
        ("x11", "x11", ["x11 license", "mit x11"], []),
        ("postgresql", "postgresql", ["postgresql license"], []),
        ("openssl", "openssl", ["openssl license"], []),
        ("vim", "vim license", ["vim license"], []),
        ("ruby", "ruby", ["ruby license", "ruby s license"], []),
        ("ijg", "jpeg", ["independent jpeg group license"], []),
        ("beerware", "beerware", ["beerware(?: license)?"], ["42"]),
        ("beerware", "beer ware", ["beer ware(?: license)?"], ["42"]),
        ("json", "json", ["json license"], []),
        ("cc0", "cc0", ["cc0", ("creative commons", "creative commons zero"), ("cc zero", "cc zero")], ["1.0"]),
        ("cc0", "creative commons", ["creative commons (?:cc)?0", "creative commons zero", "creative commons public domain dedication"], ["1.0"]),
    ]
    kinds = [("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nc", "attribution non ?commercial"), ("by-nd", "attribution no ?deriv(?:ative)?s?(?: works)?"), ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?")]
    for kind, long in kinds:
        families.append((f"cc-{kind}", "cc by", [f"cc {kind.replace('-', ' ')}", ("ccby", f"cc{kind.replace('-', ' ')}")], ["1.0", "2.0", "2.5", "3.0", "4.0"]))
        families.append((f"cc-{kind}", "creative commons", [f"creative commons {long}", f"creative commons {kind.replace('-', ' ')}"], ["1.0", "2.0", "2.5", "3.0", "4.0"]))
    for n, clause in ((0, "zero"), (2, "simplified"), (3, "new|revised|modified"), (4, "original|old")):
        families.append((f"bsd-{n}-clause", "bsd", [f"(?:bsd {n} clause|{n} clause bsd|(?:{clause}) bsd)(?: licen[cs]e)?"], []))
    families.append(("bsd", "bsd", ["bsd(?: style)? licen[cs]e", ("berkeley software", "berkeley software distribution licen[cs]e")], []))

    found: list[tuple[int, str, str, str]] = []
    for label, first, all_names, versions in families:
        own: dict[str, list[str]] = {}
        for x in all_names:
            own.setdefault(first if isinstance(x, str) else x[0], []).append(x if isinstance(x, str) else x[1])
        alone = len(own[first][0].replace("(?:", "")) > 5 or not versions
        for keyword, names in own.items():
            name = f"(?:{'|'.join(names)})"
            for v in versions:
                words = v.replace(".", " ")
                full = f"{label}-{v if '.' in v or label == 'beerware' else v + '.0'}"
                mark = "(?:version |ver |v |release )?v?"
                tail = " ?(?:international|generic|unported)?(?: (?:public )?licen[cs]e)?" if label.startswith("cc") else "(?: licen[cs]e)?"
                ending = f"{words}(?! \\d)" if "." not in v else words
                found.append((1, keyword, full, f"{notice}{name} {mark}{ending}{tail}"))
                found.append((2, keyword, full, f"{name} ?{mark}{ending}{tail}"))
            found.append((1, keyword, label, f"{notice}{name}"))
            if alone:
                found.append((3, keyword, label, name))
    texts = [
        ("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
        ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose"),
        ("bsd", "redistribution and use", "redistribution and use in source and binary forms"),
        ("gpl", "free software", "free software you can redistribute it and or modify it under the terms"),
        ("zlib", "provided as is", "this software is provided as is without any express or implied warranty in no event will the authors"),
        ("boost", "permission is hereby", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
        ("unlicense", "unencumbered", "free and unencumbered software released into the public domain"),
        ("wtfpl", "do what the", "do what the fuck you want to public license"),
        ("public-domain", "public domain", "(?:dedicated to|placed in(?:to)?|in|into) the public domain"),
        ("proprietary", "all rights reserved", "all rights reserved"),
        ("proprietary", "proprietary", "(?:proprietary and confidential|confidential and proprietary)"),
        ("copyright", "copyright", "copyright(?: c)? (?:19|20)\\d\\d"),
    ]
    found += [(3 if label in ("proprietary", "copyright") else 1, keyword, label, words) for label, keyword, words in texts]
    for name in ("mit", "isc", "apache 2 0", "gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0 only", "gpl 3 0 or later", "lgpl 2 1 only", "lgpl 3 0 only", "agpl 3 0 only", "bsd 2 clause", "bsd 3 clause", "mpl 2 0", "epl 2 0", "unlicense", "zlib", "cc0 1 0", "cc by 4 0", "cc by sa 4 0", "bsl 1 0", "0bsd"):
        head, _, rest = name.partition(" ")
        found.append((1, "spdx", name.replace(" 0", ".0").replace(" 1 only", ".1-only").replace(" ", "-"), f"spdx license identifier {name}"))
    return [Rule(i, *x) for i, x in enumerate(found)]


RULES = _rules()
#: Weight of a class in the score, and of a base place.
WEIGHT = {1: 1.0, 2: 0.9, 3: 0.6}
BASE_WEIGHT = 0.8


#: Keywords that stand as whole words only; others can go on, as gpl does in gplv3.
_WHOLE = {r.keyword for r in RULES if len(r.keyword) <= 5 and not r.keyword.endswith("gpl")} - {"asl", "mpl", "cddl", "eupl", "wtfpl", "rail", "cc0", "ccby", "cc by"}


def _keyword(keyword: str) -> str:
    """A search for a keyword in raw text."""
    return f"[{GAP}]+".join(keyword.split(" ")) + (f"(?![^{GAP}])" if keyword in _WHOLE else "")


def _any_keyword() -> str:
    """One search of a raw text. Keywords are gathered by their first letters, so that most words fail at once; (?i)
    knows A-Z alone."""
    found: dict[str, set[str]] = {}
    for word in {r.keyword for r in RULES} | {phrase for phrase, _ in BASE}:
        found.setdefault(word[0], set()).add(_keyword(word)[1:])
    letters = sorted(found)
    branches = "|".join(f"{a}(?:{'|'.join(sorted(found[a]))})" for a in letters)
    return f"(?i)(?<![^{GAP}])(?=[{''.join(letters)}])(?:{branches})"


ANY_KEYWORD = _any_keyword()


def _line(text: Column) -> Column:
    """The words of a text, with a space before and after each."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.array_join(F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != ""), " "), F.lit(" "))


def _n_words(line: Column) -> Column:
    """Words of a piece of such a line."""
    return F.length(F.regexp_replace(line, "[^ ]+", "x")) - F.length(F.regexp_replace(line, "[^ ]+", ""))


def _count(text: Column) -> Column:
    """Words of a raw text: what gaps part, without an empty first or last piece."""
    blank = lambda x: F.when(x == "", 1).otherwise(0)
    n = lambda a: F.size(a) - blank(F.element_at(a, 1)) - F.when(F.size(a) > 1, blank(F.element_at(a, -1))).otherwise(0)
    return F.element_at(F.transform(F.array(F.split(text, f"[{GAP}]+")), n), 1).cast("long")


def _places(line: Column, pattern: Column) -> Column:
    """array<struct<start, stop>>: intervals of words that ``pattern`` matches."""
    pattern = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    hits = F.regexp_extract_all(line, pattern, F.lit(0))
    sizes = F.zip_with(F.slice(F.split(line, pattern), F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(_n_words(g).alias("gap"), _n_words(h).alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["hit"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["hit"]).alias("stop")))).alias("out"))
    return F.aggregate(sizes, start, step)["out"]


def _detections(line: Column, rules: list[Rule]) -> Column:
    """array<struct<start, back, level, rank>>, sorted; back is minus the end, so that the longer of two that start together comes first."""
    table = F.array(*[F.struct(F.lit(f" {r.keyword}{' ' * (r.keyword in _WHOLE)}").alias("keyword"), F.lit(r.pattern).alias("pattern"), F.lit(r.level).alias("level"), F.lit(r.rank).alias("rank")) for r in rules])
    live = F.filter(table, lambda r: F.contains(line, r["keyword"]))
    found = F.transform(live, lambda r: F.transform(_places(line, r["pattern"]), lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("back"), r["level"].alias("level"), r["rank"].alias("rank"))))
    return F.array_sort(F.flatten(found))


def _kept(detections: Column) -> Column:
    """Those that no detection of the same or a better class contains."""
    kind = "array<struct<start:int,back:int,level:int,rank:int>>"
    start = F.struct(*(F.lit(-1).alias(f"end{k}") for k in (1, 2, 3)), F.array().cast(kind).alias("out"))

    def step(acc, x):
        stop = -x["back"]
        covered = F.greatest(acc["end1"], F.when(x["level"] >= 2, acc["end2"]).otherwise(-1), F.when(x["level"] >= 3, acc["end3"]).otherwise(-1)) >= stop
        return F.struct(*(F.when(x["level"] == k, F.greatest(acc[f"end{k}"], stop)).otherwise(acc[f"end{k}"]).alias(f"end{k}") for k in (1, 2, 3)), F.when(covered, acc["out"]).otherwise(F.concat(acc["out"], F.array(x))).alias("out"))

    return F.aggregate(detections, start, step)["out"]


def scan(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score and detections to ``docs``.

    detections: array<struct<start, stop, level, label>> in words. Null and empty texts have no words and no labels
    (empty strings), null places and score 0. Rows are independent of each other, so repeated rows get equal results. Of
    detections with one interval and class, that of the earlier rule stays. Other columns stay, but for those that have
    the name of a new one: the new one takes their place.
    """
    docs = C.without(docs, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
    of_words, of_base_places, of_kept = C.free(docs.columns, "words", "base", "kept")
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("*", _count(raw).alias("n_words"), F.when(F.regexp_like(raw, F.lit(ANY_KEYWORD)), _line(raw)).alias(of_words))
    line = F.col(of_words)
    names = F.array(*[F.lit(r.label) for r in rules])

    def base_places(phrase: str, label: str) -> Column:
        return F.transform(_places(line, F.lit(phrase)), lambda x: F.struct(x["start"].alias("start"), F.lit(label).alias("label")))

    base = F.flatten(F.array(*[base_places(phrase, label) for phrase, label in BASE]))
    rows = rows.withColumn(of_base_places, F.when(line.isNotNull(), base)).withColumn(of_kept, F.when(line.isNotNull(), _kept(_detections(line, rules))))
    label_of = lambda x: F.element_at(names, x["rank"] + 1)
    of_base = F.transform(of_base_places, lambda x: x["label"])
    joined = lambda labels: F.coalesce(F.array_join(F.array_sort(F.array_distinct(labels)), ","), F.lit(""))
    best = F.array_min(F.transform(of_kept, lambda x: x["level"]))
    weight = F.when(best == 1, WEIGHT[1]).when(best == 2, WEIGHT[2]).when(best == 3, WEIGHT[3]).otherwise(0.0)
    return rows.withColumns(
        {
            "n_base": F.when(line.isNull(), F.lit(0)).otherwise(F.size(of_base_places)).cast("long"),
            "first_word": F.array_min(F.transform(of_base_places, lambda x: x["start"])).cast("long"),
            "last_word": F.array_max(F.transform(of_base_places, lambda x: x["start"])).cast("long"),
            "base_labels": joined(of_base),
            "labels": joined(F.concat(of_base, F.transform(of_kept, label_of))),
            "score": F.greatest(weight, F.when(F.size(of_base_places) > 0, BASE_WEIGHT).otherwise(0.0)),
            "detections": F.transform(of_kept, lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("stop"), x["level"].alias("level"), label_of(x).alias("label"))),
        }
    ).drop(of_words, of_base_places, of_kept)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
