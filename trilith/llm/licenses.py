"""Operator 4, license scans by ordered signature rules, in DataFrame functions only.

Rules are regexes over the words of a text, each with a label, a priority and a weight, and gated by keywords: a
text with none of a rule's keywords never meets its regex (every alternative holds one), and most texts meet none.
Names of licences stand in five forms, from a bare mention to a grant; sentences of licences are rules of their own. A detection inside another one of the
same or a higher priority is suppressed, so `licensed under the apache license version 2 0` isn't also a bare mention.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read
from .native import let, matches

# The phrases and labels of the contract.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: (label, keywords with | between, the names of a licence in words: lower case, one space between, no punctuation).
FAMILIES = (
    ("agpl-3.0", "affero|agpl", "(?:gnu )?affero (?:gpl|general public licen[cs]e)(?: (?:version |v)?3(?: 0)?)?|agpl ?v?3?"),
    ("lgpl-2.1", "lgpl|lesser|library", "(?:gnu )?(?:lgpl|(?:lesser|library) (?:gpl|general public licen[cs]e)) ?(?:version |v)?2 1(?: or later)?"),
    ("lgpl-3.0", "lgpl|lesser", "(?:gnu )?(?:lgpl|lesser (?:gpl|general public licen[cs]e)) ?(?:version |v)?3(?: 0)?(?: or later)?"),
    ("lgpl", "lgpl|lesser|library", "(?:gnu )?(?:lgpl|(?:lesser|library) (?:gpl|general public licen[cs]e))(?: (?:version |v)?2(?: 0)?)?"),
    ("gpl-1.0", "general public", "(?:gnu )?general public licen[cs]e (?:version |v)1(?: 0)?"),
    ("gpl-2.0", "general public", "(?:gnu )?general public licen[cs]e (?:version |v)2(?: 0)?(?: or later)?"),
    ("gpl-3.0", "general public", "(?:gnu )?general public licen[cs]e (?:version |v)3(?: 0)?(?: or later)?"),
    ("gpl", "gpl", "(?:gnu )?gpl(?: ?v?[23](?: 0)?)?(?: or later)?"),
    ("gpl", "general public", "(?:gnu )?general public licen[cs]e"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation licen[cs]e(?: (?:version |v)?1 [1-3])?"),
    ("gfdl", "gfdl", "(?:gnu )?gfdl(?: 1 [1-3])?"),
    ("mit-0", " mit ", "mit 0(?: licen[cs]e)?|mit no attribution(?: licen[cs]e)?"),
    ("mit", " mit ", "mit (?:x11 )?licen[cs]e|mit x11"),
    ("x11", "x11|x consortium", "x11 licen[cs]e|x consortium licen[cs]e"),
    ("apache-2.0", "apache", "apache(?: software)? licen[cs]e(?: (?:version |v)?2(?: 0)?)?|apache 2(?: 0)?"),
    ("apache-1.1", "apache", "apache(?: software)? licen[cs]e (?:version |v)?1 1"),
    ("apache-1.0", "apache", "apache(?: software)? licen[cs]e (?:version |v)?1 0"),
    ("apache-2.0", " asl", "asl ?2(?: 0)?"),
    ("0bsd", "0bsd|zero clause", "0bsd|(?:bsd )?zero clause bsd(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", "(?:original|old|four clause|4 clause) bsd licen[cs]e|bsd 4 clause(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd", "(?:simplified|freebsd|two clause|2 clause) bsd licen[cs]e|bsd 2 clause(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", "(?:new|modified|revised|three clause|3 clause) bsd licen[cs]e|bsd 3 clause(?: licen[cs]e)?"),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e"),
    ("isc", " isc ", "isc licen[cs]e"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e"),
    ("mpl-1.1", "mozilla", "mozilla public licen[cs]e (?:version |v)?1 1"),
    ("mpl-2.0", "mozilla", "mozilla public licen[cs]e(?: (?:version |v)?2(?: 0)?)?"),
    ("mpl-1.1", " mpl", "mpl ?(?:version |v)?1 1"),
    ("mpl-2.0", " mpl", "mpl ?(?:version |v)?2(?: 0)?"),
    ("mpl", " mpl ", "mpl licen[cs]e|licen[cs]e mpl"),
    ("epl-1.0", " epl|eclipse", "epl ?(?:version |v)?1(?: 0)?|eclipse public licen[cs]e (?:version |v)?1(?: 0)?"),
    ("epl-2.0", " epl|eclipse", "epl ?(?:version |v)?2(?: 0)?|eclipse public licen[cs]e (?:version |v)?2(?: 0)?"),
    ("edl", "eclipse distribution", "eclipse distribution licen[cs]e(?: (?:version |v)?1(?: 0)?)?"),
    ("epl", "eclipse", "eclipse public licen[cs]e(?: (?:version |v)?[12](?: 0)?)?"),
    ("cddl", "common development", "common development and distribution licen[cs]e(?: (?:version |v)?1 [01])?"),
    ("cddl", " cddl ", "cddl(?: (?:version |v)?1(?: [01])?)?"),
    ("cpal", "common public attribution", "common public attribution licen[cs]e(?: (?:version )?1(?: 0)?)?"),
    ("cpl", "common public", "common public licen[cs]e(?: (?:version |v)?1(?: 0)?)?"),
    ("eupl", "european union", "european union public licen[cs]e(?: (?:version |v)?1 [12])?"),
    ("eupl", " eupl ", "eupl(?: (?:version |v)?1 [12])?"),
    ("cecill", "cecill", "cecill(?: [abc])?(?: (?:version |v)?[12](?: [01])?)?(?: licen[cs]e)?"),
    ("artistic-2.0", "artistic", "artistic licen[cs]e (?:version |v)?2(?: 0)?"),
    ("artistic", "artistic", "(?:perl )?artistic licen[cs]e(?: (?:version |v)?[12](?: 0)?)?"),
    ("boost", "boost", "boost software licen[cs]e(?: (?:version |v)?1(?: 0)?)?"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("python", "python|psf", "python(?: software foundation)? licen[cs]e|psf licen[cs]e"),
    ("php", " php ", "php licen[cs]e(?: (?:version |v)?3 01?)?"),
    ("postgresql", "postgresql", "postgresql licen[cs]e"),
    ("openssl", "openssl", "openssl licen[cs]e"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e"),
    ("ofl", "open font", "(?:sil )?open font licen[cs]e(?: (?:version |v)?1 [01])?"),
    ("ofl", " ofl ", "(?:sil )?ofl(?: (?:version |v)?1 [01])?"),
    ("odbl", "open database|odbl", "open database licen[cs]e|odc odbl"),
    ("odc-by", "open data", "open data commons attribution licen[cs]e"),
    ("odc-pddl", "public domain dedication", "(?:open data commons )?public domain dedication and licen[cs]e"),
    ("odc-pddl", " pddl ", "(?:odc )?pddl(?: 1 0)?"),
    ("odc-by", "odc by", "odc by(?: 1 0)?"),
    ("cdla-permissive", "cdla|community data", "cdla permissive(?: [12] 0)?|community data licen[cs]e agreement permissive"),
    ("cdla-sharing", "cdla|community data", "cdla sharing(?: 1 0)?|community data licen[cs]e agreement sharing"),
    ("ogl", "open government", "open government licen[cs]e(?: v?[1-3](?: 0)?)?"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "commons zero", "creative commons zero"),
    ("cc-by-nc-nd", " nd ", "cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", " sa ", "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", " nc ", "cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", " nd ", "cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", " sa ", "cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc by", "cc by(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "commercial", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: licen[cs]e)?(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "commercial", "creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?(?: [1-4] [05])?"),
    ("cc-by-sa", "share", "creative commons attribution share ?alike(?: licen[cs]e)?(?: [1-4] [05])?"),
    ("cc-by-nc", "commercial", "creative commons attribution non ?commercial(?: licen[cs]e)?(?: [1-4] [05])?"),
    ("cc-by-nd", "deriv", "creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: licen[cs]e)?(?: [1-4] [05])?"),
    ("cc-by", "creative commons", "creative commons attribution(?: licen[cs]e)?(?: [1-4] [05])?"),
    ("cc", "creative commons", "creative commons(?: licen[cs]e)?"),
    ("elastic", "elastic", "elastic licen[cs]e(?: 2 0)?"),
    ("sspl", "server side", "server side public licen[cs]e"),
    ("busl", "business source", "business source licen[cs]e(?: 1 1)?"),
    ("isc", "internet s", "internet (?:systems|software) consortium licen[cs]e"),
    ("ncsa", "ncsa", "(?:university of illinois )?(?:uiuc )?ncsa(?: open source)? licen[cs]e"),
    ("upl", "universal permissive", "universal permissive licen[cs]e(?: (?:version |v)?1(?: 0)?)?"),
    ("ruby", " ruby ", "ruby licen[cs]e|ruby s licen[cs]e"),
    ("perl", " perl ", "same terms as perl(?: itself)?|perl 5 licen[cs]e"),
    ("vim", " vim ", "vim licen[cs]e"),
    ("tcl", " tcl ", "tcl(?: tk)? licen[cs]e"),
    ("curl", " curl ", "curl licen[cs]e"),
    ("libpng", "libpng", "libpng licen[cs]e(?: (?:version )?2)?"),
    ("ijg", " ijg |independent jpeg", "ijg licen[cs]e|independent jpeg group licen[cs]e"),
    ("info-zip", "info zip", "info zip licen[cs]e"),
    ("unicode", "unicode", "unicode(?: inc)? licen[cs]e(?: agreement)?"),
    ("w3c", " w3c ", "w3c(?: software(?: notice(?: and)?)?)? licen[cs]e"),
    ("afl", "academic free", "academic free licen[cs]e(?: (?:version |v)?[123](?: [01])?)?"),
    ("osl", "open software", "open software licen[cs]e(?: (?:version |v)?[123](?: [01])?)?"),
    ("rpl", "reciprocal public", "reciprocal public licen[cs]e(?: 1 [15])?"),
    ("qpl", "q public", "q public licen[cs]e(?: 1 0)?"),
    ("ipl", "ibm public", "ibm public licen[cs]e(?: (?:version |v)?1(?: 0)?)?"),
    ("sissl", "sun industry", "sun industry standards source licen[cs]e"),
    ("apsl", "apple public", "apple public source licen[cs]e(?: (?:version )?2(?: 0)?)?"),
    ("zpl", "zope", "zope public licen[cs]e(?: (?:version )?2(?: [01])?)?"),
    ("json", " json ", "json licen[cs]e"),
    ("beerware", "beerware|beer ware", "beer ?ware(?: licen[cs]e)?"),
    ("hippocratic", "hippocratic", "hippocratic licen[cs]e(?: [123](?: [01])?)?"),
    ("mulan", "mulan", "mulan (?:psl|permissive software licen[cs]e)(?: ?v?[12])?"),
    ("blueoak", "blue oak", "blue oak model licen[cs]e(?: 1 0 0)?"),
    ("parity", "parity public", "parity public licen[cs]e(?: [67](?: 0)*)?"),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter) licen[cs]e(?: 1 0(?: 0)?)?"),
    ("openrail", "openrail|open rail|responsible ai", "(?:creativeml )?open ?rail(?: m)?(?: licen[cs]e)?|responsible ai licen[cs]e"),
    ("llama-community", "llama", "llama [234](?: [0-9])? community licen[cs]e(?: agreement)?"),
    ("classpath", "classpath", "(?:with )?(?:the )?(?:gnu )?classpath exception"),
    ("freetype", "freetype", "freetype(?: project)? licen[cs]e"),
    ("oracle-binary", "oracle", "oracle binary code licen[cs]e(?: agreement)?"),
    ("ms-other", "microsoft", "microsoft (?:limited|research|software) (?:public |shared source )?licen[cs]e(?: terms)?"),
)
#: (priority, weight, what is put around a name): a grant tells more than a mention.
FORMS = (
    (5, 1.0, "spdx licen[cs]e identifier (?:{})"),
    (4, 0.95, "(?:released|licen[cs]ed|distributed|redistributed|published|provided|made available|available|issued|shared|covered) (?:under|by|on|in accordance with) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{})"),
    (4, 0.9, "(?:subject to|governed by|use of this \\S+ is governed by|according to) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{})"),
    (3, 0.8, "(?:see|read|copy of|text of|terms of|conditions of|version of) (?:the )?(?:full )?(?:{})"),
    (1, 0.5, "(?:{})"),
)
#: Rules without a licence's name: (label, priority, weight, keywords, regex).
OTHERS = (
    ("reserved", 3, 0.9, "reserved", "(?:all|some|no) rights(?: are)? reserved"),
    ("reserved", 4, 0.95, "rights reserved", "copyright (?:c )?(?:\\d{4} )*(?:\\S+ ){0,6}?all rights reserved"),
    ("copyright", 2, 0.6, "copyright", "copyright (?:c )?(?:19|20)\\d\\d(?: (?:19|20)\\d\\d)*"),
    ("copyright", 1, 0.4, "copyright", "(?:copyright|copyrighted) (?:notice|holders?|owners?|material|work|protected|by)"),
    ("public-domain", 3, 0.8, "public domain", "(?:in|into|to|as) the public domain"),
    ("public-domain", 1, 0.4, "public domain", "public domain"),
    ("proprietary", 3, 0.8, "proprietary", "(?:proprietary and confidential|confidential and proprietary|proprietary licen[cs]e)"),
    ("proprietary", 3, 0.8, "without", "(?:reproduction|redistribution|copying|distribution) (?:is )?(?:strictly )?prohibited without"),
    ("proprietary", 3, 0.8, "written permission", "without (?:the )?(?:express |prior )*written permission"),
    ("permissive", 3, 0.8, "permission is hereby granted", "permission is hereby granted(?: free of charge)?"),
    ("permissive", 3, 0.8, "redistribution and use", "redistribution and use in source and binary forms"),
    ("disclaimer", 2, 0.5, "as is", "provided (?:by \\S+ )?as is"),
    ("disclaimer", 2, 0.5, "without warrant", "without warrant(?:y|ies) of any kind"),
    ("eula", 3, 0.8, "user licen", "end user licen[cs]e agreement"),
    ("trademark", 1, 0.3, "trademark", "(?:registered )?trademarks? of"),
    # sentences of the licences themselves
    ("mit", 5, 0.95, "deal in the software", "to deal in the software without restriction"),
    ("mit", 4, 0.9, "substantial portions", "included in all copies or substantial portions of the software"),
    ("gpl", 4, 0.9, "is free software", "this (?:program|library|file|software|package) is free software you can redistribute it and or modify it"),
    ("gpl", 4, 0.9, "received a copy of the gnu general", "should have received a copy of the gnu general public licen[cs]e"),
    ("lgpl", 5, 0.95, "received a copy of the gnu l", "should have received a copy of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl-3.0", 5, 0.95, "received a copy of the gnu affero", "should have received a copy of the gnu affero general public licen[cs]e"),
    ("gpl", 4, 0.9, "gnu org", "(?:www )?gnu org licen[cs]es(?: (?:old licenses )?(?:gpl|lgpl|agpl|fdl)(?: [123] [01])?)?"),
    ("apache-2.0", 5, 0.95, "except in compliance with the licen", "you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", 4, 0.9, "apache org", "(?:www )?apache org licenses(?: license 2 0)?"),
    ("bsd-2-clause", 4, 0.8, "redistributions of source", "redistributions of source code must retain the above copyright notice"),
    ("bsd-2-clause", 4, 0.8, "redistributions in binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 5, 0.95, "endorse or promote", "neither the names? of (?:\\S+ ){1,16}may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 5, 0.95, "advertising materials", "all advertising materials mentioning features or use of this software must display"),
    ("isc", 5, 0.95, "with or without fee", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", 5, 0.95, "origin of this software", "the origin of this software must not be misrepresented"),
    ("boost", 4, 0.9, "boost org", "(?:www )?boost org license 1 0 txt"),
    ("unlicense", 5, 0.95, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", 5, 0.95, "do what the fuck", "do what the fuck you want to(?: public licen[cs]e)?"),
    ("mpl-2.0", 5, 0.95, "source code form is subject", "this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl-2.0", 4, 0.9, "mozilla org", "(?:www )?mozilla org (?:en us )?mpl(?: 2 0)?"),
    ("cc-by-nc-nd", 4, 0.9, "creativecommons org", "creativecommons org licenses by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", 4, 0.9, "creativecommons org", "creativecommons org licenses by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", 4, 0.9, "creativecommons org", "creativecommons org licenses by nc(?: [1-4] [05])?"),
    ("cc-by-nd", 4, 0.9, "creativecommons org", "creativecommons org licenses by nd(?: [1-4] [05])?"),
    ("cc-by-sa", 4, 0.9, "creativecommons org", "creativecommons org licenses by sa(?: [1-4] [05])?"),
    ("cc-by", 4, 0.9, "creativecommons org", "creativecommons org licenses by(?: [1-4] [05])?"),
    ("cc0", 4, 0.9, "creativecommons org", "creativecommons org publicdomain zero(?: 1 0)?"),
    ("mit", 4, 0.9, "opensource org", "opensource org licenses mit"),
    ("bsd", 4, 0.9, "opensource org", "opensource org licenses bsd(?: license| [234] clause)?"),
    ("apache-2.0", 4, 0.9, "opensource org", "opensource org licenses apache 2 0"),
    ("ofl", 4, 0.9, "sil org", "(?:scripts )?sil org ofl"),
    ("public-domain", 4, 0.9, "waived all copyright", "(?:has|have) waived all copyright and related (?:or|and) neighbou?ring rights"),
    ("public-domain", 4, 0.9, "public domain", "dedicated (?:\\S+ ){0,3}to the public domain"),
    ("non-commercial", 3, 0.7, "commercial", "(?:for )?non ?commercial (?:use|purposes?)(?: only)?"),
    ("research-only", 3, 0.7, "for academic|for research|for educational", "for (?:academic|research|educational) (?:use|purposes?) only"),
    ("no-derivatives", 3, 0.7, "derivative works", "(?:no|without) derivative works"),
    ("no-training", 3, 0.8, "be used to train|be used for train", "not be used (?:to|for) train(?:ing)? (?:of )?(?:machine learning|ai|artificial intelligence)(?: models?| systems?)?"),
    ("no-training", 3, 0.8, "data mining", "text and data mining (?:is |are )?(?:not (?:permitted|allowed)|prohibited|reserved)"),
    ("proprietary", 3, 0.8, "trade secret", "trade secrets? of"),
    ("proprietary", 3, 0.8, "unauthori", "unauthori[sz]ed (?:copying|reproduction|distribution|use)(?: of this (?:file|software|document|work))?"),
    ("proprietary", 3, 0.8, "may not be", "may not be (?:reproduced|copied|published|distributed|redistributed|sold)"),
    ("terms", 2, 0.5, "terms of", "(?:agree to|accept|subject to) (?:the |our |these )?terms of (?:use|service)"),
    ("dual", 2, 0.5, "dual", "dual(?:ly)? licen[cs]ed(?: under)?"),
    ("patent-grant", 2, 0.6, "patent licen", "(?:royalty free|irrevocable|worldwide|non exclusive|perpetual) (?:\\S+ ){0,6}patent licen[cs]e"),
    ("disclaimer", 2, 0.5, "in no event", "in no event shall (?:\\S+ ){1,14}be liable"),
    ("disclaimer", 2, 0.5, "implied warrant", "(?:express or |any |all )?implied warrant(?:y|ies)"),
)
#: A text with none of these meets no rule.
GATES = (
    "licen", "copyright", "reserved", "spdx", "gpl", "gfdl", " mit ", "apache", "bsd", "wtfpl", "cc0", "cc by", "commons", "domain", "proprietary", "prohibited", "permission", "redistribution",
    " as is ", "warrant", "trademark", " x11 ", "odbl", " asl", " mpl", " epl", " cddl ", " eupl ", "cecill", " ofl ", " pddl ", "odc by", "cdla", " perl ", "beer", "mulan", "open rail", "openrail",
    "classpath", "deal in the software", "substantial portions", "free software", "endorse or promote", "advertising materials", "origin of this software", "do what the fuck", "mozilla org",
    "sil org", "commercial", "for academic", "for research", "for educational", "derivative works", "be used to train", "be used for train", "data mining", "trade secret", "unauthori", "may not be",
    "terms of", "in no event",
)


class Rule(NamedTuple):
    label: str
    priority: int
    weight: float
    keywords: tuple[str, ...]
    regex: str


def rules() -> list[Rule]:
    """All rules in order: of equal detections the earlier rule's stays."""
    named = [Rule(label, p, w, tuple(keywords.split("|")), form.format(names)) for p, w, form in FORMS for label, keywords, names in FAMILIES]
    return sorted([*named, *(Rule(label, p, w, tuple(keywords.split("|")), regex) for label, p, w, keywords, regex in OTHERS)], key=lambda r: -r.priority)


def normal(text: Column) -> Column:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, a space before, between and after; one space if there are none.

    lower() maps other letters too, which moves no word and no phrase but for two letters that become ASCII ones.
    """
    low = F.when(F.contains(text, F.lit("K")) | F.contains(text, F.lit("İ")), F.lower(F.translate(text, "Kİ", "éé"))).otherwise(F.lower(text))
    spaced = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return let(spaced, lambda s: F.when(s == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), s, F.lit(" "))))


def spaces(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


def _hits(norm: Column) -> Column:
    """Detections of a gated text: start, end (code points of the normal text), priority, rule, label, weight."""
    groups: dict[tuple[str, ...], list[tuple[int, Rule]]] = {}
    for i, r in enumerate(rules()):
        groups.setdefault(r.keywords, []).append((i, r))
    rule = lambda i, r: F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.weight).alias("weight"), F.lit(f"(?<= )(?:{r.regex})(?= )").alias("regex"), F.lit(i).alias("rule"))
    # keywords are looked for once for all rules behind them
    array = F.array(*(F.struct(F.array(*map(F.lit, keywords)).alias("keywords"), F.array(*(rule(i, r) for i, r in some)).alias("rules")) for keywords, some in groups.items()))
    met = F.flatten(F.transform(F.filter(array, lambda g: F.exists(g["keywords"], lambda k: F.contains(norm, k))), lambda g: g["rules"]))
    one = lambda r: F.transform(matches(norm, r["regex"]), lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("end"), (-r["priority"]).alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"), r["weight"].alias("weight")))
    # by start, then the longest, the highest priority and the first rule: whatever contains another comes before it
    return F.array_sort(F.flatten(F.transform(met, one)))


HITS = "array<struct<start:bigint,end:bigint,priority:int,rule:int,label:string,weight:double>>"


def _resolved(hits: Column) -> Column:
    """labels and score of the detections that no earlier one of the same or a higher priority contains, in one pass."""
    first = F.struct(F.array_repeat(F.lit(-1).cast("long"), 6).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(1.0).alias("miss"))

    def step(s: Column, h: Column) -> Column:
        kept = F.get(s["ends"], -h["priority"]) < -h["end"]
        # ends[p]: how far detections of priority p and above reach
        ends = F.transform(s["ends"], lambda e, p: F.when(p <= -h["priority"], F.greatest(e, -h["end"])).otherwise(e))
        new = kept & ~F.array_contains(s["labels"], h["label"])
        return F.struct(F.when(kept, ends).otherwise(s["ends"]).alias("ends"), F.when(new, F.concat(s["labels"], F.array(h["label"]))).otherwise(s["labels"]).alias("labels"), F.when(new, s["miss"] * (1 - h["weight"])).otherwise(s["miss"]).alias("miss"))

    return F.aggregate(hits, first, step)


def _gated(norm: Column) -> Column:
    gate = F.lit(False)
    for g in GATES:
        gate = gate | F.contains(norm, F.lit(g))
    return gate


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of docs.

    score is 1 less the product of 1 - weight over the labels that rules gave; 0 without any (a base label alone
    scores 0.5). A null or empty text has no words and no labels. Whole texts count; rows that repeat a doc_id stay; a
    null doc_id stays null; other columns are ignored; an empty table gives an empty result.
    """
    norm = F.col("norm")
    first, last, count, found = [], [], [], []
    for phrase, label in BASE:
        there = F.contains(norm, F.lit(f" {phrase} "))
        size = phrase.count(" ") + 1
        first.append(F.when(there, spaces(F.substring_index(norm, f" {phrase} ", 1))))
        last.append(F.when(there, spaces(norm) - spaces(F.substring_index(norm, f" {phrase} ", -1)) - 1 - size))
        count.append(F.when(there, F.regexp_count(norm, F.lit(f" {phrase}(?= )")).cast("long")).otherwise(F.lit(0).cast("long")))
        found.append(F.when(there, F.lit(label)))
    base = docs.select("doc_id", normal(F.coalesce("text", F.lit(""))).alias("norm"))
    base = base.select("doc_id", (spaces(norm) - 1).alias("n_words"), sum(count[1:], count[0]).alias("n_base"), F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"), F.array_sort(F.array_compact(F.array(*found))).alias("base"), F.when(_gated(norm), let(_hits(norm), _resolved)).alias("method"))
    labels = F.array_sort(F.array_union("base", F.coalesce(F.col("method.labels"), F.array().cast("array<string>"))))
    score = F.greatest(1 - F.coalesce(F.col("method.miss"), F.lit(1.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0))
    return base.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def detections(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, label, priority, weight, first_word, end_word: what rules found after suppression, a row each."""
    norm = docs.select("doc_id", F.xxhash64("text").alias("key"), normal(F.coalesce("text", F.lit(""))).alias("norm")).where(_gated(F.col("norm")))
    hits = norm.select("doc_id", "key", "norm", F.explode(_hits(F.col("norm"))).alias("h")).select("doc_id", "key", F.col("h.label").alias("label"), (-F.col("h.priority")).alias("priority"), F.col("h.weight").alias("weight"), "h.start", (-F.col("h.end")).alias("end"), "h.rule", (spaces(F.substring(F.col("norm"), F.lit(1), F.col("h.start").cast("int"))) - 1).alias("first_word"), spaces(F.substring(F.col("norm"), F.lit(1), (-F.col("h.end")).cast("int"))).alias("end_word"))
    w = Window.partitionBy("doc_id", "key").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    kept = F.lit(True)
    for p in range(1, 6):
        kept = kept & ((F.col("priority") > p) | F.coalesce(F.max(F.when(F.col("priority") >= p, F.col("end"))).over(w) < F.col("end"), F.lit(True)) | (F.col("priority") != p))
    return hits.withColumn("kept", kept).where("kept").select("doc_id", "label", "priority", "weight", "first_word", "end_word")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
