"""License scans by ordered signature rules, in DataFrame functions only.

A text is lower-cased (A-Z) and reduced to its words. Texts that hold an anchor keyword are looked at
further: at each place of an anchor where any rule matches, the rules filed under that word are matched one by one
against the words that follow. A place keeps its longest match, then the rule that comes first; matches inside another match are
suppressed. What a rule is worth and its label come from the rule list, in order of priority.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: License families: label, the words of the name as a regex, version regex or None.
FAMILIES = [
    ("agpl", "(gnu )?affero general public licen[sc]e", "[123]( 0)?"),
    ("lgpl", "(gnu )?(lesser|library) general public licen[sc]e", "[23]( [01])?"),
    ("gpl", "(gnu )?general public licen[sc]e", "[123]( 0)?"),
    ("gfdl", "gnu free documentation licen[sc]e", "1 [123]"),
    ("apache", "apache( software)? licen[sc]e", "[12]( [01])?"),
    ("mit", "(mit|expat|x11) licen[sc]e", None),
    ("bsd", "(new |simplified |modified |original |[0234] clause )?bsd( [0234] clause)? licen[sc]e", None),
    ("mpl", "mozilla public licen[sc]e", "[12]( [01])?"),
    ("epl", "eclipse public licen[sc]e", "[12]( 0)?"),
    ("eupl", "european union public licen[sc]e", "1 [012]"),
    ("cddl", "common development and distribution licen[sc]e", "1 [01]"),
    ("cpl", "common public licen[sc]e", "1 0"),
    ("isc", "isc licen[sc]e", None),
    ("zlib", "zlib licen[sc]e", None),
    ("boost", "boost software licen[sc]e", "1 0"),
    ("artistic", "artistic licen[sc]e", "[12]( 0)?"),
    ("python", "python software foundation licen[sc]e", "2( 0)?"),
    ("unlicense", "unlicen[sc]e", None),
    ("wtfpl", "wtf public licen[sc]e", "2"),
    ("osl", "open software licen[sc]e", "[123]( 0)?"),
    ("afl", "academic free licen[sc]e", "[123]( 0)?"),
    ("ms-pl", "microsoft public licen[sc]e", None),
    ("ofl", "(sil )?open font licen[sc]e", "1 [01]"),
    ("odbl", "open database licen[sc]e", "1 0"),
    ("ncsa", "(university of illinois )?ncsa( open source)? licen[sc]e", None),
    ("postgresql", "postgresql licen[sc]e", None),
    ("openssl", "openssl licen[sc]e", None),
    ("php", "php licen[sc]e", "3( 0[01])?"),
    ("ruby", "ruby licen[sc]e", None),
    ("qpl", "q public licen[sc]e", "1 0"),
    ("cecill", "cecill( free software)? licen[sc]e", "[12]( [01])?"),
    ("nasa", "nasa open source agreement", "1 3"),
    ("cc-by-nc-nd", "(cc|creative commons)( attribution)? (by )?(nc|non ?commercial) (nd|no derivatives|no derivs)", "[1234]( [05])?"),
    ("cc-by-nc-sa", "(cc|creative commons)( attribution)? (by )?(nc|non ?commercial) (sa|share ?alike)", "[1234]( [05])?"),
    ("cc-by-nc", "(cc|creative commons)( attribution)? (by )?(nc|non ?commercial)", "[1234]( [05])?"),
    ("cc-by-nd", "(cc|creative commons)( attribution)? (by )?(nd|no derivatives|no derivs)", "[1234]( [05])?"),
    ("cc-by-sa", "(cc|creative commons)( attribution)? (by )?(sa|share ?alike)", "[1234]( [05])?"),
    ("cc0", "(cc0|cc zero|creative commons zero)", "1 0"),
    ("cc-by", "(cc by|creative commons attribution)", "[1234]( [05])?"),
]

#: Phrases that lead to a name, the weight of such a match, and single notices with their labels.
LEADS = [
    ("licen[sc]ed under( the)?( terms of( the)?)?", 1.0),
    ("(re)?distributed under( the)?( terms of( the)?)?", 1.0),
    ("released under( the)?( terms of( the)?)?", 1.0),
    ("(made )?available under( the)?( terms of( the)?)?", 0.95),
    ("published under( the)?( terms of( the)?)?", 0.95),
    ("subject to( the)?( terms of( the)?)?", 0.9),
    ("(see|refer to) the", 0.7),
    ("", 0.8),
]
NOTICES = [
    ("all rights reserved", "proprietary", 0.6),
    ("proprietary and confidential", "proprietary", 0.9),
    ("unauthorized (copying|use|distribution)", "proprietary", 0.7),
    ("public domain( dedication)?", "public-domain", 0.6),
    ("dedicated to the public domain", "public-domain", 0.9),
    ("permission is hereby granted free of charge", "mit", 0.9),
    ("redistribution and use in source and binary forms", "bsd", 0.9),
    ("permission to use copy modify and or distribute this software", "isc", 0.9),
    ("spdx licen[sc]e identifier [0-9a-z]+( [0-9]+){0,2}", "spdx", 1.0),
    ("copyright (c )?(19|20)[0-9]{2}", "copyright", 0.4),
    ("do what the fuck you want to", "wtfpl", 0.9),
    ("this is free and unencumbered software", "unlicense", 0.9),
]
_GNU = "( v(ersion)? ?[123]| [123])?( [01])?( or( any)? later( version)?| only)?"
#: Short names and identifiers: label, what is clear wherever it stands, what is clear only after "license" or as an SPDX id.
SHORT = [
    ("agpl", f"(gnu )?agpl(v[123])?{_GNU}", None),
    ("lgpl", f"(gnu )?lgpl(v[23])?{_GNU}", None),
    ("gpl", f"(gnu )?gpl(v[123])?{_GNU}", None),
    ("gfdl", f"(gnu )?gfdl(v1)?{_GNU}( [123])?", "gnu fdl"),
    ("apache", "apache (2 0|v2( 0)?|version 2( 0)?)", "(apache2|apache 2|apache 1 [01]|apache|asl 2( 0)?)"),
    ("mit", "mit 0", "(mit|expat|x11)"),
    ("bsd", "(bsd [01234] clause|[01234] clause bsd|0bsd)", "bsd"),
    ("mpl", "mpl(v[12])?( v(ersion)?)? ?[12]( [01])?", "(mplv[12]( [01])?|mpl[12]|mpl)"),
    ("epl", "epl( v(ersion)?)? [12]( 0)?", "(eplv[12]( 0)?|epl)"),
    ("eupl", "eupl( v(ersion)?)? 1 [012]", "(eupl|eupl12)"),
    ("cddl", "cddl( v(ersion)?)? 1 [01]", "cddl"),
    ("cpl", "cpl( v(ersion)?)? 1 0", "cpl"),
    ("isc", None, "isc"),
    ("zlib", None, "zlib"),
    ("boost", "bsl( v(ersion)?)? 1 0", "(boost|bsl)"),
    ("artistic", "artistic( v(ersion)?)? [12] 0", "artistic"),
    ("python", "psf( v(ersion)?)? 2( 0)?", "(psf|python 2 0)"),
    ("unlicense", None, "unlicense"),
    ("wtfpl", "wtfpl( v(ersion)? ?2| 2)?", None),
    ("osl", "osl( v(ersion)?)? [123] [01]", "osl"),
    ("afl", "afl( v(ersion)?)? [123] [012]", "afl"),
    ("ms-pl", None, "ms pl"),
    ("ofl", "ofl( v(ersion)?)? 1 [01]", "(ofl|sil ofl)"),
    ("odbl", "odbl( v(ersion)? ?1 0| 1 0)?", None),
    ("ncsa", None, "ncsa"),
    ("postgresql", None, "postgresql"),
    ("openssl", None, "openssl"),
    ("php", None, "php 3 0(1)?"),
    ("ruby", None, "ruby"),
    ("qpl", "qpl 1 0", "qpl"),
    ("cecill", "cecill( v(ersion)?)? [12]( [01])?", "(cecill|cecill [bc])"),
    ("nasa", "nasa 1 3", None),
    ("cc0", None, "cc0( 1 0)?"),
    ("cc-by-nc-nd", None, "cc by nc nd( [1234]( [05])?)?"),
    ("cc-by-nc-sa", None, "cc by nc sa( [1234]( [05])?)?"),
    ("cc-by-nc", None, "cc by nc( [1234]( [05])?)?"),
    ("cc-by-nd", None, "cc by nd( [1234]( [05])?)?"),
    ("cc-by-sa", None, "cc by sa( [1234]( [05])?)?"),
    ("cc-by", None, "cc by( [1234]( [05])?)?"),
]
#: Sentences of license texts and headers that don't give the license's name.
HEADERS = [
    ("you may not use this file except in compliance with the licen[sc]e", "apache", 0.9),
    ("this library is free software you can redistribute it and or modify", "lgpl", 0.9),
    ("this source code form is subject to the terms of the mozilla public", "mpl", 1.0),
    ("permission is hereby granted free of charge to any person or organization obtaining", "boost", 0.9),
    ("this software is provided as is without any express or implied warranty", "zlib", 0.8),
    ("this program and the accompanying materials are made available under", "epl", 0.8),
    ("to the extent possible under law", "cc0", 0.7),
    ("neither the name of", "bsd", 0.6),
    ("this product includes software developed by the openssl project", "openssl", 0.8),
    ("this product includes php software", "php", 0.8),
    ("permission to use copy modify and distribute this software and its documentation for any purpose without fee", "postgresql", 0.8),
    ("to deal with the software without restriction", "ncsa", 0.8),
]
#: Further licenses by name, a rule each: label and pattern.
NAMES = [
    ("aal", "attribution assurance licen[sc]e"),
    ("apl", "adaptive public licen[sc]e"),
    ("apsl", "apple public source licen[sc]e( [12]( [0-2])?)?"),
    ("beerware", "beer ?ware licen[sc]e"),
    ("bittorrent", "bittorrent open source licen[sc]e"),
    ("blueoak", "blue oak model licen[sc]e( 1 0 0)?"),
    ("busl", "business source licen[sc]e( 1 1)?"),
    ("catosl", "computer associates trusted open source licen[sc]e"),
    ("cdla", "community data licen[sc]e agreement( (permissive|sharing))?"),
    ("cern-ohl", "cern open hardware licen[sc]e( version 2)?( (permissive|weakly reciprocal|strongly reciprocal))?"),
    ("cpal", "common public attribution licen[sc]e"),
    ("cua", "cua office public licen[sc]e"),
    ("curl", "curl licen[sc]e"),
    ("d-fsl", "deutsche freie software lizenz"),
    ("dl-de", "datenlizenz deutschland( (zero|namensnennung))?( version)?( [12] 0)?"),
    ("dl-de", "data licen[sc]e germany( (zero|attribution))?( version)?( [12] 0)?"),
    ("ecl", "educational community licen[sc]e( [12] 0)?"),
    ("efl", "eiffel forum licen[sc]e( [12]( 0)?)?"),
    ("elastic", "elastic licen[sc]e( 2 0)?"),
    ("entessa", "entessa public licen[sc]e"),
    ("erlpl", "erlang public licen[sc]e( 1 1)?"),
    ("etalab", "licence ouverte( [12] 0)?"),
    ("etalab", "etalab open licen[sc]e( [12] 0)?"),
    ("eudatagrid", "eu datagrid software licen[sc]e"),
    ("fair", "fair licen[sc]e"),
    ("fal", "free art licen[sc]e( 1 3)?"),
    ("frameworx", "frameworx open licen[sc]e"),
    ("freetype", "freetype( project)? licen[sc]e"),
    ("gemma", "gemma terms of use"),
    ("hippocratic", "hippocratic licen[sc]e( [123] [01])?"),
    ("hpnd", "historical permission notice and disclaimer"),
    ("icu", "icu licen[sc]e"),
    ("ijg", "independent jpeg group"),
    ("imagemagick", "imagemagick licen[sc]e"),
    ("intel", "intel open source licen[sc]e"),
    ("ipa", "ipa font licen[sc]e"),
    ("ipl", "ibm public licen[sc]e( 1 0)?"),
    ("jam", "jam licen[sc]e"),
    ("json", "json licen[sc]e"),
    ("libpng", "libpng licen[sc]e( version 2)?"),
    ("llama", "llama( [23]( [123])?)? community licen[sc]e"),
    ("lpl", "lucent public licen[sc]e( 1 0[02]?)?"),
    ("lppl", "latex project public licen[sc]e( 1 [0-3][ac]?)?"),
    ("miros", "miros licen[sc]e"),
    ("motosoto", "motosoto( open source)? licen[sc]e"),
    ("ms-rl", "microsoft reciprocal licen[sc]e"),
    ("mulan", "mulan (permissive software|public) licen[sc]e"),
    ("multics", "multics licen[sc]e"),
    ("naumen", "naumen public licen[sc]e"),
    ("ngpl", "nethack general public licen[sc]e"),
    ("nokia", "nokia open source licen[sc]e"),
    ("nosl", "netizen open source licen[sc]e"),
    ("nposl", "non profit open software licen[sc]e( 3 0)?"),
    ("npl", "netscape public licen[sc]e( 1 [01])?"),
    ("oclc", "oclc research public licen[sc]e"),
    ("odc-by", "open data commons attribution licen[sc]e"),
    ("ogl", "open government licen[sc]e( v[123])?( [123] 0)?"),
    ("oldap", "openldap public licen[sc]e"),
    ("openrail", "(creativeml |bigscience )?open ?rail( m)?( licen[sc]e)?"),
    ("opl", "open publication licen[sc]e"),
    ("oset", "oset public licen[sc]e"),
    ("parity", "parity public licen[sc]e"),
    ("pddl", "public domain dedication and licen[sc]e"),
    ("polyform", "polyform (noncommercial|small business|shield|perimeter|strict|internal use) licen[sc]e"),
    ("prosperity", "prosperity public licen[sc]e"),
    ("rpl", "reciprocal public licen[sc]e( 1 [15])?"),
    ("rpsl", "realnetworks public source licen[sc]e"),
    ("rscpl", "ricoh source code public licen[sc]e"),
    ("sgi", "sgi free software licen[sc]e( b)?"),
    ("simpl", "simple public licen[sc]e( 2 0)?"),
    ("sissl", "sun industry standards source licen[sc]e"),
    ("sleepycat", "sleepycat licen[sc]e"),
    ("solderpad", "solderpad( hardware)? licen[sc]e"),
    ("spl", "sun public licen[sc]e( 1 0)?"),
    ("sspl", "server side public licen[sc]e( v1| version 1)?"),
    ("tapr-ohl", "tapr open hardware licen[sc]e"),
    ("tcl", "tcl tk licen[sc]e"),
    ("upl", "universal permissive licen[sc]e( 1 0)?"),
    ("vim", "vim licen[sc]e"),
    ("vsl", "vovida software licen[sc]e"),
    ("w3c", "w3c( software)?( notice and)? licen[sc]e"),
    ("watcom", "sybase open watcom public licen[sc]e"),
    ("xfree86", "xfree86 licen[sc]e( 1 1)?"),
    ("xnet", "x net licen[sc]e"),
    ("zpl", "zope public licen[sc]e( [12] [01])?"),
]
#: Further sentences of license texts, and what says how a text may be used without a license's name.
SENTENCES = [
    ("permission is granted to anyone to use this software for any purpose", "zlib", 0.9),
    ("this software is licensed as described in the file", "curl", 0.7),
    ("this program is free software you can redistribute it and or modify", "gpl", 0.9),
    ("you should have received a copy of the gnu general public", "gpl", 0.9),
    ("you should have received a copy of the gnu lesser general public", "lgpl", 0.9),
    ("you should have received a copy of the gnu library general public", "lgpl", 0.9),
    ("you should have received a copy of the gnu affero general public", "agpl", 0.9),
    ("this library is distributed in the hope that it will be useful", "lgpl", 0.7),
    ("this program is distributed in the hope that it will be useful", "gpl", 0.7),
    ("the above copyright notice and this permission notice shall be included", "mit", 0.9),
    ("the software is provided as is without warranty of any kind", "mit", 0.7),
    ("redistributions of source code must retain the above copyright notice", "bsd", 0.9),
    ("redistributions in binary form must reproduce the above copyright notice", "bsd", 0.9),
    ("this software is provided by the copyright holders and contributors as is", "bsd", 0.9),
    ("the contents of this file are subject to the mozilla public", "mpl", 1.0),
    ("the contents of this file are subject to the terms of the common development", "cddl", 1.0),
    ("the contents of this file are subject to the netscape public", "npl", 1.0),
    ("the contents of this file are subject to the sun public", "spl", 1.0),
    ("everyone is permitted to copy and distribute verbatim", "gpl", 0.7),
    ("this font software is licensed under the sil", "ofl", 1.0),
    ("reserved font name", "ofl", 0.6),
    ("as long as you retain this notice you can do whatever you want", "beerware", 0.9),
    ("the person who associated a work with this deed", "cc0", 0.9),
    ("waives all rights to the work worldwide", "cc0", 0.8),
    ("this work has been marked as dedicated to the public domain", "public-domain", 0.9),
    ("no copyright is claimed", "public-domain", 0.7),
    ("no known copyright restrictions", "public-domain", 0.8),
    ("anyone is free to copy modify publish use compile sell or distribute", "unlicense", 0.9),
    ("some rights reserved", "cc", 0.5),
    ("no rights reserved", "cc0", 0.7),
    ("attribution non ?commercial share ?alike", "cc-by-nc-sa", 0.7),
    ("attribution non ?commercial no ?derivatives", "cc-by-nc-nd", 0.7),
    ("attribution non ?commercial", "cc-by-nc", 0.6),
    ("attribution share ?alike", "cc-by-sa", 0.6),
    ("attribution no ?derivatives", "cc-by-nd", 0.6),
    ("creative commons", "cc", 0.5),
    ("non ?commercial use only", "noncommercial", 0.7),
    ("personal use only", "noncommercial", 0.5),
    ("educational use only", "noncommercial", 0.6),
    ("research purposes only", "noncommercial", 0.6),
    ("internal use only", "proprietary", 0.6),
    ("trade secrets? of", "proprietary", 0.6),
    ("confidential information of", "proprietary", 0.6),
    ("prior written (permission|consent)", "proprietary", 0.4),
    ("strictly prohibited without", "proprietary", 0.5),
    ("evaluation copy", "proprietary", 0.5),
    ("end user licen[sc]e agreement", "eula", 0.8),
    ("eula", "eula", 0.6),
    ("terms of service", "terms", 0.3),
    ("dual licen[sc]ed", "dual", 0.6),
    ("multi licen[sc]ed", "dual", 0.6),
    ("tri licen[sc]ed", "dual", 0.6),
    ("copyleft", "copyleft", 0.5),
    ("patent licen[sc]e", "patent", 0.4),
    ("open source licen[sc]e", "open-source", 0.4),
    ("permissive licen[sc]e", "open-source", 0.4),
    ("royalty free licen[sc]e", "royalty-free", 0.5),
    ("commercial licen[sc]e", "commercial", 0.5),
    ("licen[sc]e key", "commercial", 0.3),
]
#: Words after an anchor that a rule may look at.
REACH = 20


def rules() -> list[dict]:
    """All rules in order of priority: anchors (words they start with), pattern, label and weight."""
    found = []
    for label, name, version in FAMILIES:
        for lead, weight in LEADS:
            for tail in ([f"( v(ersion)?)? ?{version}( or( any)? later( version)?)?"] if version else []) + [""]:
                found.append({"pattern": f"{lead} {name}{tail}".strip(), "label": label, "weight": weight + (0.0 if tail else -0.05)})
    for label, clear, known in SHORT:
        if clear:
            found.append({"pattern": clear, "label": label, "weight": 0.8})
        names = [x for x in (clear, known) if x]
        found += [{"pattern": f"spdx licen[sc]e identifier {x}", "label": label, "weight": 1.0} for x in names]
        found += [{"pattern": f"licen[sc]e(s)? {x}", "label": label, "weight": 0.85} for x in names]
    found += [{"pattern": p, "label": label, "weight": 0.8} for label, p in NAMES]
    found += [{"pattern": p, "label": label, "weight": w} for p, label, w in HEADERS + NOTICES + SENTENCES]
    for k, rule in enumerate(found):
        rule |= {"priority": k, "anchors": sorted(_first_words(rule["pattern"]))}
    return found


def _first_words(pattern: str) -> set[str]:
    """The words that matches of a rule pattern can start with: optional groups, choices and small classes."""
    todo, out = {pattern}, set()
    while todo:
        p = todo.pop()
        if p.startswith("("):
            depth = end = 0
            for end, c in enumerate(p):
                depth += (c == "(") - (c == ")")
                if not depth:
                    break
            inner, rest, skip = p[1:end], p[end + 1 :], p[end + 1 : end + 2] == "?"
            rest = rest[1:] if skip else rest
            depth, part, choices = 0, "", []
            for c in inner:
                depth += (c == "(") - (c == ")")
                if c == "|" and not depth:
                    choices.append(part)
                    part = ""
                else:
                    part += c
            todo |= {c + rest for c in [*choices, part]} | ({rest} if skip else set())
        elif p.startswith("["):
            chars, rest = p[1:].split("]", 1)
            todo |= {c + rest for c in chars}
        else:
            word, k = "", 0
            while k < len(p) and (p[k].isalnum()):
                word, k = word + p[k], k + 1
            if k < len(p) and p[k] in "[(":
                # a class or group inside the first word: write it out
                tails = _first_words(p[k:]) if not p[k:].startswith("( ") else {""}
                out |= {word + t for t in tails}
            else:
                out.add(word)
    return out


def _pieces(pattern: str) -> list[tuple[str, str, bool]]:
    """The top level of a rule pattern: literal runs and groups, and whether each may be missing."""
    out, k = [], 0
    while k < len(pattern):
        end = k + 1
        if pattern[k] == "(":
            depth = 1
            while depth:
                depth += (pattern[end] == "(") - (pattern[end] == ")")
                end += 1
            kind, text = "group", pattern[k + 1 : end - 1]
        elif pattern[k] == "[":
            end = pattern.index("]", k) + 1
            kind, text = "class", pattern[k:end]
        else:
            kind, text = "literal", pattern[k]
        repeat = re.match(r"\?|\+|\*|\{[0-9,]+\}", pattern[end:])
        end += repeat.end() if repeat else 0
        out.append((kind, text, bool(repeat and (repeat[0] in "?*" or repeat[0].startswith("{0")))))
        k = end
    return out


def _choices(text: str) -> list[str]:
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def keywords(pattern: str, fresh: bool = True) -> set[str]:
    """Texts of which every match of a rule pattern holds one: its longest literal run, or those of a group's choices.

    A text that begins a word in all matches, as fresh says of the pattern itself, has a space before.
    """
    runs, groups = [" " if fresh else ""], []
    for kind, text, missing in _pieces(pattern):
        if kind == "literal" and not missing:
            runs[-1] += text
            continue
        begins = runs[-1].endswith(" ")
        if kind == "group" and not missing:
            held = [keywords(c, begins) for c in _choices(text)]
            if all(held):
                groups.append(set().union(*held))
        # after an optional group that ends a word the next one begins, whether it is there or not
        runs.append(" " if begins and missing and text.endswith(" ") else "")
    size = lambda x: sum(map(str.isalnum, x))
    best = max((r.rstrip() for r in reversed(runs)), key=size)
    if size(best) >= 4 or not groups:
        return {best} if size(best) >= 2 else set()
    return max(groups, key=lambda g: sum(map(size, g)) / len(g))


def prefilter(patterns: list[str]) -> str:
    """A pattern that finds a keyword of any of the patterns; most are looked for at the beginnings of words only."""
    held = set().union(*(keywords(p) for p in patterns))
    held = sorted(k for k in held if not any(o != k and o in k for o in held))
    return " (?:" + "|".join(k[1:] for k in held if k[0] == " ") + ")|" + "|".join(k for k in held if k[0] != " ")


def _normal(text: Column) -> Column:
    """The words of a text with one space before, between and after."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def scanned(docs: DataFrame) -> DataFrame:
    """Licenses named in each row of docs (doc_id, text), one row per row, without a shuffle.

    Columns: doc_id, n_words, n_base (places of the base phrases), first_word and last_word (their least and
    greatest start, null without one), base_labels and labels (distinct, sorted, comma-joined; labels holds the
    base ones and those of all rules that were not suppressed), score (the greatest weight, 0 without a label),
    n_detections, detections (start, stop, label and weight of each match that stays, words from 0). A null or
    empty text has no words and no labels. Repeated rows are scanned each, a text of any length is read whole, an empty table
    gives no rows and other columns are ignored.
    """
    listed = rules()
    anchors = sorted({a for r in listed for a in r["anchors"]})
    filed = {a: [{"pattern": f"^({r['pattern']})(?= )", "priority": r["priority"]} for r in listed if a in r["anchors"]] for a in anchors}
    filed = F.from_json(F.lit(json.dumps(filed)), "map<string, array<struct<pattern: string, priority: int>>>")  # one literal
    labels = F.from_json(F.lit(json.dumps([r["label"] for r in listed])), "array<string>")
    weights = F.from_json(F.lit(json.dumps([round(r["weight"], 4) for r in listed])), "array<double>")
    base = "(?<= )(" + "|".join(BASE) + ")(?= )"

    df = docs.select(F.col("doc_id").cast("long"), _normal(F.col("text").cast("string")).alias("normal"))
    df = df.withColumn("n_words", F.when(F.length("normal") <= 2, 0).otherwise(_spaces(F.col("normal")) - 1).cast("long"))
    # without a keyword no rule and no base phrase matches
    gate = F.col("normal").rlike(prefilter([*BASE, *(r["pattern"] for r in listed)]))
    df = df.withColumn("gated", F.when(gate, F.col("normal")))

    # base places: the text between them tells where they stand
    df = df.withColumn("pieces", F.when(F.col("gated").isNotNull(), F.split("gated", base, -1)))
    df = df.withColumn("found", F.when(F.size("pieces") > 1, F.regexp_extract_all("gated", F.lit(base), F.lit(1))))
    last = F.element_at("found", -1)
    tail = F.length(F.element_at("pieces", -1)) + F.length(last)
    df = df.withColumns(
        {
            "n_base": F.coalesce(F.size("found"), F.lit(0)).cast("long"),
            "first_word": F.when(F.col("found").isNotNull(), _spaces(F.element_at("pieces", 1)) - 1).cast("long"),
            "last_word": F.when(F.col("found").isNotNull(), _spaces(F.substring(F.col("gated"), F.lit(1), F.length("gated") - tail)) - 1).cast("long"),
            "base": F.coalesce(F.transform(F.array_distinct("found"), lambda p: F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv])[p]), F.array().cast("array<string>")),
        }
    )

    # the rules filed under each anchor, against the words that follow it
    df = df.withColumn("words", F.when(F.col("gated").isNotNull(), F.split(F.trim("gated"), " ")))
    places = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda p: p.word.isin(anchors))
    ahead = lambda p: F.concat(F.array_join(F.slice(F.col("words"), p.at + 1, REACH), " "), F.lit(" "))
    # one pattern of all rules tells the places with a match; its choices are compiled once, a rule's own at each place
    some = "^(?:" + "|".join(dict.fromkeys(r["pattern"] for r in listed)) + ") "
    df = df.withColumn("places", F.filter(F.transform(places, lambda p: F.struct(p.at.alias("at"), p.word.alias("word"), ahead(p).alias("ahead"))), lambda p: p.ahead.rlike(some)))

    matched = lambda p, r: F.call_function("regexp_extract", p.ahead, r.pattern, F.lit(0))

    def best(p: Column) -> Column:
        hits = F.transform(filed[p.word], lambda r: F.struct(_spaces(matched(p, r)).alias("more"), (F.length(matched(p, r)) > 0).alias("hit"), (-r.priority).alias("order")))
        hits = F.filter(hits, lambda h: h.hit)
        top = F.array_max(F.transform(hits, lambda h: F.struct(h.more, h.order)))
        return F.struct(p.at.alias("start"), (p.at + top.more + 1).alias("stop"), (-top.order).alias("rule"))

    df = df.withColumn("hits", F.filter(F.transform("places", best), lambda h: h.stop.isNotNull()))
    # a place has one hit at most and a hit spans REACH words at most, so only so many earlier ones can hold it
    earlier = lambda i: F.slice(F.col("hits"), F.greatest(i + 1 - REACH, F.lit(1)), F.least(i, F.lit(REACH)))
    inside = lambda h, i: F.exists(earlier(i), lambda e: e.stop >= h.stop)
    df = df.withColumn("kept", F.filter("hits", lambda h, i: ~((i > 0) & inside(h, i))))
    detections = F.transform("kept", lambda h: F.struct(h.start.cast("long").alias("start"), h.stop.cast("long").alias("stop"), labels[h.rule].alias("label"), weights[h.rule].alias("weight")))
    df = df.withColumn("detections", F.coalesce(detections, F.array().cast("array<struct<start:bigint,stop:bigint,label:string,weight:double>>")))
    named = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d.weight)), F.lit(0.0)), F.when(F.col("n_base") > 0, 0.75).otherwise(0.0))
    return df.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        named(F.col("base")).alias("base_labels"),
        named(F.concat("base", F.transform("detections", lambda d: d.label))).alias("labels"),
        score.alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
        "detections",
    )
