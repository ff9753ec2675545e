"""License scan: ordered signature rules behind a keyword filter, overlaps settled by priority.

A text is lower-cased (A-Z) and reduced to its words, joined by one blank. Rules are regular expressions over
that form, made from the families and phrasings below. Texts without a gate word are not searched; a family's
rules run only where its keyword stands. A detection inside the interval of another one of at least its
priority is dropped; of equal intervals the earlier rule stays.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from flowmill.llm.words import map_texts

# Label, keyword, name as words, versions.
FAMILIES = [
    ("mit", "mit", r"mit|expat", ""),
    ("apache", "apache", r"apache(?: software)?", "1 0|1 1|2 0"),
    ("gpl", "general public", r"(?:gnu )?general public", "1|2|2 0|3|3 0"),
    ("gpl", "gpl", r"(?:gnu )?gpl", "1|2|2 0|3|3 0"),
    ("lgpl", "lesser general", r"(?:gnu )?(?:lesser|library) general public", "2|2 1|3|3 0"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", "2|2 1|3|3 0"),
    ("agpl", "affero", r"(?:gnu )?affero general public", "1|3|3 0"),
    ("agpl", "agpl", r"(?:gnu )?agpl", "1|3|3 0"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation", "1 1|1 2|1 3"),
    ("bsd", "bsd", r"(?:new |modified |revised |simplified )?bsd", "0 clause|2 clause|3 clause|4 clause"),
    ("mpl", "mozilla", r"mozilla(?: public)?", "1 0|1 1|2 0"),
    ("mpl", "mpl", r"mpl", "1 0|1 1|2 0"),
    ("epl", "eclipse", r"eclipse(?: public)?", "1 0|2 0"),
    ("cddl", "cddl", r"cddl", "1 0|1 1"),
    ("cddl", "common development", r"common development and distribution", "1 0|1 1"),
    ("cpl", "common public", r"common public", "1 0"),
    ("eupl", "eupl", r"eupl|european union public", "1 0|1 1|1 2"),
    ("isc", "isc", r"isc", ""),
    ("zlib", "zlib", r"zlib(?: libpng)?", ""),
    ("boost", "boost", r"boost(?: software)?", "1 0"),
    ("artistic", "artistic", r"artistic", "1 0|2 0"),
    ("unlicense", "unlicense", r"unlicense", ""),
    ("wtfpl", "wtfpl", r"wtfpl", "1|2"),
    ("ofl", "font", r"(?:sil )?open font", "1 0|1 1"),
    ("python", "python", r"python(?: software foundation)?", "2|2 0"),
    ("php", "php", r"php", "3 0|3 01"),
    ("ruby", "ruby", r"ruby", ""),
    ("openssl", "openssl", r"openssl", ""),
    ("postgresql", "postgresql", r"postgresql", ""),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa", ""),
    ("ms-pl", "microsoft", r"microsoft public", ""),
    ("busl", "business source", r"business source", "1 0|1 1"),
    ("sspl", "server side", r"server side public", "1"),
    ("cc0", "cc0", r"cc0", "1 0"),
    ("cc-by", "cc by", r"cc by", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-sa", "cc by sa", r"cc by sa", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nc", "cc by nc", r"cc by nc", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nd", "cc by nd", r"cc by nd", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by", "creative commons", r"creative commons attribution", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-sa", "attribution share", r"creative commons attribution share ?alike", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nc", "attribution non", r"creative commons attribution non ?commercial", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nd", "attribution no", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?", "1 0|2 0|2 5|3 0|4 0"),
    ("proprietary", "proprietary", r"proprietary", ""),
]
# Phrasing ({n} the name, {v} a version), priority, confidence. With {v}: one rule per version.
PHRASINGS = [
    (r"licensed under (?:the )?(?:terms of the )?(?:{n})(?: licen[cs]e)?(?: version| v)? {v}", 4, 0.95),
    (r"spdx licen[cs]e identifier (?:{n}) {v}(?: only| or later)?", 4, 0.99),
    (r"(?:{n}) licen[cs]e(?: agreement)?(?: version| v)? {v}", 3, 0.9),
    (r"licensed under (?:the )?(?:terms of the )?(?:{n})(?: licen[cs]e)?", 2, 0.85),
    (r"spdx licen[cs]e identifier (?:{n})", 2, 0.9),
    (r"(?:released|distributed|available|provided) under (?:the )?(?:terms of the )?(?:{n}) licen[cs]e", 2, 0.85),
    (r"(?:{n}) licen[cs]e", 1, 0.7),
]
# Sentences of well-known license texts, over the same word form.
PASSAGES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", 4, 0.95),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", 4, 0.9),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", 4, 0.95),
    ("gpl", r"free software you can redistribute it and or modify it under the terms of the gnu general public license", 5, 0.99),
    ("lgpl", r"under the terms of the gnu (?:lesser|library) general public license", 5, 0.95),
    ("agpl", r"under the terms of the gnu affero general public license", 5, 0.95),
    ("zlib", r"this software is provided as is without any express or implied warranty", 3, 0.7),
    ("unlicense", r"free and unencumbered software released into the public domain", 4, 0.95),
    ("public-domain", r"(?:dedicated to|released into|in) the public domain", 2, 0.7),
    ("all-rights-reserved", r"all rights reserved", 1, 0.5),
]
GATES = [b"licen", b"permission ", b"redistribution ", b"public domain", b"free software", b"as is without", b"all rights reserved"]
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# lower-cases A-Z, keeps 0-9, a-z and every byte of a non-ASCII character, blanks the rest
_FORM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SCHEMA = (
    "id bigint, n_words bigint, base array<struct<label:string,word:bigint>>, "
    "found array<struct<rule:string,label:string,first_word:bigint,end_word:bigint,priority:int,confidence:double>>"
)


def rules() -> list[tuple[bytes, list[tuple[str, str, re.Pattern, int, float]]]]:
    """(keyword, its rules in order); a rule is (name, label, pattern, priority, confidence)."""
    by_keyword: dict[str, list] = {}
    for label, keyword, name, versions in FAMILIES:
        for i, (phrase, priority, confidence) in enumerate(PHRASINGS):
            for v in versions.split("|") if "{v}" in phrase and versions else [] if "{v}" in phrase else [""]:
                pattern = re.compile(rb"(?<![^ ])" + phrase.replace("{n}", name).replace("{v}", v).encode() + rb"(?![^ ])")
                rule = f"{label}/{keyword.replace(' ', '-')}/{i}" + (f"/{v.replace(' ', '.')}" if v else "")
                by_keyword.setdefault(keyword, []).append((rule, label, pattern, priority, confidence))
    for label, passage, priority, confidence in PASSAGES:
        word = max(re.sub(r"\(.*?\)", "|", passage).split("|"), key=len).strip()
        by_keyword.setdefault(word, []).append(
            (f"{label}/passage", label, re.compile(rb"(?<![^ ])" + passage.encode() + rb"(?![^ ])"), priority, confidence)
        )
    return [(k.encode(), v) for k, v in by_keyword.items()]


def settle(hits: list[tuple[int, int, int, int]]) -> list[int]:
    """Indices of (start, end, priority, order) that no other one of at least the priority contains."""
    widest: dict[int, int] = {}  # priority -> furthest end so far
    stay = []
    for i in sorted(range(len(hits)), key=lambda i: (hits[i][0], -hits[i][1], -hits[i][2], hits[i][3])):
        _, end, priority, _ = hits[i]
        if not any(e >= end for p, e in widest.items() if p >= priority):
            stay.append(i)
        widest[priority] = max(widest.get(priority, 0), end)
    return stay


def detections(form: bytes, table: list) -> list[tuple]:
    """(rule, label, first word, word after the last, priority, confidence), in text order."""
    if not any(g in form for g in GATES):
        return []
    hits, order = [], 0
    for keyword, own in table:
        present = keyword in form
        for rule in own:
            order += 1
            if present:
                hits += [(m.start(), m.end(), rule[3], order, rule) for m in rule[2].finditer(form)]
    kept = [hits[i] for i in settle([h[:4] for h in hits])]
    if not kept:
        return []
    blanks = np.flatnonzero(np.frombuffer(form, np.uint8) == 32)
    places = np.searchsorted(blanks, [(h[0], h[1]) for h in kept])
    return [(h[4][0], h[4][1], int(a), int(b) + 1, h[4][3], h[4][4]) for h, (a, b) in zip(kept, places, strict=True)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_words``, ``base`` (each place of a base phrase) and ``found`` (rules that stand, with word spans).

    Null and empty texts have no words and empty lists. Repeated rows repeat; a null id stays null; other
    columns of ``docs`` are not read; an empty table gives an empty table.
    """
    phrases = [tuple(p.encode().split()) for p in BASE]
    labels = list(BASE.values())
    table = rules()

    def work(part, texts):
        out = {"id": part.column(0), "n_words": [], "base": [], "found": []}
        for text in texts:
            words = text.translate(_FORM).split()
            base, found = [], []
            form = b" ".join(words)
            if b" license" in form:
                for phrase, label in zip(phrases, labels, strict=True):
                    if b" ".join(phrase) in form:
                        at = -1
                        while True:
                            try:
                                at = words.index(phrase[0], at + 1)
                            except ValueError:
                                break
                            if tuple(words[at : at + len(phrase)]) == phrase:
                                base.append({"label": label, "word": at})
            found = [
                dict(zip(("rule", "label", "first_word", "end_word", "priority", "confidence"), d, strict=True))
                for d in detections(form, table)
            ]
            out["n_words"].append(len(words))
            out["base"].append(sorted(base, key=lambda b: (b["word"], b["label"])))
            out["found"].append(found)
        return out

    return map_texts(docs.selectExpr(f"cast(`{id_col}` as bigint) id", f"cast(`{text_col}` as string) text"), "text", SCHEMA, work)
