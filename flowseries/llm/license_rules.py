"""License scans by sentence rules.

Sentences are normalised (lower case, letters and digits, single spaces) and looked up among known licence sentences;
the identifiers found, in the order of the text, are matched against rules in their order. A rule is a sequence of
identifiers; where it occurs it names its licence and uses them up. Identifiers that no rule uses are left over.

Tables: ``SENTENCES`` and ``RULES`` hold common statements and short licences. Whole licences of any length are given
as texts to ``licence_table``, which makes a rule of each one's own sequence of sentences; ``read_licences`` gets them
from a folder of one text a file, named by its licence. The table is sent to every task, so its size is bounded by
``MAX_LICENCE_BYTES`` of text.

Two cuts of a text are tried: line by line, for statements on lines of their own, and with single line breaks as
spaces, for wrapped paragraphs; the one that knows more sentences counts (on a tie, line by line).

One scan, no shuffle; only the texts go to Python.

Defined results: null and empty texts have no sentences; texts of any length are cut whole; an empty table gives none;
repeated sentences give their identifier and licence again (licences are listed once); repeated rows each get their
own; ids may be null; other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowseries.llm.batches import ROWS, fresh

# Identifiers and sentences of public licences and of common statements about them.
SENTENCES = {
    "mit-ref": ("Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "Distributed under the MIT License", "MIT License", "The MIT License (MIT)"),
    "mit-grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "as-is": ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",),
    "apache2-ref": ("Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");", "Released under the Apache License, Version 2.0", "Apache License, Version 2.0", "This project is licensed under the Apache License 2.0"),
    "apache2-comply": ("you may not use this file except in compliance with the License", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    "apache2-copy": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",),
    "gpl3-ref": ("This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Released under the GNU General Public License v3.0", "GNU General Public License, version 3"),
    "gpl2-ref": ("This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "Released under the GNU General Public License v2.0"),
    "gpl-redistribute": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "gpl-warranty": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",),
    "lgpl3-ref": ("Licensed under the GNU Lesser General Public License, version 3",),
    "agpl3-ref": ("Licensed under the GNU Affero General Public License, version 3",),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "bsd-endorse": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "bsd3-ref": ("Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License"),
    "bsd2-ref": ("Licensed under the BSD 2-Clause License", "Released under the BSD 2-Clause License"),
    "cc-by-nc-4-ref": ("Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-sa-4-ref": ("Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-4-ref": ("Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc0-ref": ("This work is released under the CC0 1.0 Universal license", "Licensed under CC0 1.0"),
    "mpl2-ref": ("Licensed under the Mozilla Public License 2.0", "Licensed under the Mozilla Public License, version 2.0"),
    "mit-liability": ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "isc-as-is": ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",),
    "isc-ref": ("Licensed under the ISC License", "Released under the ISC License"),
    "gpl2-redistribute": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",),
    "lgpl3-redistribute": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "agpl3-redistribute": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "bsd-as-is": ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",),
    "mpl2-copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    "unlicense-grant": ("This is free and unencumbered software released into the public domain",),
    "boost-grant": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",),
    "cc-by-nd-4-ref": ("Licensed under CC BY-ND 4.0", "This work is licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "cc-by-nc-sa-4-ref": ("Licensed under CC BY-NC-SA 4.0", "This work is licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "cc-by-nc-nd-4-ref": ("Licensed under CC BY-NC-ND 4.0", "This work is licensed under CC BY-NC-ND 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "all-rights": ("Copyright, all rights reserved", "All rights reserved under copyright"),
}
# Licences and the sequences that name them, longest first.
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("MIT", ("mit-grant", "mit-notice", "as-is", "mit-liability")),
    ("GPL-2.0-or-later", ("gpl2-redistribute", "gpl-warranty")),
    ("LGPL-3.0-or-later", ("lgpl3-redistribute", "gpl-warranty")),
    ("AGPL-3.0-or-later", ("agpl3-redistribute", "gpl-warranty")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache2-comply", "apache2-copy")),
    ("Apache-2.0", ("apache2-ref", "apache2-comply", "apache2-copy")),
    ("Apache-2.0", ("apache2-ref", "apache2-comply")),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-warranty")),
    ("GPL-3.0-or-later", ("gpl-redistribute",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-2.0-or-later", ("gpl2-redistribute",)),
    ("LGPL-3.0-or-later", ("lgpl3-redistribute",)),
    ("AGPL-3.0-or-later", ("agpl3-redistribute",)),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl2-copy",)),
    ("Unlicense", ("unlicense-grant",)),
    ("BSL-1.0", ("boost-grant",)),
    ("MIT", ("mit-ref",)),
    ("Apache-2.0", ("apache2-ref",)),
    ("Apache-2.0", ("apache2-comply",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("GPL-2.0-only", ("gpl2-ref",)),
    ("LGPL-3.0-only", ("lgpl3-ref",)),
    ("AGPL-3.0-only", ("agpl3-ref",)),
    ("BSD-3-Clause", ("bsd3-ref",)),
    ("BSD-2-Clause", ("bsd2-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-ref",)),
    ("CC-BY-4.0", ("cc-by-4-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("MPL-2.0", ("mpl2-ref",)),
    ("ISC", ("isc-ref",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4-ref",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4-ref",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4-ref",)),
    ("proprietary", ("all-rights",)),
)
#: Bytes of licence texts that ``read_licences`` takes to the driver; more fail.
MAX_LICENCE_BYTES = 16 << 20
#: Sentences of whole licences with fewer words ("1. Definitions.") say nothing of a licence.
MIN_WORDS = 4
_END = re.compile(r"[.!?:;]+(?:[\x20\x09-\x0D]+|\Z)|\n+")
_OTHER = re.compile(r"[\W_]+")
_HEAD = re.compile(r"[^\W_]+(?:[\W_]+[^\W_]+)?")
_BREAK = re.compile(r"([^\n])\n([^\n])")
#: Sentences that each copy fills in for itself.
_FILLED_IN = re.compile(r"<[^<>\n]+>|\[[^\[\]\n]+\]|^\W*copyright\b", re.IGNORECASE)


class LicenceTable(NamedTuple):
    """Normalised sentences to identifiers, and rules (licence, identifiers) in the order they are tried in."""

    known: dict[str, str]
    rules: tuple[tuple[str, tuple[str, ...]], ...]


def normalised(sentence: str) -> str:
    """Lower case, runs of other characters than letters and digits as one space."""
    return _OTHER.sub(" ", sentence.lower()).strip()


def _unwrapped(text: str) -> str:
    return _BREAK.sub(r"\1 \2", text)


def known_sentences() -> dict[str, str]:
    """Normalised sentence of ``SENTENCES`` to identifier; one that the cuts would split stands under its last part."""
    found = {}
    for name, texts in SENTENCES.items():
        for text in texts:
            parts = [normalised(p) for p in _END.split(text) if normalised(p)]
            found.setdefault(parts[-1], name)
    return found


def licence_table(texts: Mapping[str, str] | None = None) -> LicenceTable:
    """The table of ``SENTENCES`` and ``RULES`` and, for each licence of ``texts`` (name to whole text), a rule of all
    its sentences in order. A sentence that several licences have is one identifier; of two names
    with the same text the first in order counts. Longer texts are tried first, and all of them before ``RULES``, as
    they hold the latter's statements."""
    known, whole = known_sentences(), []
    for licence, text in sorted((texts or {}).items()):
        sequence = []
        for i, part in enumerate(_END.split(_unwrapped(text))):
            sentence = normalised(part)
            if not _FILLED_IN.search(part) and (sentence in known or len(sentence.split()) >= MIN_WORDS):
                sequence.append(known.setdefault(sentence, f"{re.sub(r'[^a-z0-9.+-]+', '-', licence.lower())}.{i}"))
        if sequence:
            whole.append((licence, tuple(sequence)))
    return LicenceTable(known, (*sorted(whole, key=lambda rule: -len(rule[1])), *RULES))


def read_licences(spark: SparkSession, path: str) -> dict[str, str]:
    """Texts of a folder by file name, less ``.txt``, through Spark's readers, so ``path`` may be in any store."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("name"), "value")
    size = files.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()[0]
    if size > MAX_LICENCE_BYTES:
        raise ValueError(f"{path} holds {size} bytes of licence texts, more than {MAX_LICENCE_BYTES}")
    return {r.name: r.value for r in files.collect()}


def _heads(sentences: Iterable[str]) -> frozenset[str]:
    """First two words of each."""
    return frozenset(" ".join(s.split()[:2]) for s in sentences)


def identifiers(text: str, known: Mapping[str, str], heads: frozenset[str] | None = None) -> list[str]:
    """Identifiers of a text's known sentences, in order, by the better of both cuts. Only sentences whose first two
    words are ``heads``, those of the ``known`` ones, are normalised whole."""
    heads = _heads(known) if heads is None else heads
    head, other, text = _HEAD.search, _OTHER.sub, text.lower()

    def cut(whole: str) -> list[str]:
        parts = [p for p in _END.split(whole) if (m := head(p)) and other(" ", m.group()) in heads]
        return [known[s] for s in map(normalised, parts) if s in known]

    lines = cut(text)
    wrapped = cut(_unwrapped(text)) if "\n" in text else lines
    return wrapped if len(wrapped) > len(lines) else lines


def matched(ids: list[str], rules: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[list[str], int]:
    """Licences in the order of the rules, each once, and the number of identifiers that no rule used."""
    rest, licences, present = list(ids), [], set(ids)
    for licence, rule in rules:
        if rule[0] in present:
            left, at = [], 0
            while at < len(rest):
                if rest[at] == rule[0] and tuple(rest[at : at + len(rule)]) == rule:
                    # What is used parts its neighbours, so no rule reaches across it.
                    left.append(None)
                    licences.append(licence)
                    at += len(rule)
                else:
                    left.append(rest[at])
                    at += 1
            rest = left
    return list(dict.fromkeys(licences)), sum(x is not None for x in rest)


_RESULT = "struct<sentence_ids: array<string>, licences: array<string>, left_over: int>"


def scan(docs: DataFrame, table: LicenceTable | None = None) -> DataFrame:
    """``docs`` with ``sentence_ids`` (array in the order of the text), ``licences`` (array in the order of the
    rules, each once) and ``left_over`` (number of identifiers that no rule used), in place of columns so named."""
    docs = docs.drop("sentence_ids", "licences", "left_over")
    (own,) = fresh(docs, "result")
    # A plain tuple: a broadcast is pickled by reference, and executors needn't have this package.
    sent = docs.sparkSession.sparkContext.broadcast(tuple(table or licence_table()))

    @F.arrow_udf(_RESULT)
    def scanned(texts: pa.Array) -> pa.Array:
        known, rules = sent.value
        heads = _heads(known)
        ids, licences, left = [], [], []
        for at in range(0, len(texts), ROWS):
            for text in texts.slice(at, ROWS).to_pylist():
                found = identifiers(text, known, heads) if text else []
                named, unused = matched(found, rules) if found else ([], 0)
                ids.append(found)
                licences.append(named)
                left.append(unused)
        strings = pa.list_(pa.string())
        return pa.StructArray.from_arrays([pa.array(ids, strings), pa.array(licences, strings), pa.array(left, pa.int32())], names=["sentence_ids", "licences", "left_over"])

    names = docs.columns
    return docs.withColumn(own, scanned(F.col("text"))).select(*names, *[F.col(f"{own}.{c}").alias(c) for c in ("sentence_ids", "licences", "left_over")])
