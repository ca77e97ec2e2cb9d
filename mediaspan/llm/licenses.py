"""License scans: blocks compressed with each template as dictionary, winners checked word by word."""

from __future__ import annotations

import difflib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspan.llm import shared

# Statements by which public licences are granted.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Words of which a block must hold one that its template holds too.
CUES = frozenset("license licensed licence redistribution redistribute permission released unencumbered cc".split())
#: Most differing words of a confirmed block, as a share of its template's.
DIFFER = 0.1
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = "\"'()[]{}<>.,;:!?*#/%$&|=+-~_"
_LETTERS = re.compile(rb"licen[cs]e|redistribut|permission|released|unencumbered|\bcc\b", re.IGNORECASE)


def plain(word: str) -> str:
    return word.lower().strip(_EDGES)


class Scanner:
    """The templates with their dictionaries; what a task needs to scan texts."""

    def __init__(self, templates: dict[str, list[str]]):
        self.names = [name for name, texts in templates.items() for _ in texts]
        self.texts = [text for texts in templates.values() for text in texts]
        self.words = [[plain(w) for w in _WORD.findall(text)] for text in self.texts]
        raw = zstandard.DICT_TYPE_RAWCONTENT
        self.given = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=raw)) for t in self.texts]
        self.alone = zstandard.ZstdCompressor(level=3)
        self.cues: dict[str, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            for at, w in enumerate(words):
                if w in CUES:
                    self.cues.setdefault(w, []).append((at, len(words)))

    def blocks(self, words: list[str]) -> list[tuple[int, int]]:
        """Candidate blocks, as word ranges: a template's length laid where a shared cue word puts it."""
        out = set()
        for i, w in enumerate(words):
            for at, n in self.cues.get(w, ()):
                if 0 <= i - at and i - at + n <= len(words):
                    out.add((i - at, i - at + n))
        return sorted(out)

    def savings(self, block: bytes) -> list[float]:
        """By how much of its own compressed size each template makes the block smaller."""
        alone = len(self.alone.compress(block))
        return [(alone - len(c.compress(block))) / alone for c in self.given]

    def differences(self, words: list[str], t: int) -> list[str]:
        """Words taken from and put into the template, in order."""
        a, b = self.words[t], words
        out = []
        for what, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if what != "equal":
                out += [f"-{w}" for w in a[i:j]] + [f"+{w}" for w in b[k:m]]
        return out

    def scan(self, text: str) -> list[dict]:
        """The confirmed blocks of a text; of overlapping ones the one with fewest differences."""
        found = [(m.start(), m.end(), plain(m.group())) for m in _WORD.finditer(text)]
        words = [w for _, _, w in found]
        hits = []
        for a, b in self.blocks(words):
            start, end = found[a][0], found[b - 1][1]
            saved = self.savings(text[start:end].encode())
            # The winner is the template that saves most; equals are told apart by their wording.
            best = max(saved)
            for t in [t for t, s in enumerate(saved) if s >= best - 0.02]:
                changed = self.differences(words[a:b], t)
                if best > 0 and len(changed) <= DIFFER * len(self.words[t]):
                    hits.append((len(changed), -len(self.words[t]), -saved[t], start, end, t, changed))
        out: list = []
        for n, _, saved, start, end, t, changed in sorted(hits):
            if all(end <= x["start"] or start >= x["end"] for x in out):
                out.append({"license": self.names[t], "start": start, "end": end, "saved": -saved, "n_differences": n, "differences": " ".join(changed)})
        return sorted(out, key=lambda x: x["start"])


_FOUND = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saved", pa.float64()), ("n_differences", pa.int64()), ("differences", pa.string())])


def scan(documents: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """documents(doc_id, text) -> doc_id, license, start, end, saved, n_differences, differences.

    One row for each statement found, none for texts without one, null or empty. Places are
    code points, ends exclusive. saved: share of the block's compressed size that its template
    as dictionary saves. A block is confirmed if at most DIFFER of its template's words differ,
    case and marks at words' edges apart. Repeated rows and null ids are each reported.
    """
    shared.small_batches(documents.sparkSession)
    templates = templates or TEMPLATES

    def search(batches):
        scanner = Scanner(templates)
        for x in batches:
            ids, (data, offsets) = x.column(0).to_pylist(), shared.buffer(x.column(1))
            rows = []
            for i in range(len(ids)):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                if _LETTERS.search(raw):
                    rows += [{"doc_id": ids[i], **hit} for hit in scanner.scan(raw.decode("utf-8", "replace"))]
            yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(search, "doc_id long, license string, start long, end long, saved double, n_differences long, differences string")
