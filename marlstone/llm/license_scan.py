"""Licence scan by canonical digest lookup.

A text's canonical form has ASCII letters in lower case, no copyright lines, one space for every run of
punctuation and white space, and one spelling for words that licences spell in several ways. The SHA-256 of the
canonical form of a whole text is looked up, by a hash join, among the digests of known licences; each line that
could be a licence notice is looked up among known notices.

Canonical forms longer than any known one with room for other spellings cannot match, nor can those without a word
that every known form has; so only the others are spelled and digested. Only lines that have the stem all notices have are canonicalised.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that name a copyright holder; applied to lower-case text.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9<\[{])|\(c\)|©|all rights reserved)[^\n]*"
#: What separates words: ASCII but letters and digits, and the signs, punctuation and spaces of Latin-1 and beyond.
BETWEEN = r"[\x00-/:-`{-\x7F" + "\u00A0-\u00A9\u00AB-\u00B4\u00B6-\u00B9\u00BB-\u00BF\u2000-\u206F\u3000-\u303F]+"
STEM = "licen"

#: Spellings, and the one that stands for them.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("non commercial", "noncommercial"),
    ("offence", "offense"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("programme", "program"),
    ("recognised", "recognized"),
    ("sub licence", "sublicense"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

#: Where the known licences lie, as <SPDX id>.txt: fixed texts.
FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licenses")

#: Titles under which licences are also found, beside that of their text and none.
TITLES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD License"),
    "ISC": ("ISC License", "ISC License (ISC)", "The ISC License"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "License (MIT)"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
}
#: What may end a licence's terms, with advice on their use after it.
END = "END OF TERMS AND CONDITIONS"


def known_licenses(folder: str = FOLDER) -> dict[str, str]:
    """The texts of a folder, by SPDX id."""
    out = {}
    for name in sorted(os.listdir(folder)):
        if name.endswith(".txt"):
            with open(os.path.join(folder, name), encoding="utf-8") as file:
                out[name.removesuffix(".txt")] = file.read()
    return out


LICENSES = known_licenses()


def forms(name: str, text: str) -> list[str]:
    """A licence as it is found: whole or up to the end of its terms, under its own title, another of TITLES, or none.

    A title is the first of several paragraphs, where TITLES has it.
    """
    titles = [t for t in TITLES.get(name, ())]
    first, _, rest = text.strip("\n").partition("\n\n")
    body = rest if canonical(first) in {canonical(t) for t in titles} else text
    wholes = [text, *([body] if titles else []), *[f"{t}\n\n{body}" for t in titles]]
    head, end, _ = text.partition(END)
    return [*wholes, *([head, head + end] if end else [])]


#: Known one-line notices: fixed texts, and the SPDX id they tell of.
NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under the MIT License.": "MIT",
    "Released under the MIT License.": "MIT",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0-only",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    "Licensed under the BSD 3-Clause License.": "BSD-3-Clause",
    'Licensed under the Apache License, Version 2.0 (the "License");': "Apache-2.0",
    "Licensed under the Apache License, Version 2.0": "Apache-2.0",
    "Licensed under the MIT License": "MIT",
    "This project is licensed under the MIT License.": "MIT",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
    **{f"SPDX-License-Identifier: {name}": name for name in LICENSES},
}

#: Most known licences that are broadcast, and notices that are looked up in a constant.
MOST_LICENSES, MOST_NOTICES = 100_000, 200


def canonical(text: str) -> str:
    """The canonical form, in Python, for known texts; canonical_column is the same for tables."""
    plain = re.sub(COPYRIGHT_LINE, "", text.translate({c: c + 32 for c in range(65, 91)}))
    spread = "  " + re.sub(BETWEEN, "  ", plain) + "  "
    for other, one in SPELLINGS:
        spread = spread.replace(f" {other.replace(' ', '  ')} ", f" {one.replace(' ', '  ')} ")
    return re.sub(" +", " ", spread).strip(" ")


def digest(text: str) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


def plain_column(text: Column) -> Column:
    """The canonical form but for spellings, with a space before and after."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(lower, COPYRIGHT_LINE, ""), BETWEEN, " ")), F.lit(" "))


def spelled_column(plain: Column) -> Column:
    spread = F.replace(plain, F.lit(" "), F.lit("  "))
    for other, one in SPELLINGS:
        spread = F.replace(spread, F.lit(f" {other.replace(' ', '  ')} "), F.lit(f" {one.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(spread, " +", " "))


def longest(texts: Iterable[str]) -> int:
    """Length that no canonical form, before spelling, of a match can pass: one spelling is at most 1.5 times another."""
    return 2 + int(1.5 * max((len(canonical(t)) for t in texts), default=0))


def digests(licenses: Mapping[str, str]) -> dict[str, str]:
    """The licence of each known digest; of several the first id."""
    out: dict[str, str] = {}
    for name in sorted(licenses):
        for form in forms(name, licenses[name]):
            out.setdefault(digest(form), name)
    return out


def markers(licenses: Mapping[str, str]) -> list[str]:
    """A few words one of which every known form has, and which no spelling changes: texts without them match nothing."""
    spelled = {word for pair in SPELLINGS for side in pair for word in side.split()}
    left = [set(canonical(form).split()) - spelled for name in licenses for form in forms(name, licenses[name])]
    if not all(left):
        return []
    out = []
    while left:
        times = Counter(word for words in left for word in words)
        best = max(times, key=lambda word: (times[word], len(word), word))
        out.append(best)
        left = [words for words in left if best not in words]
    return out


def scan_licenses(docs: DataFrame, licenses: Mapping[str, str] = LICENSES, notices: Mapping[str, str] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, license_id (of the whole text, else null), notice_ids (those of its lines,
    each once, in order, joined by commas; empty for none) and n_notices (lines that are notices).

    Null and empty texts match nothing; very long texts are read whole. Of several licences with one canonical form the first id counts. Repeated
    rows get repeated results; a null id stays null. Other columns are ignored; an empty table gives no rows.
    """
    if len(licenses) > MOST_LICENSES or len(notices) > MOST_NOTICES:
        raise ValueError(f"at most {MOST_LICENSES} licences and {MOST_NOTICES} notices are looked up")
    if lacking := [n for n in notices if STEM not in canonical(n)]:
        raise ValueError(f"notices without {STEM!r}: {lacking}")
    spark = docs.sparkSession
    known, marks = digests(licenses), markers(licenses)
    table = F.broadcast(spark.createDataFrame(sorted(known.items()), "__digest string, license_id string"))
    told = {digest(n): i for n, i in notices.items()}
    keys = sorted(told)

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("plain", plain_column(F.col("text")))
    short = F.length("plain") <= longest(licenses.values())
    if marks:
        short = short & reduce(lambda a, b: a | b, [F.contains("plain", F.lit(f" {word} ")) for word in marks])
    rows = rows.withColumn("__key", F.when(short, F.sha2(spelled_column(F.col("plain")), 256)))
    likely = F.filter(F.split("text", "\n"), lambda line: F.lower(line).contains(STEM))
    bound = longest(notices)
    lines = F.filter(F.transform(likely, plain_column), lambda line: F.length(line) <= bound)
    found = F.filter(F.transform(lines, lambda line: F.sha2(spelled_column(line), 256)), lambda d: d.isin(keys))
    rows = rows.withColumn("__found", found)
    ids = F.array(*[F.lit(told[k]) for k in keys])
    place = F.array(*[F.lit(k) for k in keys])
    named = F.transform("__found", lambda d: F.get(ids, (F.array_position(place, d) - 1).cast("int")))
    out = rows.join(table, F.col("__key") == F.col("__digest"), "left")
    return out.select("doc_id", "license_id", F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("notice_ids"), F.size("__found").cast("bigint").alias("n_notices"))


def duckdb_sql(licenses: Mapping[str, str] = LICENSES, notices: Mapping[str, str] = NOTICES) -> str:
    """The scan in DuckDB, over every line and without bounds of length."""

    def form(text: str) -> str:
        low = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        out = f"'  ' || regexp_replace(regexp_replace({low}, '{COPYRIGHT_LINE}', '', 'g'), '{BETWEEN}', '  ', 'g') || '  '"
        for other, one in SPELLINGS:
            out = f"replace({out}, ' {other.replace(' ', '  ')} ', ' {one.replace(' ', '  ')} ')"
        return f"sha256(trim(regexp_replace({out}, ' +', ' ', 'g'), ' '))"

    values = ", ".join(f"('{d}', '{i}')" for d, i in sorted(digests(licenses).items()))
    told = ", ".join(f"('{d}', '{i}')" for d, i in {digest(n): i for n, i in notices.items()}.items())
    return f"""
WITH known(digest, license_id) AS (VALUES {values}), told(digest, notice_id) AS (VALUES {told}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
hit AS (SELECT r, notice_id FROM (SELECT r, {form('line')} AS digest FROM line WHERE lower(line) LIKE '%{STEM}%') JOIN told USING (digest)),
n AS (SELECT r, string_agg(DISTINCT notice_id, ',' ORDER BY notice_id) AS notice_ids, count(*) AS n_notices FROM hit GROUP BY r)
SELECT d.doc_id, k.license_id, coalesce(n.notice_ids, '') AS notice_ids, coalesce(n.n_notices, 0) AS n_notices
FROM (SELECT *, {form('text')} AS digest FROM d) d LEFT JOIN known k USING (digest) LEFT JOIN n USING (r)
"""
