"""Licence scan by canonical digests.

A text is brought to a canonical form (lower case, no copyright lines, one space for
all punctuation, one spelling of equivalent words), and its digest is looked up among
those of known licences by a hash join.  Looked up are the entire text, each of its lines,
as a notice is often a line of its own, and what begins at a line and goes on over further
ones: as many characters as a known text has, to the end of a word.  That finds a wrapped
notice or a whole licence within a longer text.  No part is compared otherwise.

Known are the lines and short texts below, and those in the folder ``license_texts``, one
file each, named by the licence; with and without what follows the terms.

Spelling rules and digests are dear, so they are applied only where a match is possible:
the first words are those of a known licence, in one of their spellings, and the length is
at most twice the greatest one that begins so, as no rule shortens a text by half.  What
goes on over lines is followed until such a text must be over; lines without a word are
passed over.

Defined results: null, empty and other texts match nothing; repeated rows are matched
one by one; of several licences with one canonical text the first name counts; an
empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# --- fixed values: equivalent spellings and known licence texts ---------------------

SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelled", "labeled"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
    "software and associated documentation files (the \"Software\"), to deal in the Software "
    "without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
    "to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
    "without fee is hereby granted, provided that the above copyright notice and this permission "
    "notice appear in all copies. "
)
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO "
    "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
    "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
    "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
    "OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution. "
)
_BSD_ENDORSEMENT = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used "
    "to endorse or promote products derived from this software without specific prior written "
    "permission. "
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
    "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

KNOWN = (
    ("MIT", _MIT_GRANT),
    ("MIT", "MIT License " + _MIT_GRANT),
    ("MIT", "The MIT License (MIT) " + _MIT_GRANT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC_GRANT + _ISC_WARRANTY),
    ("ISC", "ISC License " + _ISC_GRANT + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_CONDITIONS + _BSD_WARRANTY),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_CONDITIONS + _BSD_ENDORSEMENT + _BSD_WARRANTY),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
)

# --- canonical form -----------------------------------------------------------------

COPYRIGHT_LINE = (
    r"(^|\n)[^a-z0-9\n]*(copyright[^a-z\n]*[0-9]{4}|copyright *\(c\)|copyright *©"
    r"|\(c\) *[0-9c]|©|all rights reserved)[^\n]*"
)
#: A name before the year, or the places of both in a form.
NAMED_COPYRIGHT = (
    r"(^|\n)[^a-z0-9\n]*copyright [^\n]{1,120}?(\b[0-9]{4}|\byyyy\b)[^a-z\n]*"
    r"(all rights reserved|name of copyright owner|<[^>\n]*>)?[^a-z\n]*(?=\n|$)"
    r"|(^|\n)[^a-z0-9\n]*copyright \[yyyy\][^\n]*"
)
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
TEXTS = Path(__file__).with_name("license_texts")
END = "END OF TERMS AND CONDITIONS"


def known_texts() -> tuple:
    """All known (license, text): ``KNOWN`` and the files, read by the driver."""
    rows = list(KNOWN)
    for file in sorted(TEXTS.glob("*.txt")):
        name, text = file.stem.split("~")[0], file.read_text(encoding="utf-8")
        rows.append((name, text))
        if END in text:
            rows.append((name, text[: text.index(END) + len(END)]))
            rows.append((name, text[: text.index(END)]))
    ids = sorted({name for name, _ in rows})
    return tuple(rows + [(name, f"SPDX-License-Identifier: {name}") for name in ids])


def squeezed(text: Column) -> Column:
    """Lower case, no copyright lines, a space for all but letters, digits and line ends."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"{COPYRIGHT_LINE}|{NAMED_COPYRIGHT}", "\n")
    return F.regexp_replace(plain, PUNCTUATION, " ")


def spelled(text: Column) -> Column:
    """One spelling for equivalent words; single spaces."""
    text = F.regexp_replace(text, r"[ \n]+", " ")
    for word, same in SPELLINGS:
        text = F.regexp_replace(text, rf"\b{word}\b", same)
    return F.trim(text)


def first_words(canonical: list[str]) -> list[str]:
    """Words a text may begin with that has one of these canonical forms."""
    found = {c.split(" ")[0] for c in canonical}
    while True:
        more = {w.split(" ")[0] for w, same in SPELLINGS if same.split(" ")[0] in found}
        if more <= found:
            return sorted(found)
        found |= more


#: A text's first words, by which known ones are told apart before they are compared.
FIRST = 3
#: Characters in which a known text has begun, and how much longer than its canonical form
#: a text may be, spaces and line ends aside, that has another spelling.
HEAD, SPREAD = 400, 2


def beginning(canonical: Column) -> Column:
    return F.substring_index(canonical, " ", FIRST)


def scan_licenses(
    docs: DataFrame, known: tuple | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: id, license (of the entire text), n_license_lines, line_licenses.

    Lines that are a known text count, and places where one of several lines begins; the
    lines may be as short, and as far apart, as they like.  Rows that repeat id and text
    have the same result each.
    """
    known = known_texts() if known is None else known
    rows = docs.sparkSession.createDataFrame(list(known), "license string, text string").select(
        "license", spelled(squeezed(F.col("text"))).alias("canonical")
    )
    canonical = [r["canonical"] for r in rows.collect()]  # a row per known licence text
    starts, lengths = first_words(canonical), {}
    for c in canonical:
        lengths.setdefault(" ".join(c.split(" ")[:FIRST]), set()).add(len(c))
    table = [x for k, ns in sorted(lengths.items()) for x in (F.lit(k), F.array(*map(F.lit, sorted(ns))))]
    by_beginning = F.create_map(*table) if table else F.lit(None).cast("map<string,array<int>>")
    digests = rows.groupBy(F.sha2("canonical", 256).alias("digest")).agg(
        F.min("license").alias("license")
    )
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))

    def known_lengths(lines: Column, k: Column) -> Column:
        """Lengths of the known texts that begin as line k and those after it, or null.

        Every line has a word, so a beginning is over after a few of them; of longer ones
        than ``HEAD`` characters no known text is made.
        """
        first = F.regexp_extract(F.get(lines, k), r"^ *([^ ]+)", 1)
        head = F.left(F.array_join(F.slice(lines, k + 1, F.lit(2 * FIRST)), "\n"), F.lit(HEAD))
        return F.when(first.isin(starts), by_beginning[beginning(spelled(head))])

    def bounded(s: Column, ns: Column) -> Column:
        """Whether a text is short enough to be one of the known ones in some spelling."""
        return F.length(F.translate(s, " \n", "")) <= SPREAD * F.array_max(ns)

    def units(text: Column) -> Column:
        def unit(entire: bool, s: Column, line: Column, place: Column, several: bool, ns: Column) -> Column:
            parts = {
                "entire": F.lit(entire), "s": s, "line": line, "place": place.cast("int"),
                "several": F.lit(several), "ns": ns,
            }
            return F.struct(*[c.alias(name) for name, c in parts.items()])

        def following(lines: Column, x: Column) -> Column:
            """Line k and all after it that a known text of these lengths could reach.

            That text has at most SPREAD times its length in letters, none of the lines is
            without one, and inside a line no two spaces meet: no part of it is cut off.
            """
            letters = SPREAD * F.array_max(x["ns"])
            reach = F.slice(lines, x["k"] + 1, letters.cast("int"))
            return F.left(F.array_join(reach, "\n"), 4 * letters)

        def with_lines(lines: Column) -> Column:
            begun = F.filter(
                F.transform(
                    lines,
                    lambda s, k: F.struct(s.alias("s"), k.alias("k"), known_lengths(lines, k).alias("ns")),
                ),
                lambda x: x["ns"].isNotNull(),
            )
            no_line = F.lit("")

            def with_begun(begun: Column) -> Column:
                whole = F.filter(begun, lambda x: (x["k"] == 0) & bounded(text, x["ns"]))
                alone = F.filter(begun, lambda x: bounded(x["s"], x["ns"]))
                runs = F.filter(begun, lambda x: x["k"] < F.size(lines) - 1)
                return F.concat(
                    F.transform(whole, lambda x: unit(True, text, no_line, F.lit(-1), False, x["ns"])),
                    F.transform(alone, lambda x: unit(False, x["s"], no_line, x["k"], False, x["ns"])),
                    F.transform(
                        runs, lambda x: unit(False, following(lines, x), x["s"], x["k"], True, x["ns"])
                    ),
                )

            return let(begun, with_begun)

        # Lines without a word say nothing, however many there are.
        return let(F.filter(F.split(text, "\n", -1), lambda s: F.trim(s) != ""), with_lines)

    exploded = docs.select(
        F.col(id_col).alias("id"),
        key.alias("key"),
        F.explode(let(squeezed(F.col(text_col)), units)).alias("unit"),
    ).select("id", "key", "unit.*")

    def spans(c: Column) -> Column:
        """What is looked up: all, or of several lines the beginnings longer than the first."""
        line = F.length(spelled(F.col("line")))
        ends = F.filter(
            F.col("ns"), lambda n: (n > line) & F.substring(c, n + 1, F.lit(1)).isin(["", " "])
        )
        return F.when(~F.col("several"), F.array(c)).otherwise(
            F.transform(ends, lambda n: F.left(c, n))
        )

    # Rows that repeat id and text share a group: a place counts once in it.
    place = F.when(~F.col("entire"), F.struct("place", "several"))
    matched = (
        exploded.select(
            "id", "key", "entire", "place", "several",
            F.explode(let(spelled(F.col("s")), spans)).alias("span"),
        )
        .select("id", "key", "entire", "place", "several", F.sha2("span", 256).alias("digest"))
        .join(F.broadcast(digests), "digest")  # a row per known licence text
        .groupBy("id", "key")
        .agg(
            F.min(F.when(F.col("entire"), F.col("license"))).alias("license"),
            F.size(F.collect_set(place)).alias("lines"),
            F.sort_array(F.collect_set(F.when(~F.col("entire"), F.col("license")))).alias("names"),
        )
    )
    return (
        docs.select(F.col(id_col).alias("id"), key.alias("key"))
        .alias("d")
        .join(
            matched.alias("m"),
            F.col("d.id").eqNullSafe(F.col("m.id")) & (F.col("d.key") == F.col("m.key")),
            "left",
        )
        .select(
            F.col("d.id").alias(id_col),
            "license",
            F.coalesce("lines", F.lit(0)).cast("long").alias("n_license_lines"),
            F.coalesce(F.array_join("names", ","), F.lit("")).alias("line_licenses"),
        )
    )
