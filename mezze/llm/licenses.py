"""License scans by canonical digest: whole texts, and whole lines, are normalised, hashed and joined to known licenses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Short license texts and notices as their authors publish them, with equivalent spellings of words.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n'
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
KNOWN = [
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_AS_IS}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_AS_IS}"),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("organisation", "organization"), ("authorisation", "authorization"), ("recognised", "recognized"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("judgement", "judgment"), ("favour", "favor"), ("behaviour", "behavior"), ("fulfil", "fulfill"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders")]
#: A line that claims a copyright: with a mark, a year or a place for one, so that no wrapped line of a license is one.
COPYRIGHT_LINE = r"(?m)^[^\n\w]*(copyright\b[^\n]*(\(c\)|©|[12][0-9]{3}|[<\[{])|\(c\)|©|all rights reserved)[^\n]*$"
#: A first line that only names the license.
TITLE = r"^[\x20\x09-\x0D]*(the )?(mit|isc|0bsd|bsd|new bsd|modified bsd|simplified bsd|zero[ -]clause bsd|[0-9]-clause bsd|(two|three)[ -]clause bsd)[a-z0-9 .\"-]{0,40}licen[sc]e( \([^\n)]{0,60}\))?:?[\x20\x09\x0B-\x0D]*\n"
#: White space and punctuation between words.
BETWEEN = r"\x20\x09-\x0D\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E“”‘’«»–—…"


def canonical(text: Column) -> Column:
    """Lower case, without a title line and lines that claim a copyright, without punctuation, words in one spelling, one space between."""
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), TITLE, ""), COPYRIGHT_LINE, ""), f"[{BETWEEN}]+", "  ")
    spaced = F.concat(F.lit("  "), spaced, F.lit("  "))
    for other, usual in SPELLINGS:
        spaced = F.replace(spaced, F.lit(" " + other.replace(" ", "  ") + " "), F.lit(" " + usual.replace(" ", "  ") + " "))
    return F.trim(F.replace(spaced, F.lit("  "), F.lit(" ")))


def first_words(known) -> list[str]:
    """Words that a text may open with if it equals one of the catalog: theirs, and other spellings of theirs."""
    opened = {m[0] for _, text in known if (m := re.search(f"[^{BETWEEN}]+", re.sub(COPYRIGHT_LINE, "", re.sub(TITLE, "", text.lower()))))}
    return sorted(opened | {other.split(" ")[0] for other, usual in SPELLINGS if usual.split(" ")[0] in opened})


def catalog(spark: SparkSession, known=KNOWN) -> DataFrame:
    """digest, license: one row for each distinct canonical text of the catalog, which a caller may pass."""
    rows = spark.createDataFrame(known, "license string, text string")
    return rows.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known=KNOWN) -> DataFrame:
    """doc_id, n_words, canonical_sha256, license, line_licenses; one row per input row.

    license: of the known text that the whole text equals in canonical form, else null. line_licenses: sorted licenses of
    the known texts that whole lines equal, empty if none does. A null text is an empty one: no words, no license. Rows that
    share a doc_id and a text get the same values.
    """
    spark = docs.sparkSession
    digests = F.broadcast(catalog(spark, known))  # as many rows as the catalog has
    text = F.coalesce("text", F.lit(""))
    of = F.xxhash64(text)
    whole = docs.select("doc_id", of.alias("of"), canonical(text).alias("c")).select("doc_id", "of", F.when(F.col("c") == "", 0).otherwise(F.length("c") - F.length(F.replace("c", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"), F.sha2("c", 256).alias("canonical_sha256"))
    lines = docs.select("doc_id", of.alias("of"), F.explode(F.split(text, "\n")).alias("line"))
    # Only a line that opens as a known text does can equal it.
    lines = lines.filter(F.regexp_extract(F.lower("line"), f"[^{BETWEEN}]+", 0).isin(first_words(known)))
    lines = lines.withColumn("digest", F.sha2(canonical(F.col("line")), 256)).join(digests, "digest").groupBy("doc_id", "of").agg(F.sort_array(F.collect_set("license")).alias("line_licenses"))
    lines = lines.select(F.col("doc_id").alias("l_id"), F.col("of").alias("l_of"), "line_licenses")
    joined = whole.join(digests.withColumnRenamed("digest", "canonical_sha256"), "canonical_sha256", "left").join(lines, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("of") == F.col("l_of")), "left")
    return joined.select("doc_id", "n_words", "canonical_sha256", "license", F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses"))
