"""License scans by canonical digest lookup.

A text is brought to a canonical form: lower case, copyright lines and a lone "all
rights reserved" taken out, equivalent spellings made one, and every run of anything
but letters and digits turned into one blank. The SHA-256 of that form is joined to the
digests of known licence texts, which are made by the same expression. Whole texts are
looked up; each line is looked up as a text of its own too, which finds licence notices.

Everything is a DataFrame expression. The known texts are a fixed list of a few
kilobytes, so their digests are broadcast. Null and empty texts have the digest of an
empty text, which is no licence. Rows are told apart by id and text: rows alike in both
get the same result and are all kept. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COPYRIGHT = r"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|©)[^a-z\n]*(?:\(c\)|©|[0-9]{4})[^\n]*$"
RESERVED = r"(?m)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
OTHER = r"[^\p{L}\p{N}]+"

#: Spellings that licence matching treats as equivalent.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("artefact", "artifact"), ("authoris", "authoriz"), ("copyright owner", "copyright holder"),
    ("favour", "favor"), ("initialis", "initializ"), ("licence", "license"), ("maximis", "maximiz"), ("noncommercial", "non commercial"),
    ("organis", "organiz"), ("percent", "per cent"), ("recognis", "recogniz"), ("sublicence", "sublicense"), ("utilis", "utiliz"), ("wilful", "willful"),
]

_WARRANTY_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_WARRANTY_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_ISC_HEAD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Known licence texts and notices, with their SPDX names.
KNOWN = [
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY_MIT),
    ("BSD-2-Clause", _BSD_HEAD + "\n" + _WARRANTY_BSD),
    ("BSD-3-Clause", _BSD_HEAD + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _WARRANTY_BSD),
    ("ISC", f"ISC License\n\n{_ISC_HEAD}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_TAIL}"),
    ("0BSD", f"{_ISC_HEAD}.\n\n{_ISC_TAIL}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "CC0 1.0 Universal. To the extent possible under law, the author has dedicated all copyright to this work to the public domain worldwide."),
]


def canonical(text: Column) -> Column:
    """The canonical form of a text, as a string expression."""
    x = F.lower(F.coalesce(text, F.lit("")))
    x = F.regexp_replace(F.regexp_replace(x, COPYRIGHT, " "), RESERVED, " ")
    x = F.trim(F.regexp_replace(x, OTHER, " "))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession) -> DataFrame:
    """(digest, license_id) of the fixed list."""
    rows = spark.createDataFrame(KNOWN, "license_id string, text string")
    return rows.select(digest(F.col("text")).alias("digest"), "license_id").dropDuplicates(["digest"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, license_id, notices): the licence that a whole text is, and the notices among its lines."""
    lookup = F.broadcast(known(docs.sparkSession))
    # a line can only be a notice if its letters allow it; every line is hashed all the same
    lines = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    found = lines.where(F.length("line") > 0).select("rid", digest(F.col("line")).alias("digest")).join(lookup, "digest").groupBy("rid").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    whole = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), digest(F.col("text")).alias("digest")).join(lookup, "digest", "left")
    return whole.join(found, "rid", "left").select("doc_id", "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))


def _sql_canonical(x: str) -> str:
    q = lambda s: s.replace("'", "''")
    out = f"lower(coalesce({x}, ''))"
    for p in (COPYRIGHT, RESERVED):
        out = f"regexp_replace({out}, '{q(p)}', ' ', 'g')"
    out = f"trim(regexp_replace({out}, '{q(OTHER)}', ' ', 'g'))"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def oracle() -> str:
    """DuckDB SQL for ``scan`` over documents."""
    q = lambda s: s.replace("'", "''")
    rows = ", ".join(f"('{i}', '{q(t)}')" for i, t in KNOWN)
    return f"""
    WITH known AS (SELECT DISTINCT sha256({_sql_canonical('t')}) AS digest, id FROM (VALUES {rows}) k(id, t)),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    found AS (SELECT l.doc_id, string_agg(DISTINCT k.id, ',' ORDER BY k.id) AS notices FROM lines l JOIN known k ON sha256({_sql_canonical('l.line')}) = k.digest WHERE length(l.line) > 0 GROUP BY l.doc_id),
    whole AS (SELECT doc_id, sha256({_sql_canonical('text')}) AS digest FROM documents)
    SELECT w.doc_id, w.digest, k.id AS license_id, coalesce(f.notices, '') AS notices
    FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN found f ON w.doc_id = f.doc_id"""
