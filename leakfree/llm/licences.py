"""Licence scan by canonical digests.

A text's canonical form has lower case, no lines that are copyright notices, blanks in place of punctuation and line ends, and
one of several equivalent spellings. The SHA-256 of the canonical form of an entire text, and of every
line as a text of its own, is joined with the digests of the known texts. DataFrame functions only; the
texts are read once and no text is shuffled.
"""

from __future__ import annotations

import pkgutil
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

# Spellings that count as the same, the second stands for both. Words are parted by two blanks.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("copyright  holder", "copyright  owner"),
    ("copyright  holders", "copyright  owners"), ("emphasised", "emphasized"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("non  commercial", "noncommercial"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("per  cent", "percent"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("sub  license", "sublicense"), ("sub  licence", "sublicense"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("https", "http"),
)
# A notice has a sign, year or holder behind the word or sign; licence prose that is wrapped before it has one of these words or ends.
_PROSE = ("notices?|holders?|owners?|ownership|laws?|licen[cs]es?|interests?|statements?|infringement|protections?|treaty|treaties|permissions?|"
          "rights?|claims?|disclaimers?|messages?|status|and|or|in|is|to|of|on|the|this|that|any|all|as|for|under|by law|can|may|you|your|"
          "an?|no|if|it|its|be|use|do|does|where|with|must|shall|prohibits|affirmer|accompany|convey|provide|each|such|covered|"
          "required|requiring|except|portions?|at|than|when|conditions?|cause|either|not|"
          "patents?|lines?|also|those|are|doctrines?|like|representations")
_NOTICE = rf"[^\p{{L}}\p{{N}}]*+(?!(?:{_PROSE})(?![\p{{L}}\p{{N}}]))[\p{{L}}\p{{N}}]"
COPYRIGHT_LINE = rf"^[^\p{{L}}\p{{N}}(©]*(copyright(?![\p{{L}}\p{{N}}])({_NOTICE}|.*(©|\(c\)))|©|\(c\){_NOTICE}|all rights reserved)"

# Published licence texts and notices by identifier.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
"""
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = (
    ("MIT", "MIT License\n\nCopyright (c) <year> <holders>\n\n" + _MIT_GRANT),
    ("MIT", _MIT_GRANT),
    ("ISC", "ISC License\n\nCopyright (c) <year> <holder>\n\n" + _ISC_GRANT + _ISC_DISCLAIMER),
    ("ISC", _ISC_GRANT + _ISC_DISCLAIMER),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_DISCLAIMER),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
)


_GPL_NOTICE = """This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{stop} {version}

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this program{end}"""
_GPL_ENDS = (
    ". If not, see <https://www.gnu.org/licenses/>.", "; if not, see <https://www.gnu.org/licenses/>.",
    "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "; if not, write to the Free Software Foundation, Inc., 59 Temple Place, Suite 330, Boston, MA 02111-1307 USA.",
)
_GPL_NAMES = (("GPL", "General Public License", ("2", "3")), ("LGPL", "Lesser General Public License", ("2.1", "3")), ("AGPL", "Affero General Public License", ("3",)))
NOTICES = (
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    *[(f"{code}-{v if '.' in v else v + '.0'}-{kind}", _GPL_NOTICE.format(name=name, end=end, version=version.format(v), mark=mark, stop=stop))
      for code, name, versions in _GPL_NAMES for v in versions for end in _GPL_ENDS for mark, stop in ((":", ","), (";", ";"))
      for kind, version in (("or-later", "either version {} of the License, or (at your option) any later version."), ("only", "version {} of the License."))],
)
TITLES = {"BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Zlib": "zlib License"}
TEXTS = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-1.0-only", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.0-only",
         "LGPL-2.1-only", "LGPL-3.0-only", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib")


def known_texts() -> list[tuple[str, str]]:
    """KNOWN, NOTICES and the published texts of TEXTS; those with clauses also without their numbers, some also with a title."""
    out = [*KNOWN, *NOTICES]
    for name in TEXTS:
        data = pkgutil.get_data(__package__, f"licence_texts/{name}.txt").decode()
        for text in {data, re.sub(r"(?m)^\s*\d\. ", "", data)} if name in TITLES else {data}:
            out += [(name, text), (name, f"{TITLES.get(name, '')}\n\n{text}")]
        if "\nAPPENDIX: " in (flat := re.sub(r"(?m)^ +", "", data)):
            out.append((name, flat[:flat.index("\nAPPENDIX: ")]))
        elif name.startswith(("GPL", "LGPL")) and (m := re.search(r"END OF TERMS AND CONDITIONS", data)):
            out += [(name, data[:m.end()]), (name, data[:m.start()])]
    return out


def _spaced(text: Column) -> Column:
    """Lower case without copyright lines and punctuation, spellings made equal; words are parted by two blanks, lines by \\n."""
    lines = F.filter(F.split(F.lower(text), "\n", -1), lambda x: ~x.rlike(COPYRIGHT_LINE))
    out = F.concat(F.lit(" "), F.regexp_replace(F.array_join(lines, " \n "), r"[^\p{L}\p{N}\n]+", "  "), F.lit(" "))
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return out


def _plain(spaced: Column) -> Column:
    """One blank between words, none at the ends."""
    return F.trim(F.regexp_replace(spaced, r"[ \n]+", " "))


def _entire(spaced: Column) -> Column:
    """The canonical form of all lines together; spellings of two words are made equal also over line ends."""
    out = F.regexp_replace(spaced, r"[ \n]+", "  ")
    for a, b in EQUIVALENT:
        if " " in a:
            out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return _plain(out)


def canonical(text: Column) -> Column:
    """The canonical form of an entire text; null for null."""
    return _entire(_spaced(text))


def known_digests(spark: SparkSession, texts=None) -> DataFrame:
    """(digest, license, size): known texts by the digest of their canonical form; a digest has its smallest identifier.

    ``texts`` has pairs of identifier and text; without it these are ``known_texts()``.
    """
    form = canonical(F.col("text"))
    known = spark.createDataFrame(list(known_texts() if texts is None else texts), "license string, text string").select("license", form.alias("form")).where("form <> ''")
    return known.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"), F.max(F.length("form")).alias("size"))


def license_scan(docs: DataFrame, known: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, unit, digest, license, n): a ``text`` row per document and a ``line`` row per licence line.

    A ``text`` row has the digest of the entire text's canonical form and the licence known by it, if any.
    A ``line`` row stands for ``n`` lines of rows with this key that are, as texts of their own, known by
    the digest. Texts that are null or have no word have no digest and no licence. Null keys and repeated
    rows are kept (their lines are counted together), an empty table gives no rows, other columns are not read.
    Only lines as long as some known text are hashed: the lengths of the known texts go to the driver.
    """
    known = stored(known.select("digest", "license", "size"), "known")
    sizes = sorted(r.size for r in known.select("size").distinct().collect())
    spaced = docs.select(F.col(key).cast("long").alias("key"), _spaced(F.col(text).cast("string")).alias("spaced"))
    forms = spaced.select("key", _entire(F.col("spaced")).alias("form"), F.transform(F.split("spaced", "\n", -1), _plain).alias("lines"))
    hashed = stored(forms.select(
        "key", F.when(F.col("form") != "", F.sha2("form", 256)).alias("digest"),
        F.transform(F.filter("lines", lambda x: F.length(x).isin(sizes)), lambda x: F.sha2(x, 256)).alias("lines")), "digests")
    known = known.drop("size")
    whole = hashed.select("key", F.lit("text").alias("unit"), "digest").join(known, "digest", "left").select(
        "key", "unit", "digest", "license", F.lit(1).cast("long").alias("n"))
    lines = hashed.select("key", F.explode("lines").alias("digest")).join(known, "digest").groupBy("key", "digest", "license").agg(
        F.count("*").alias("n")).select("key", F.lit("line").alias("unit"), "digest", "license", "n")
    return whole.union(lines)


def op3_licences(docs: DataFrame) -> DataFrame:
    """doc_id, unit, digest, license, n of all documents against the known texts."""
    return license_scan(docs, known_digests(docs.sparkSession)).withColumnRenamed("key", "doc_id")


def _oracle() -> str:
    """The same in SQL."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    head, gap, end = r"^[^\p{L}\p{N}(©]*", r"[^\p{L}\p{N}]", r"([^\p{L}\p{N}]|$)"

    def notice(word: str, gaps: str) -> str:
        """A notice: the word or sign and behind it a word that is not prose. This engine has no lookahead, hence two conditions."""
        return (f"(regexp_matches(x, '{head}{word}{gaps}[\\p{{L}}\\p{{N}}]') "
                f"and not regexp_matches(x, '{head}{word}{gaps}({_PROSE}){end}'))")

    dropped = " or ".join([
        f"regexp_matches(x, '{head}(©|all rights reserved)')", f"regexp_matches(x, '{head}copyright((©|\\(c\\))|{gap}.*(©|\\(c\\)))')",
        notice("copyright", f"{gap}+"), notice("\\(c\\)", f"{gap}*")])
    spaced = (f"' ' || regexp_replace(array_to_string(list_filter(string_split(lower(text), chr(10)), lambda x: not ({dropped})), "
              f"' ' || chr(10) || ' '), '[^\\p{{L}}\\p{{N}}\\n]+', '  ', 'g') || ' '")
    for a, b in EQUIVALENT:
        spaced = f"replace({spaced}, ' {a} ', ' {b} ')"

    def plain(x: str) -> str:
        return f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"

    def entire(x: str) -> str:
        out = f"regexp_replace({x}, '[ \\n]+', '  ', 'g')"
        for a, b in EQUIVALENT:
            if " " in a:
                out = f"replace({out}, ' {a} ', ' {b} ')"
        return plain(out)

    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in known_texts())
    return f"""
with raw(license, text) as (values {values}),
known as (select sha256(form) as digest, min(license) as license from (select license, {entire('s')} as form from (select license, {spaced} as s from raw)) where form <> '' group by 1),
spaced as (select doc_id, {spaced} as s from documents),
whole as (select doc_id, {entire('s')} as form from spaced),
lines as (select doc_id, unnest(list_transform(string_split(s, chr(10)), lambda x: {plain('x')})) as form from spaced)
select w.doc_id, 'text' as unit, w.digest, k.license, 1::bigint as n
from (select doc_id, case when form <> '' then sha256(form) end as digest from whole) w left join known k on w.digest = k.digest
union all
select l.doc_id, 'line', k.digest, k.license, count(*)::bigint from lines l join known k on sha256(l.form) = k.digest group by 1, 3, 4"""


ORACLE = _oracle()
