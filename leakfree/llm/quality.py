"""Quality rules: base counts, and the divergence of a document's histograms from its language's.

Histogram one counts the characters of a text by class, histogram two its words by a language's common words,
all other words together. The reference of a language is the sum of the histograms of all its documents.
The distance of two histograms is the Jensen-Shannon distance (base 2, 0 to 1); a document has that to the
nearest reference, as labels may be missing or wrong. It fails if a distance exceeds its limit and it
is long enough for the histogram to say something. Everything is DataFrame
functions; whole texts are read once, what follows moves a few numbers per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import SPACE, WORD

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_CHARACTER_DISTANCE = 0.2
MIN_CHARACTERS = 300
MAX_WORD_DISTANCE = 0.34
MIN_COUNTED_WORDS = 100
COMMON_SHARE = 1000
"""Labels of at least one in so many labelled documents are references for all documents, any other label for its own."""

# Common words by language.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
}
COMMON_WORDS |= {
    "cs": ("a", "v", "se", "na", "je", "že", "s", "z", "do", "to", "o", "i"),
    "da": ("og", "i", "at", "er", "det", "en", "til", "af", "på", "for", "som", "der"),
    "el": ("και", "το", "να", "του", "η", "της", "με", "που", "την", "από", "για", "είναι"),
    "fi": ("ja", "on", "ei", "se", "että", "oli", "hän", "mutta", "myös", "kun", "tai", "joka"),
    "hu": ("a", "az", "és", "hogy", "nem", "is", "egy", "ez", "meg", "volt", "de", "csak"),
    "it": ("di", "e", "il", "la", "che", "in", "a", "per", "un", "è", "del", "non"),
    "nl": ("de", "het", "een", "van", "en", "in", "is", "dat", "op", "te", "zijn", "met"),
    "pl": ("w", "i", "na", "z", "się", "do", "nie", "jest", "że", "to", "o", "od"),
    "pt": ("de", "a", "o", "que", "e", "do", "da", "em", "um", "para", "os", "com"),
    "ro": ("de", "și", "în", "a", "la", "cu", "care", "nu", "din", "pe", "o", "un"),
    "ru": ("и", "в", "не", "на", "что", "с", "он", "как", "по", "это", "к", "из"),
    "sv": ("och", "i", "att", "det", "som", "en", "på", "är", "av", "för", "med", "den"),
    "tr": ("ve", "bir", "bu", "da", "de", "için", "ile", "çok", "ne", "olarak", "daha", "gibi"),
}
CLASSES = ("lower", "upper", "digit", "space", "mark", "other")


_SYMBOLS = "[#*$%&|<>]"
_CLASS_PATTERNS = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": "[0-9]", "mark": r"[!-/:-@\[-`{-~]"}


def _matches(text: Column, pattern: str) -> Column:
    """How many characters match a one-character pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _occurrences(padded: Column, word: str) -> Column:
    """How often a word stands in a text whose words have blanks of their own on both sides."""
    gone = F.length(padded) - F.length(F.replace(padded, F.lit(f" {word} "), F.lit("")))
    return (gone / F.lit(len(word) + 2)).cast("long")


def worded_labels(docs: DataFrame, lang: str = "lang") -> list[str]:
    """The languages of COMMON_WORDS that are labels in the table; no other can have a word reference."""
    found = docs.select(F.col(lang).cast("string").alias("lang")).where(F.col("lang").isin(list(COMMON_WORDS))).distinct()
    return sorted(r.lang for r in found.collect())


def measured(docs: DataFrame, codes: list[str], text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """(key, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_plain, chars, <language>...) per row.

    ``chars`` has the counts of CLASSES, the column of each language in ``codes`` those of its common words and of all other
    words. Repeated windows are found by sorting the windows' 64-bit hashes with their places: those with an
    equal neighbour are repeated, and their places, sorted, cover up to three words each. Arrays that
    lambdas look into are columns of their own, so that they are made once per row.
    """
    t = F.col("t")
    common = sorted({w for c in codes for w in COMMON_WORDS[c]})
    start = docs.select(
        F.col(key).cast("long").alias("key"), F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    split = start.select(
        "key", "lang", "t", F.array_remove(F.split(t, SPACE), "").alias("words"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
        F.array_remove(F.split(F.lower(t), r"[^\p{L}]+"), "").alias("plain"))
    n = F.size("words")
    counted = split.select(
        "key", "lang", n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _matches(t, _SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n > 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
            F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i"))))).alias("windows"),
        *[_matches(t, p).alias(f"n_{c}") for c, p in _CLASS_PATTERNS.items()],
        F.length(t).alias("n_chars"), F.size("plain").alias("n_plain"),
        F.concat(F.lit(" "), F.array_join(F.filter("plain", lambda x: x.isin(common)), "  "), F.lit(" ")).alias("padded"))
    space = F.col("n_chars") - F.col("word_chars")
    other = F.col("word_chars") - F.col("n_lower") - F.col("n_upper") - F.col("n_digit") - F.col("n_mark")
    twins = counted.select(
        "key", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_plain",
        F.filter("windows", lambda x, k: (x["h"] == F.get("windows", k - 1)["h"]) | (x["h"] == F.get("windows", k + 1)["h"])).alias("twins"),
        F.array(*[c.cast("long") for c in (F.col("n_lower"), F.col("n_upper"), F.col("n_digit"), space, F.col("n_mark"), other)]).alias("chars"),
        *[F.array(*[_occurrences(F.col("padded"), w) for w in COMMON_WORDS[code]]).alias(code) for code in codes])
    placed = twins.withColumn("places", F.sort_array(F.transform("twins", lambda x: x["i"])))
    covered = F.aggregate(
        "places", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(F.lit(3), i - acc["last"])).alias("sum")),
        lambda acc: acc["sum"])
    return placed.select(
        "key", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_plain", "chars",
        *[F.concat(c, F.array(F.col("n_plain").cast("long") - _total(F.col(c)))).alias(c) for c in codes])


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def references(measures: DataFrame, codes: list[str]) -> dict[str, list[int]]:
    """By language of ``codes`` the summed word histogram of all its documents; languages without any word are left out.

    A fixed number of values comes to the driver.
    """
    columns = {
        f"{code} {i}": F.sum(F.when(F.col("lang") == code, F.get(code, F.lit(i))))
        for code in codes for i in range(len(COMMON_WORDS[code]) + 1)}
    if not columns:
        return {}
    row = measures.agg(*[c.alias(n) for n, c in columns.items()]).first()
    found = {code: [row[f"{code} {i}"] or 0 for i in range(len(COMMON_WORDS[code]) + 1)] for code in codes}
    return {code: counts for code, counts in found.items() if sum(counts)}


def character_references(measures: DataFrame) -> DataFrame:
    """(lang, shares, common): the character shares of every label with characters, and whether it is a common one."""
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))]
    total = sum((F.col(f"c{i}") for i in range(1, len(CLASSES))), F.col("c0"))
    shares = F.array(*[F.col(f"c{i}") / total for i in range(len(CLASSES))]).alias("shares")
    labels = stored(measures.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n"), *sums), "labels")
    whole = labels.agg(F.sum("n").alias("all"))
    return labels.crossJoin(whole).where(total > 0).select("lang", shares, (F.col("n") * COMMON_SHARE >= F.col("all")).alias("common"))


def divergence(histogram: Column, reference: list[int] | Column) -> Column:
    """Jensen-Shannon distance (base 2) of an array of counts to a reference, counts or a column of shares; null for an empty histogram."""
    shares = reference if isinstance(reference, Column) else F.array(*[F.lit(r / sum(reference)) for r in reference])

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(p * 2 / (p + q))).otherwise(0.0)

    total = _total(histogram)
    terms = F.zip_with(F.transform(histogram, lambda x: F.try_divide(x.cast("double"), total)), shares, lambda p, q: part(p, q) + part(q, p))
    summed = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.sqrt(F.greatest(summed / 2, F.lit(0.0))))


def _nearest(distances: list[Column]) -> Column:
    if len(distances) > 1:
        return F.least(*distances)
    return distances[0] if distances else F.lit(None).cast("double")


def judged(measures: DataFrame, codes: list[str]) -> DataFrame:
    """``measures`` with char_distance, word_distance, base_failed and kept.

    Characters are held against the common labels of the table, which are at most COMMON_SHARE, and against the document's
    own; words against the labels of the table that have common words (``codes``). A distance is null without a reference, for
    words also if the document's label has none, or with an empty histogram; such documents, and those too
    short for a distance to mean something, are judged by the base rules alone.
    """
    found = references(measures, codes)
    labels = stored(character_references(measures), "labels")
    common = labels.where("common").agg(F.collect_list("shares").alias("refs"))  # one row, bounded
    held = measures.join(labels.select("lang", F.array("shares").alias("own")), "lang", "left").crossJoin(common)
    refs = F.concat("refs", F.coalesce("own", F.array().cast("array<array<double>>")))
    char = F.array_min(F.transform(refs, lambda r: divergence(F.col("chars"), r)))
    word = _nearest([divergence(F.col(c), counts) for c, counts in found.items()])
    n_chars = _total(F.col("chars"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    far = (
        F.coalesce((n_chars >= MIN_CHARACTERS) & (F.col("char_distance") > MAX_CHARACTER_DISTANCE), F.lit(False))
        | F.coalesce((F.col("n_plain") >= MIN_COUNTED_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE), F.lit(False)))
    # a label without a word reference: words say nothing, the base and character rules judge
    worded = F.col("lang").isNull() | F.col("lang").isin(list(found))
    return held.withColumns({"char_distance": char, "word_distance": F.when(worded, word)}).withColumns(
        {"base_failed": failed, "kept": ~failed & ~far}).drop("refs", "own")


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Every row's measures and verdict.

    A null text has no words and fails the base rules, as does an empty one. Null keys and repeated rows are
    kept as they are, an empty table gives no rows, other columns are not read.
    """
    codes = worded_labels(docs, lang)
    return judged(stored(measured(docs, codes, text, lang, key), "quality"), codes)


def op4_quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept."""
    return quality(docs).select(
        F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    """The same in SQL."""
    common = ", ".join(f"('{code}', {i}, '{w}')" for code, words in COMMON_WORDS.items() for i, w in enumerate(words))
    slots = ", ".join(f"('{code}', {i})" for code, words in COMMON_WORDS.items() for i in range(len(words) + 1))
    spaces = r"[\x20\x09-\x0D]+"
    classes = ", ".join(f"length(t) - length(regexp_replace(t, '{p}', '', 'g')) as n_{c}" for c, p in _CLASS_PATTERNS.items())
    chars = "[n_lower, n_upper, n_digit, length(t) - word_chars, n_mark, word_chars - n_lower - n_upper - n_digit - n_mark]"
    part = "case when {0} > 0 then {0} * log2({0} * 2 / ({0} + {1})) else 0.0 end"
    return f"""
with start as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t from documents),
split as (select *, list_filter(regexp_split_to_array(t, '{spaces}'), lambda x: x <> '') as words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines,
  list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}]+'), lambda x: x <> '') as plain from start),
win as (select rid, i, words[i] as a, words[i + 1] as b, words[i + 2] as c
  from (select rid, words, unnest(range(1, len(words) - 1)) as i from split)),
twin as (select rid, i from win qualify count(*) over (partition by rid, a, b, c) > 1),
cover as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from twin) group by rid),
counted as (select rid, doc_id, lang, len(words) as n_words, length(list_aggregate(words, 'string_agg', '')) as wc,
  length(t) - length(regexp_replace(t, '{_SYMBOLS}', '', 'g')) as n_symbols,
  len(lines) - len(list_distinct(lines)) as n_dup_lines, t, len(plain) as n_plain, {classes} from split),
base as (select *, coalesce(wc, 0) as word_chars from counted),
hist as (select rid, lang, {chars} as h from base),
charhist as (select rid, lang, unnest(range(0, 6)) as slot, unnest(h) as n from hist),
common(code, slot, word) as (values {common}), slots(code, slot) as (values {slots}),
hits as (select s.rid, c.code, c.slot, count(*) as n from (select rid, unnest(plain) as word from split) s join common c using (word) group by all),
listed as (select rid, code, sum(n) as n from hits group by all),
wordhist as (select b.rid, b.lang, s.code, s.slot, case when h.n is not null then h.n
    when s.slot = {len(COMMON_WORDS["en"])} then b.n_plain - coalesce(l.n, 0) else 0 end as n
  from base b cross join slots s left join hits h on h.rid = b.rid and h.code = s.code and h.slot = s.slot
  left join listed l on l.rid = b.rid and l.code = s.code),
labelled as (select lang, count(*) as n from base where lang is not null group by lang),
charref as (select h.lang as code, h.slot, sum(h.n) as n from charhist h where h.lang is not null group by all),
wordref as (select code, slot, sum(n) as n from wordhist where lang = code group by all),
usable as (select code from wordref group by code having sum(n) > 0),
charshare as (select c.code, slot, c.n / nullif(sum(c.n) over (partition by c.code), 0) as q, l.n * {COMMON_SHARE} >= (select sum(n) from labelled) as common
  from charref c join labelled l on l.lang = c.code),
wordshare as (select code, slot, n / sum(n) over (partition by code) as q from wordref where code in (from usable)),
charterm as (select h.rid, r.code, r.q, h.n / nullif(sum(h.n) over (partition by h.rid, r.code), 0) as p
  from charhist h join charshare r on r.slot = h.slot and r.q is not null and (r.common or r.code = h.lang)),
wordterm as (select h.rid, r.code, r.q, h.n / nullif(sum(h.n) over (partition by h.rid, r.code), 0) as p from wordhist h join wordshare r using (code, slot)
  where h.lang is null or h.lang in (from usable)),
chardist as (select rid, min(d) as d from (select rid, code, sqrt(greatest(sum({part.format('p', 'q')} + {part.format('q', 'p')}) / 2, 0)) as d
  from charterm where p is not null group by all) group by rid),
worddist as (select rid, min(d) as d from (select rid, code, sqrt(greatest(sum({part.format('p', 'q')} + {part.format('q', 'p')}) / 2, 0)) as d
  from wordterm where p is not null group by all) group by rid),
joined as (select b.*, coalesce(c.n, 0) as n_repeat_words, cd.d as cd, wd.d as wd from base b
  left join cover c using (rid) left join chardist cd using (rid) left join worddist wd using (rid))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words,
  n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words
    or coalesce(length(t) >= {MIN_CHARACTERS} and cd > {MAX_CHARACTER_DISTANCE}, false)
    or coalesce(n_plain >= {MIN_COUNTED_WORDS} and wd > {MAX_WORD_DISTANCE}, false)) as kept
from joined"""


ORACLE = _oracle()
