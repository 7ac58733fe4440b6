"""Quality rules by distribution divergence, in DataFrame functions only.

Every document gets two histograms: its characters by class, and the common
words of its language. Both are compared with the reference of the language by
Jensen-Shannon distance. The reference is the mean of the shares of all its
documents and of usual shares, which count as some documents more: a language
with few documents is judged by what is usual, one with many by its own, and
no number of documents switches the rule on. Short documents say too little
about a distribution and are not judged by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailwarden.llm.common import BLANKS, saved, table, unused

MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED = 30  # per cent of the words
SYMBOLS = "#*$%&|<>"
#: Distances beyond which a document is not its language, and the least lengths they are measured on.
MAX_CHARACTER_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.40
#: Beyond both of these together it is not, either.
BOTH_CHARACTER_DISTANCE = 0.145
BOTH_WORD_DISTANCE = 0.25
MIN_CHARACTERS = 200
MIN_HISTOGRAM_WORDS = 40
#: The usual shares count as so many documents in a language's reference.
PRIOR_DOCUMENTS = 20
#: Shares are summed as whole millionths, so that sums do not depend on their order.
UNIT = 1_000_000
EDGES = ".,;:!?\"'()"

#: Common words by language, alphabetical.
COMMON_WORDS = {
    "de": "auf das dem den der des die ein eine für im in ist mit nicht sich und von zu zum",
    "en": "a and are as at be by for from in is it of on that the this to was with",
    "es": "al con de del el en es la las lo los no para por que se su un una y",
    "fr": "au avec dans de des du elle en est et il la le les par pas pour que qui un une",
}
CLASSES = ("upper", "digit", "symbol", "mark", "blank", "letter")
#: Usual shares per thousand in prose of these languages, of the classes in their order and of the words above in theirs.
USUAL_CLASSES = (30, 5, 2, 30, 160, 773)
USUAL_WORDS = {
    "de": (7, 10, 12, 12, 35, 8, 36, 7, 6, 7, 8, 18, 9, 9, 9, 8, 27, 10, 10, 3),
    "en": (21, 28, 5, 7, 5, 6, 5, 9, 4, 20, 10, 10, 33, 7, 11, 60, 5, 26, 9, 7),
    "es": (7, 9, 62, 12, 32, 26, 9, 38, 12, 7, 17, 9, 8, 10, 32, 12, 8, 12, 9, 28),
    "fr": (6, 5, 8, 50, 15, 12, 4, 13, 9, 24, 8, 29, 24, 18, 6, 5, 8, 9, 8, 12, 10),
}
#: The counts and verdicts a judged document has.
MEASURES = ("n_all", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digit", "common", "classes")
VERDICTS = ("base_failed", "character_distance", "word_distance", "kept")


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _without(text: Column, characters: str) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), characters, text)


def repeated_words(words: Column) -> Column:
    """Words inside windows that the text holds at least twice, the first time included.

    Windows are compared by hash. Texts in which all windows differ - most -
    end there; otherwise windows are sorted by hash, those with an equal
    neighbour are taken in order of place, and each covers what the next does
    not. Lambdas bind every array once, so the work is that of a sort.
    """
    once = lambda array, body: F.element_at(F.transform(F.array(array), body), 1)
    places = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(places, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda total, x: total + x)

    def alike(pairs: Column) -> Column:
        h = lambda k: F.get(pairs, k)["h"]
        same = F.transform(pairs, lambda x, k: F.when((x["h"] == h(k - 1)) | (x["h"] == h(k + 1)), x["at"]))
        return once(F.array_sort(F.filter(same, lambda p: p.isNotNull())), covered)

    def judge(found: Column) -> Column:
        pairs = F.transform(found, lambda h, k: F.struct(h.alias("h"), k.alias("at")))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(once(F.sort_array(pairs), alike))

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(once(hashes, judge))


def common_counts(words: Column, lang: Column) -> Column:
    """How often the words of the language's list occur, in the list's order; null without a list."""
    bare = F.transform(words, lambda w: F.lower(F.btrim(w, F.lit(EDGES))))
    out = F.lit(None).cast("array<bigint>")
    for name, listed in COMMON_WORDS.items():
        # two blanks between words, so that neighbours share none
        line = F.concat(F.lit(" "), F.array_join(F.filter(bare, lambda w: w.isin(listed.split())), "  "), F.lit(" "))
        count = lambda text: F.array(*(
            ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(f" {w} "), F.lit("")))) / (len(w.encode()) + 2)).cast("long")
            for w in listed.split()))
        out = F.when(lang == name, F.element_at(F.transform(F.array(line), count), 1)).otherwise(out)
    return out


def measures(docs: DataFrame, language: str = "_lang") -> DataFrame:
    """The columns of ``docs`` without its text, its language, and all counts the rules use.

    Columns of ``docs`` that are named like a count or a verdict give way to it.
    """
    held = [c for c in docs.columns if c.lower() not in ("text", *MEASURES, *VERDICTS)]
    text_column, word_column = unused(docs, "_t", "_w")
    text = F.coalesce(docs["text"], F.lit(""))
    t, w = F.col(text_column), F.col(word_column)
    lang = docs["lang"] if "lang" in docs.columns else F.lit(None).cast("string")
    cut = docs.select(
        *(docs[c] for c in held), lang.alias(language), text.alias(text_column),
        F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "").alias(word_column))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    lang = F.col(language)
    counted = cut.select(
        *held,
        language,
        F.char_length(t).cast("long").alias("n_all"),
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.octet_length(t) - F.octet_length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(t, F.lit(r"[0-9]")).cast("long").alias("n_digit"),
        F.regexp_count(t, F.lit(r"[!-/:-@\[-`{-~]")).cast("long").alias("_ascii_marks"),
        common_counts(w, lang).alias("common"),
    )
    mark = F.col("_ascii_marks") - F.col("n_symbols")
    blank = F.col("n_all") - F.col("word_chars")
    rest = F.col("n_all") - F.col("n_upper") - F.col("n_digit") - F.col("_ascii_marks") - blank
    return counted.select(
        *(c for c in counted.columns if c != "_ascii_marks"),
        F.array("n_upper", "n_digit", "n_symbols", mark, blank, rest).alias("classes"),
    )


def _shares(counts: Column, total: Column) -> Column:
    """Counts and what is left of the total, as whole millionths."""
    rest = total - F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)
    return F.transform(F.concat(counts, F.array(rest)), lambda c: F.floor(c * UNIT / total))


def _usual() -> dict[str, tuple[list[int], list[int]]]:
    """Per listed language what the usual shares add to the sums, in the order of a document's histograms."""
    out = {}
    for lang, listed in COMMON_WORDS.items():
        whole = [[*shares, 1000 - sum(shares)] for shares in (USUAL_CLASSES, USUAL_WORDS[lang])]
        assert len(whole[1]) == len(listed.split()) + 1
        out[lang] = tuple([x * UNIT // 1000 * PRIOR_DOCUMENTS for x in shares] for shares in whole)
    return out


def references(measured: DataFrame, language: str = "_lang") -> DataFrame:
    """Per language the summed shares of the usual and of all documents long enough to be judged by them: language, ref_classes, ref_words."""
    n_classes, widest = len(CLASSES) + 1, max(len(v.split()) for v in COMMON_WORDS.values()) + 1
    long_enough = (F.col("n_all") >= MIN_CHARACTERS) & (F.col("n_words") >= MIN_HISTOGRAM_WORDS)
    shared = measured.where(long_enough).select(language, _shares(F.col("classes"), F.col("n_all")).alias("c"), _shares(F.col("common"), F.col("n_words")).alias("w"))
    counts = lambda shares: F.array(*(F.lit(x).cast("long") for x in shares))
    usual = [F.struct(F.lit(lang).alias(language), counts(c).alias("c"), counts(w).alias("w")) for lang, (c, w) in _usual().items()]
    usual = measured.sparkSession.range(0, 1, 1, 1).select(F.inline(F.array(*usual)))
    sums = lambda name, n: [F.sum(F.get(F.col(name), F.lit(i))).alias(f"{name}{i}") for i in range(n)]
    summed = shared.unionByName(usual).groupBy(language).agg(*sums("c", n_classes), *sums("w", widest))
    whole = lambda name, n: F.array(*(F.coalesce(F.col(f"{name}{i}"), F.lit(0)).cast("double") for i in range(n)))
    return summed.select(language, whole("c", n_classes).alias("ref_classes"), whole("w", widest).alias("ref_words"))


def distance(counts: Column, total: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) between a document's counts and summed shares."""
    add = lambda a, b: a + b
    zero = F.lit(0.0)
    rest = total - F.aggregate(counts, F.lit(0).cast("long"), add)
    own = F.concat(counts, F.array(rest))
    weight = F.aggregate(reference, zero, add)
    pairs = F.zip_with(own, reference, lambda p, q: F.struct((F.coalesce(p, F.lit(0)) / total).alias("p"), q.alias("q")))

    def term(x: Column, q: Column) -> Column:
        m = (x["p"] + q) / 2
        part = lambda y: F.when(y > 0, y * F.log2(y / m)).otherwise(0.0)
        return (part(x["p"]) + part(q)) / 2

    terms = F.transform(pairs, lambda x: term(x, x["q"] / weight))
    return F.sqrt(F.greatest(F.aggregate(terms, zero, add), zero))


def judge_documents(docs: DataFrame) -> DataFrame:
    """All columns but the text, with the measures, both distances, base_failed and kept.

    Null and empty texts have no words and fail the base rules. A document that
    is too short for a histogram, or whose language (null counts as one) has no
    common words listed, is not judged by it; the character classes of such a
    language are compared with those of its own documents alone. Repeated rows
    are judged each; an empty table gives an empty table. Columns named like a
    count or a verdict give way to it.
    """
    language, of, classes, common = unused(docs, "_lang", "_of", "ref_classes", "ref_words")
    measured = saved(measures(docs, language), "quality-measures")
    refs = saved(references(measured, language), "quality-references").toDF(of, classes, common)
    joined = measured.join(refs, F.col(language).eqNullSafe(F.col(of)), "left")
    words, total = F.col("n_words"), F.col("n_all")
    failed = (words < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * words)
    by_class = F.when(total >= MIN_CHARACTERS, distance(F.col("classes"), total, F.col(classes)))
    by_word = F.when(words >= MIN_HISTOGRAM_WORDS, distance(F.col("common"), words, F.col(common)))
    by = lambda name, limit: F.coalesce(F.col(name) > limit, F.lit(False))
    far = (
        by("character_distance", MAX_CHARACTER_DISTANCE) | by("word_distance", MAX_WORD_DISTANCE)
        | (by("character_distance", BOTH_CHARACTER_DISTANCE) & by("word_distance", BOTH_WORD_DISTANCE))
    )
    out = joined.withColumns({"base_failed": failed, "character_distance": by_class, "word_distance": by_word})
    return out.withColumn("kept", ~F.col("base_failed") & ~far).drop(language, of, classes, common, "classes", "common")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_documents(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("character_distance", 6).alias("character_distance"), F.round("word_distance", 6).alias("word_distance"))


def _sql() -> str:
    """The query's twin: the same counts, references and distances from lists."""
    lists = ", ".join(
        f"('{lang}', [{', '.join(repr(w) for w in listed.split())}])" for lang, listed in COMMON_WORDS.items()
    )
    usual = ", ".join(
        f"('{lang}', '{kind}', {k}, {n})"
        for lang, histograms in _usual().items() for kind, shares in zip("cw", histograms) for k, n in enumerate(shares, 1)
    )
    edges = EDGES.replace("'", "''")
    js = "sqrt(greatest(list_sum(list_transform(list_zip({own}, {ref}), lambda x: ({p} + {q}) / 2)), 0))"

    def distance_sql(own: str, total: str, ref: str) -> str:
        p, q = f"(x[1] / {total})", f"(x[2] / list_sum({ref}))"
        part = lambda y: f"CASE WHEN {y} > 0 THEN {y} * log2({y} / (({p} + {q}) / 2)) ELSE 0 END"
        return js.format(own=own, ref=ref, p=part(p), q=part(q))

    return rf"""
WITH lists(l, listed) AS (VALUES {lists}),
usual(lang, kind, k, s) AS (VALUES {usual}),
cut AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM cut WHERE len(w) >= {WINDOW})
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, sum(least({WINDOW}, coalesce(lead - i, {WINDOW})))::BIGINT AS n
  FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS lead FROM twice) GROUP BY doc_id
), measured AS (
  SELECT c.doc_id, lang, length(t) AS n_all, len(w)::BIGINT AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n, 0) AS n_repeat_words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS n_upper,
    length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digit,
    length(regexp_replace(t, '[^!-/:-@\[-`{{-~]', '', 'g')) AS marks,
    list_transform(w, lambda x: lower(trim(x, '{edges}'))) AS bare
  FROM cut c LEFT JOIN covered USING (doc_id)
), counted AS (
  SELECT m.*, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    [n_upper, n_digit, n_symbols, marks - n_symbols, n_all - word_chars,
     n_all - n_upper - n_digit - marks - (n_all - word_chars)] AS c6,
    list_transform(listed, lambda y: len(list_filter(bare, lambda x: x = y))) AS c_words
  FROM measured m LEFT JOIN lists ON lang = l
), whole AS (
  SELECT *, list_append(c6, n_all - list_sum(c6)::BIGINT) AS classes,
    CASE WHEN c_words IS NOT NULL THEN list_append(c_words, n_words - list_sum(c_words)::BIGINT) END AS common
  FROM counted
), shares AS (
  SELECT lang, 'c' AS kind, unnest(classes) AS n, generate_subscripts(classes, 1) AS k, n_all AS total FROM whole
  WHERE n_all >= {MIN_CHARACTERS} AND n_words >= {MIN_HISTOGRAM_WORDS}
  UNION ALL
  SELECT lang, 'w', unnest(common), generate_subscripts(common, 1), n_words FROM whole
  WHERE n_all >= {MIN_CHARACTERS} AND n_words >= {MIN_HISTOGRAM_WORDS}
), sums AS (
  SELECT lang, kind, k, sum(s) AS s FROM (
    SELECT lang, kind, k, floor(n * {UNIT} / total) AS s FROM shares UNION ALL SELECT * FROM usual
  ) GROUP BY lang, kind, k
), refs AS (
  SELECT lang, list(s ORDER BY k) FILTER (WHERE kind = 'c') AS ref_c, list(s ORDER BY k) FILTER (WHERE kind = 'w') AS ref_w
  FROM sums GROUP BY lang
), far AS (
  SELECT x.*, x.n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * x.n_words AS base_failed,
    CASE WHEN n_all >= {MIN_CHARACTERS} THEN {distance_sql("classes", "n_all", "ref_c")} END AS cd,
    CASE WHEN n_words >= {MIN_HISTOGRAM_WORDS} THEN {distance_sql("common", "n_words", "ref_w")} END AS wd
  FROM whole x LEFT JOIN refs r ON x.lang IS NOT DISTINCT FROM r.lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(cd > {MAX_CHARACTER_DISTANCE}, FALSE) OR coalesce(wd > {MAX_WORD_DISTANCE}, FALSE)
    OR (coalesce(cd > {BOTH_CHARACTER_DISTANCE}, FALSE) AND coalesce(wd > {BOTH_WORD_DISTANCE}, FALSE))) AS kept,
  round(cd, 6) AS character_distance, round(wd, 6) AS word_distance
FROM far
"""


SQL = _sql()
