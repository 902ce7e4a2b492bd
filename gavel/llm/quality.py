"""Line-first cleaning: rules per line, then documents that lose too much are rejected."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import once

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A document that loses more than this share of its word characters is rejected.
MAX_LOST = 0.5

WHITE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
# Marks that end or divide sentences, in Latin, Greek, Armenian, Arabic, Urdu,
# Indic, Tibetan, Burmese, Khmer, Ethiopic and Chinese or Japanese writing.
MARKS = ".!?:;…‽¿¡;։՜՞؟؛۔।॥།༎၊။។៖።፧。！？：；．｡"
# Phrases that mark a line as site boilerplate, by language.
PHRASES = {
    "en": ("all rights reserved", "cookie policy", "privacy policy", "terms of use",
           "terms of service", "enable javascript", "subscribe to our newsletter",
           "click here to", "sign in to", "share this page", "back to top", "skip to content"),
    "de": ("alle rechte vorbehalten", "cookie-richtlinie", "datenschutzerklärung",
           "nutzungsbedingungen", "newsletter abonnieren", "zum inhalt springen"),
    "es": ("todos los derechos reservados", "política de privacidad", "política de cookies",
           "términos de uso", "condiciones de uso", "haga clic aquí", "ir al contenido"),
    "fr": ("tous droits réservés", "politique de confidentialité", "politique de cookies",
           "mentions légales", "cliquez ici", "haut de page", "aller au contenu"),
}
#: Letters that match i or s in any case, but whose lower case is neither.
ODD_CASE = "İıſ"
BOILERPLATE = "|".join(phrase for phrases in PHRASES.values() for phrase in phrases)


def words_of(text: Column) -> Column:
    """Maximal runs without space, tab, newline, vertical tab, form feed or return."""
    spaced = F.coalesce(text, F.lit(""))
    for white in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(white), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def _only(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]+", ""))


def may_have_boilerplate(text: Column) -> Column:
    """Whether a line of a text may hold a phrase of ``PHRASES``; none does if this is false.

    Words are compared in lower case. Only ``ODD_CASE`` has other letters that match any
    case of a phrase's letters and whose lower case is another one.
    """
    lower = F.lower(text)
    found = [F.contains(lower, F.lit(p)) for phrases in PHRASES.values() for p in phrases]
    return reduce(or_, found + [F.contains(text, F.lit(c)) for c in ODD_CASE])


def line_fails(line: Column, boilerplate: Column | None = None) -> Column:
    """Whether a line breaks a punctuation, navigation or boilerplate rule.

    Punctuation: symbols ``#*$%&<>`` or exclamation marks for every second word or
    more, or three words and more without any of ``MARKS``. Navigation: four or
    more ``|`` and one for every fourth word or more. Boilerplate: a phrase of
    ``PHRASES``, in any case; only looked for where ``boilerplate`` is true, if given.

    Cheap conditions come first: few lines have a symbol or no full stop.
    """
    words = F.regexp_count(line, F.lit(rf"{WHITE}+")) + 1
    bars = _only(line, "|")
    symbols, shouts = _only(line, "#*$%&<>"), _only(line, "!")
    cluttered = F.rlike(line, F.lit("[#*$%&<>!|]")) & (
        (symbols * 2 >= words) | (shouts * 2 >= words) | ((bars >= 4) & (bars * 4 >= words)))
    marked = F.contains(line, F.lit(".")) | F.rlike(line, F.lit(f"[{MARKS}]"))
    phrase = F.rlike(line, F.lit(f"(?iu){BOILERPLATE}"))
    return (cluttered | (~marked & (words >= 3))
            | (phrase if boilerplate is None else boilerplate & phrase))


def _repeated(pairs: Column) -> Column:
    """Positions whose hash occurs twice or more, of (hash, position) pairs in order of both."""
    hashes = F.transform(pairs, lambda p: p["h"])
    none = F.array(F.lit(None).cast("long"))
    before, after = F.concat(none, hashes), F.concat(F.slice(hashes, F.lit(2), F.size(pairs)), none)
    around = F.arrays_zip(pairs.alias("p"), before.alias("b"), after.alias("a"))
    same = F.filter(around, lambda x: x["p"].isNotNull() & (
        x["p"]["h"].eqNullSafe(x["b"]) | x["p"]["h"].eqNullSafe(x["a"])))
    return F.array_sort(F.transform(same, lambda x: x["p"]["i"]))


def clean_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                max_lost: float = MAX_LOST) -> DataFrame:
    """Per row: the id, measures, the cleaned text and the verdict.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words``
    describe the whole text. ``base_failed``: fewer than ``MIN_WORDS`` words, or more
    than ``MAX_REPEAT_PERCENT`` percent of the words lie in five-word windows found
    twice or more. ``lost_chars`` are the word characters of lines that break a rule
    of ``line_fails``; ``clean_text`` is the text without these lines. ``kept`` is
    false if ``base_failed`` or if more than ``max_lost`` of the characters were lost.

    A null text has no words and no lines: all counts are 0, it fails the base rule
    and ``clean_text`` is null. Lines without a word break no rule and stay. Repeated
    rows are judged alike and all returned; other input columns are left out. The
    work is within each row, so there is no shuffle and no key to be hot.
    """
    text = F.col("_text")
    rows = docs.select(F.col(id_column).alias("_key"), F.col(text_column).alias("_text"))
    rows = once(rows, _words=words_of(text), _lines=F.split(F.coalesce(text, F.lit("")), "\n"),
                _site=F.coalesce(may_have_boilerplate(text), F.lit(False)))
    # Each word is hashed once, its windows from these numbers.
    rows = once(rows, _word_hashes=F.transform("_words", lambda w: F.xxhash64(w)))
    last = F.size("_words") - (WINDOW - 1)
    hashes = F.when(last > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(1)) - 1),
        lambda i: F.xxhash64(*[F.get("_word_hashes", i + k) for k in range(WINDOW)])))
    worded = F.filter("_lines", lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    rows = once(rows.where("true"), _hashes=hashes, _worded=worded)

    rows = once(rows, _pairs=F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    rows = once(rows, _at=F.when(F.col("_pairs").isNotNull(), _repeated(F.col("_pairs"))))
    # Each repeated window covers its five words, or those up to the next repeated one.
    steps = F.zip_with(
        "_at", F.slice("_at", F.lit(2), F.size("_at")),
        lambda a, b: F.when(b.isNull(), F.lit(WINDOW)).otherwise(F.least(b - a, F.lit(WINDOW))))
    repeat_words = F.coalesce(
        F.aggregate(steps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")
    lost = F.aggregate("_worded", F.lit(0).cast("long"), lambda s, x: s + F.when(
        line_fails(x, F.col("_site")), F.length(F.regexp_replace(x, f"{WHITE}+", ""))).otherwise(0))
    rows = once(
        rows,
        n_words=F.size("_words").cast("long"),
        word_chars=F.length(F.array_join("_words", "")).cast("long"),
        n_symbols=F.coalesce(_only(text, SYMBOLS), F.lit(0)).cast("long"),
        n_dup_lines=(F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long"),
        n_repeat_words=repeat_words, lost_chars=lost)
    base = ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    cleaned = F.when(text.isNotNull(), F.array_join(F.filter(
        "_lines", lambda x: ~F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")) | ~line_fails(x, F.col("_site"))), "\n"))
    return rows.select(
        F.col("_key").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", base.alias("base_failed"), "lost_chars",
        (~base & (F.col("lost_chars") <= max_lost * F.col("word_chars"))).alias("kept"),
        cleaned.alias("clean_text"))
