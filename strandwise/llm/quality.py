"""Quality rules, line first: punctuation, navigation and boilerplate rules drop lines; documents losing too much go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let

SYMBOLS = "#*$%&|<>"
#: A document that loses more than this share of its words (in percent) with the failing lines is rejected.
MAX_LOST = 30
#: Phrases of page furniture by language; a line of up to BOILERPLATE_CHARS characters that holds one fails.
PHRASES = {
    "en": ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "click here", "sign up for", "log in to", "enable javascript", "share this", "skip to content"),
    "fr": ("tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "gestion des cookies", "cliquez ici", "inscrivez-vous", "connectez-vous", "activez javascript", "partager cet article", "aller au contenu"),
    "de": ("alle rechte vorbehalten", "cookie-richtlinie", "datenschutzerklärung", "nutzungsbedingungen", "allgemeine geschäftsbedingungen", "hier klicken", "jetzt anmelden", "newsletter abonnieren", "javascript aktivieren", "artikel teilen", "zum inhalt springen"),
    "es": ("todos los derechos reservados", "política de cookies", "política de privacidad", "términos de uso", "condiciones de uso", "aviso legal", "haga clic aquí", "suscríbete", "iniciar sesión", "activar javascript", "saltar al contenido"),
}
BOILERPLATE = tuple(x for language in PHRASES.values() for x in language)
BOILERPLATE_CHARS = 200
#: Signs between the items of a menu; signs that end a sentence, with what may close behind them.
BARS = "|»›•·"
ENDS = r"""[.!?:;…。！？]["'”’»)\]]*$"""
#: A short line has at most ITEM_WORDS words and no sentence end; LIST_LINES of them in a row are a list of items. A teaser is a line
#: of at most TEASER_WORDS words that breaks off. A line of numbers has at least NUMBERS words that begin with a digit, and more than
#: half; a line of capitals at least CAPITALS of them, and more than half of its letters.
ITEM_WORDS, LIST_LINES, TEASER_WORDS, NUMBERS, CAPITALS = 6, 3, 12, 5, 12
NUMBER = r"(^|[ \t-\r])[0-9]"
UPPER, LETTER, LINK, CUT = "[A-ZÀ-ÖØ-Þ]", "[A-Za-zÀ-ÖØ-öø-ÿ]", r"https?://|www\.", r"(…|\.\.\.)$"


def n_words(text: Column) -> Column:
    """Number of maximal runs without ASCII white space."""
    body = F.btrim(text, F.lit(SPACES))
    return F.when(body == "", 0).otherwise(F.size(F.split(body, r"[ \t-\r]+")))


def n_of(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{chars}]"))


def line_fails(line: Column) -> Column:
    """True for a line that breaks a rule by itself: punctuation (decorative symbols, exclamation marks, a short line that breaks
    off), navigation (bars between short items, a link for every three words), signs (more numbers than other words, more capitals than
    small letters) or boilerplate (a known phrase in a short line). The end of a line is what stands before trailing white space."""

    def judged(x):
        line, words, end = x["line"], x["words"], x["end"]
        decorated = (n_of(line, SYMBOLS) >= 3) & (n_of(line, SYMBOLS) * 5 > words)
        shouting = (n_of(line, "!") >= 3) & (n_of(line, "!") * 2 > words)
        navigation = (n_of(line, BARS) >= 3) & (n_of(line, BARS) * 4 > words)
        # one pass over the line decides most cases
        signs = (n_of(line, SYMBOLS + "!" + BARS) >= 3) & (decorated | shouting | navigation)
        links = line.contains("://") | line.contains("www.")
        links = links & (F.regexp_count(line, F.lit(LINK)) * 3 >= words)
        started, upper = F.regexp_count(line, F.lit(NUMBER)), F.regexp_count(line, F.lit(UPPER))
        # few lines have as many digits, and these alone are searched for words
        numbers = (n_of(line, "0-9") >= NUMBERS) & (started >= NUMBERS) & (started * 2 > words)
        capitals = (upper >= CAPITALS) & (upper * 2 > F.regexp_count(line, F.lit(LETTER)))
        teaser = (words <= TEASER_WORDS) & end.rlike(CUT)
        furniture = (F.length(line) <= BOILERPLATE_CHARS) & F.lower(line).rlike("|".join(BOILERPLATE))
        return signs | links | numbers | capitals | teaser | furniture

    body = F.btrim(line, F.lit(SPACES))
    parts = F.struct(line.alias("line"), n_words(line).alias("words"), F.right(body, F.lit(8)).alias("end"))
    return let(parts, judged)


def is_item(line: Column) -> Column:
    """True for a short line with words and without a sentence end: a heading, or an item if others stand beside it."""
    words = n_words(line)
    return (words > 0) & (words <= ITEM_WORDS) & ~F.right(F.btrim(line, F.lit(SPACES)), F.lit(8)).rlike(ENDS)


def in_list(items: Column, i: Column) -> Column:
    """Whether line i (from 0) is one of LIST_LINES or more items in a row."""
    at = lambda k: F.coalesce(F.when(i + k >= 0, F.get(items, i + k)), F.lit(False))
    runs = [[at(k) for k in range(first, first + LIST_LINES)] for first in range(1 - LIST_LINES, 1)]
    alike = lambda xs: xs[0] if len(xs) == 1 else xs[0] & alike(xs[1:])
    out = F.lit(False)
    for run in runs:
        out = out | alike(run)
    return out


def repeated_words(words: Column, width: int = 8) -> Column:
    """Number of words in width-word windows that are found twice or more among the words, the first occurrence included."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - (width - 1), F.lit(0))), lambda x, i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])))

    def covered(starts):
        gaps = F.zip_with(F.slice(starts, 2, F.size(starts) - 1), F.slice(starts, 1, F.size(starts) - 1), lambda b, a: F.least(F.lit(width), b - a))
        return F.aggregate(gaps, F.lit(width), lambda acc, g: acc + g)

    def again(w):
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twins = let(ordered, lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
        return let(F.sort_array(F.transform(twins, lambda x: x["i"])), covered)

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(again(w)))


def quality_rules(docs: DataFrame, text_col: str = "text", max_lost: int = MAX_LOST) -> DataFrame:
    """Every row of docs with added columns: clean_text (the lines that pass, joined by \\n), n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, lost_words (long), base_failed and kept (boolean).

    kept is false if base_failed (fewer than 20 words, or over 30 % of them in repeated 8-word windows) or if the failing lines
    hold more than max_lost percent of the words. Lines fail by themselves (line_fails) or as LIST_LINES or more short items in a
    row; a single heading stays. Null text counts as empty (kept false; clean_text empty). Added columns
    replace columns of docs with the same names; all else passes through. All work is per row: no shuffle, so ties,
    repeated rows and hot sources need nothing special.
    """
    own = ["clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", "base_failed", "kept"]
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in own]
    trimmed = F.btrim(body, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))
    marked = F.transform(F.split(body, "\n", -1), lambda x: F.struct(x.alias("line"), line_fails(x).alias("fails"), is_item(x).alias("item")))
    judged = let(marked, lambda m: let(F.transform(m, lambda x: x["item"]), lambda items: F.transform(m, lambda x, i: F.struct(x["line"].alias("line"), (x["fails"] | (x["item"] & in_list(items, i))).alias("fails")))))

    def line_counts(lines):
        full = F.filter(F.transform(lines, lambda x: x["line"]), lambda x: F.btrim(x, F.lit(SPACES)) != "")
        lost = F.aggregate(F.filter(lines, lambda x: x["fails"]), F.lit(0), lambda n, x: n + n_words(x["line"]))
        clean = F.array_join(F.transform(F.filter(lines, lambda x: ~x["fails"]), lambda x: x["line"]), "\n")
        return F.struct(let(full, lambda f: F.size(f) - F.size(F.array_distinct(f))).alias("dup"), lost.alias("lost"), clean.alias("clean"))

    counts = let(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("again")))
    # the two structs are columns of their own stage so that each is computed once a row
    stage = docs.select(*rest, body.alias("__body"), F.explode(F.array(F.struct(counts.alias("w"), let(judged, line_counts).alias("l")))).alias("__m"))
    n, again, lost = F.col("__m.w.n"), F.col("__m.w.again"), F.col("__m.l.lost")
    failed = (n < 20) | (again * 100 > n * 30)
    return stage.select(
        *rest,
        F.col("__m.l.clean").alias("clean_text"),
        n.cast("long").alias("n_words"),
        F.col("__m.w.chars").cast("long").alias("word_chars"),
        n_of(F.col("__body"), SYMBOLS).cast("long").alias("n_symbols"),
        F.col("__m.l.dup").cast("long").alias("n_dup_lines"),
        again.cast("long").alias("n_repeat_words"),
        lost.cast("long").alias("lost_words"),
        failed.alias("base_failed"),
        (~failed & (lost * 100 <= n * max_lost)).alias("kept"),
    )


def op7_quality_rules(spark, sf_dir):
    from .common import table

    q = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_N = "len(regexp_extract_all({}, '[^ \\t-\\r]+'))"


def _of(x: str, chars: str) -> str:
    return f"(length({x}) - length(translate({x}, '{chars}', '')))"


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), rep AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id
), l AS (
  SELECT doc_id, unnest(string_split(body, chr(10))) AS x, generate_subscripts(string_split(body, chr(10)), 1) AS k FROM d
), lt AS (
  SELECT *, {_N.format('x')} AS n, right(trim(x, {_WS}), 8) AS e FROM l
), lw AS (
  SELECT *, n BETWEEN 1 AND {ITEM_WORDS} AND NOT regexp_matches(e, '{ENDS.replace("'", "''")}') AS item FROM lt
), lr AS (
  SELECT *, k - sum(item::INT) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM lw
), li AS (
  SELECT *, item AND count(*) FILTER (WHERE item) OVER (PARTITION BY doc_id, run) >= {LIST_LINES} AS listed FROM lr
), lf AS (
  SELECT *, (
      listed OR (regexp_matches(x, '{LINK}') AND len(regexp_extract_all(x, '{LINK}')) * 3 >= n)
      OR (len(regexp_extract_all(x, '{NUMBER}')) >= {NUMBERS} AND len(regexp_extract_all(x, '{NUMBER}')) * 2 > n)
      OR (len(regexp_extract_all(x, '{UPPER}')) >= {CAPITALS} AND len(regexp_extract_all(x, '{UPPER}')) * 2 > len(regexp_extract_all(x, '{LETTER}')))
      OR (n <= {TEASER_WORDS} AND regexp_matches(e, '{CUT}')) OR
      ({_of('x', SYMBOLS)} >= 3 AND {_of('x', SYMBOLS)} * 5 > n) OR ({_of('x', '!')} >= 3 AND {_of('x', '!')} * 2 > n)
      OR ({_of('x', BARS)} >= 3 AND {_of('x', BARS)} * 4 > n)
      OR (regexp_matches(lower(x), '{'|'.join(BOILERPLATE).replace("'", "''")}') AND length(x) <= {BOILERPLATE_CHARS})) AS fails FROM li
), la AS (
  SELECT doc_id, count(*) FILTER (WHERE n > 0) - count(DISTINCT x) FILTER (WHERE n > 0) AS n_dup_lines,
         coalesce(sum(n) FILTER (WHERE fails), 0) AS lost FROM lf GROUP BY doc_id
), o AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(body, {_WS}, '')) AS BIGINT) AS word_chars,
         CAST({_of('body', SYMBOLS)} AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, CAST(lost AS BIGINT) AS lost_words
  FROM d JOIN la USING (doc_id) LEFT JOIN cov USING (doc_id)
), f AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost_words * 100 <= n_words * {MAX_LOST} AS kept, lost_words FROM f
"""
